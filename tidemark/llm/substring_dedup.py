"""Removal of long repeated word runs by a De Bruijn graph of the corpus: runs of `length` words are edges between the runs
of one word less at their ends. Edges that several documents have are kept, each with its source, the least document and
place that has it; edges that follow each other through a node of one edge in and one out, and whose sources follow each
other too, are compacted to one path; what a document shares with a path is a span, and each span is verified at its source.

1. Chunks of documents learn which of their windows can repeat (see repeats); only these enter the graph.
2. Neighbouring edges of one minimizer are a segment. All edges of a minimizer that only one distinct segment has lie in that
   segment, so that its inner nodes don't branch: it is one compacted edge from the start. The segments of other
   minimizers are split into single edges.
3. The graph's edges, their sources, the degrees of their nodes and the paths are Spark aggregations and joins. A chunk sends
   an edge once, so that copies add no rows within a chunk and no edge has more rows than there are chunks.
4. A join brings the sources back to the chunks, which put their windows together to spans.
5. Distinct spans go to the chunk of their source. There the words must have the span's fingerprints, 128 bits by two
   families of hashes; what does not hold is not removed.
"""

from __future__ import annotations

import pickle
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, table
from .repeats import Chunk, Exchange, Setting, candidates, covered, grouped, runs, second_prints, spread

#: Compacted edges of a chunk: a hash of their words and, by another family of hashes, of their first and last nodes; how many
#: edges were compacted; the least and greatest keys that have them; their first place.
EDGE = "print long, tail long, head long, n int, key long, last long, chunk long, place int"
SALT = 16
SPAN = ("from_chunk", "from_place", "windows", "print", "check")


def edge_rows(chunk: Chunk, own: int, starts: np.ndarray, count: np.ndarray, keys: np.ndarray, last: np.ndarray) -> dict[str, pa.Array]:
    node = chunk.setting.width - 1
    second = second_prints(chunk) if len(starts) else None
    tail, head = (second.of(x, x + node) if len(starts) else np.zeros(0, np.uint64) for x in (starts, starts + count))
    columns = {"print": chunk.hashes(starts, count + node).view(np.int64), "tail": tail.view(np.int64), "head": head.view(np.int64), "n": count.astype(np.int32)}
    return {k: pa.array(v) for k, v in (columns | {"key": keys, "last": last, "chunk": np.full(len(starts), own), "place": starts.astype(np.int32)}).items()}


def segments_of(exchange: Exchange) -> DataFrame:
    """(EDGE, anchor): the distinct segments of each chunk whose minimizer, the anchor, several documents have."""
    parts = exchange.parts

    def send(chunk: Chunk, own: int, got: pa.Table) -> pa.Table:
        begin, count, anchors, _ = candidates(chunk, got, parts)
        prints, keys = chunk.hashes(begin, count + chunk.setting.width - 1), chunk.key_at(begin) if len(begin) else begin
        # a chunk's documents are in order of key, so that the first of equal segments has the least
        which, first = grouped(prints, anchors, np.arange(len(begin)))
        last = keys[first]
        np.maximum.at(last, which, keys)
        order = np.argsort(first)
        first, last = first[order], last[order]
        return pa.table(edge_rows(chunk, own, begin[first], count[first], keys[first], last) | {"anchor": pa.array(anchors[first].view(np.int64))})

    return saved(exchange.met(exchange.minimizers(), send, EDGE + ", anchor long"))


def single_edges(exchange: Exchange, segments: DataFrame) -> DataFrame:
    """(EDGE): every edge of some segments (chunk, place, n, key, last) on its own."""

    def send(chunk: Chunk, own: int, got: pa.Table) -> pa.Table:
        order = np.argsort(got.column("place").to_numpy(), kind="stable")
        place, n, key, last = (got.column(c).to_numpy().astype(np.int64)[order] for c in ("place", "n", "key", "last"))
        starts = spread(place, n)
        return pa.table(edge_rows(chunk, own, starts, np.ones(len(starts), np.int64), np.repeat(key, n), np.repeat(last, n)))

    return saved(exchange.met(segments.select("chunk", "place", "n", "key", "last"), send, EDGE))


def distinct_edges(edges: DataFrame, *more: str) -> DataFrame:
    """(print, tail, head, n, more, key, chunk, place, last): equal edges as one, with their source."""
    source = F.min(F.struct("key", "chunk", "place")).alias("source")
    kept = [F.min(c).alias(c) for c in ("head", "n", *more)]
    return edges.groupBy("print", "tail").agg(source, *kept, F.max("last").alias("last")).select("print", "tail", "head", "n", *more, "source.*", "last")


def paths_of(edges: DataFrame) -> DataFrame:
    """edges (print, tail, head, n, key, chunk, place) with `path`, the place at which the path that they are compacted to
    begins at their source, instead of head: it goes on through a node of one edge in and one out if the sources do too."""
    ends = F.array(F.struct(F.col("tail").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("head").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    single = nodes.where("out = 1 and into = 1").select(F.col("node").alias("tail"), F.lit(True).alias("single"))
    along = Window.partitionBy("chunk").orderBy("place")
    follows = F.col("single") & (F.lag(F.col("place") + F.col("n")).over(along) == F.col("place"))
    begun = edges.join(single, "tail", "left").withColumn("begin", F.when(F.coalesce(follows, F.lit(False)), None).otherwise(F.col("place")))
    return begun.withColumn("path", F.last("begin", ignorenulls=True).over(along)).select("print", "tail", "n", "key", "chunk", "place", "path")


def sources_of(exchange: Exchange) -> DataFrame:
    """(chunk, place, n, key, from_chunk, from_place, path): the edges of each chunk that several documents have, where they
    first are in the chunk, and the key and place of their source."""
    segments = segments_of(exchange)
    # a minimizer may have segments in a third of all documents: they meet its mark in SALT tasks
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("print"), F.lit(SALT)))
    kinds = salted(distinct_edges(segments, "anchor"))
    open_ = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt"))
    single = single_edges(exchange, salted(segments).join(open_, ["anchor", "salt"], "left_semi"))
    shared = kinds.join(open_, ["anchor", "salt"], "left_anti").drop("anchor", "salt").unionByName(distinct_edges(single)).where("key < last").drop("last")
    found = paths_of(saved(shared)).toDF("print", "tail", "n", "key", "from_chunk", "from_place", "path")
    there = segments.select("print", "tail", "chunk", "place").unionByName(single.select("print", "tail", "chunk", "place"))
    return there.join(found, ["print", "tail"]).select("chunk", "place", "n", "key", "from_chunk", "from_place", "path")


def spans_of(chunk: Chunk, got: pa.Table) -> tuple[np.ndarray, ...]:
    """(starts, windows, number of their distinct span, the distinct spans): the windows whose source has a smaller key, in
    runs of one path whose sources follow each other."""
    place, n, key, where, at, path = (got.column(c).to_numpy().astype(np.int64) for c in ("place", "n", "key", "from_chunk", "from_place", "path"))
    starts, which = chunk.windows_like(spread(place, n))
    key, where, at, path = np.repeat(key, n), np.repeat(where, n), spread(at, n), np.repeat(path, n)
    early = key[which] < chunk.key_at(starts) if len(starts) else np.zeros(0, bool)
    starts, which = starts[early], which[early]
    where, at, path = where[which], at[which], path[which]
    cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(where) != 0) | (np.diff(at) != 1) | (np.diff(path) != 0)) + 1
    begin = np.concatenate([[0], cut]).astype(np.int64) if len(starts) else starts
    count = np.diff(np.append(begin, len(starts)))
    first, ends = starts[begin], starts[begin] + count + chunk.setting.width - 1
    prints = (chunk.hashes(first, ends - first), second_prints(chunk).of(first, ends)) if len(first) else (first, first)
    distinct = np.stack([where[begin], at[begin], count, *(p.view(np.int64) for p in prints)], axis=1)
    distinct, number = np.unique(distinct, axis=0, return_inverse=True)
    return first, count, number.ravel(), distinct


def repeated_spans(exchange: Exchange, finish, schema) -> DataFrame:
    """finish(chunk, starts of the verified windows that also start in a document with a smaller key) of each chunk."""
    longs = ", ".join(f"{c} long" for c in SPAN)

    def ask(chunk: Chunk, own: int, got: pa.Table) -> pa.Table:
        """The chunk's distinct spans, and what it needs to know them again."""
        first, count, number, distinct = spans_of(chunk, got)
        state = pickle.dumps((first.astype(np.int32), count.astype(np.int32), number.astype(np.int32)))
        columns = {c: pa.array(distinct[:, i]) for i, c in enumerate(SPAN)} | {"chunk": pa.array(np.full(len(distinct), own)), "number": pa.array(np.arange(len(distinct)))}
        asked = pa.table(columns | {"state": pa.nulls(len(distinct), pa.binary())})
        held = pa.table({c: pa.nulls(1, pa.int64()) for c in SPAN} | {"chunk": [own], "number": pa.nulls(1, pa.int64()), "state": pa.array([state], pa.binary())})
        return pa.concat_tables([asked, held])

    def verify(chunk: Chunk, own: int, got: pa.Table) -> pa.Table:
        place, windows, one, two = (got.column(c).to_numpy() for c in SPAN[1:])
        ends = place + windows + chunk.setting.width - 1
        order = np.argsort(place, kind="stable")
        order = order[ends[order] <= chunk.n]
        holds = np.zeros(len(place), bool)
        if len(order):
            same = chunk.hashes(place[order], (ends - place)[order]).view(np.int64) == one[order]
            holds[order] = same & (second_prints(chunk).of(place[order], ends[order]).view(np.int64) == two[order])
        return got.select(["chunk", *SPAN[1:]]).filter(pa.array(holds)).rename_columns(SPAN)

    def end(chunk: Chunk, own: int, got: pa.Table) -> pa.Table:
        state = [x.as_py() for x in got.column("state").drop_null()]
        if not state:
            return finish(chunk, np.zeros(0, np.int64))
        first, count, number = (x.astype(np.int64) for x in pickle.loads(state[0]))
        good = np.zeros(int(number.max()) + 1 if len(number) else 0, bool)
        good[got.column("number").drop_null().to_numpy()] = True
        return finish(chunk, spread(first[good[number]], count[good[number]]))

    asked = saved(exchange.met(sources_of(exchange), ask, longs + ", chunk long, number long, state binary"))
    spans = asked.where("state is null")
    verified = exchange.met(spans.select(*SPAN).distinct().withColumnRenamed("from_chunk", "chunk"), verify, longs)
    held = spans.join(verified, list(SPAN)).select("chunk", "number", "state")
    return exchange.met(held.unionByName(asked.where("state is not null").select("chunk", "number", "state")), end, schema)


def remove_repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, kept: str = "kept", spaced: bool = False) -> DataFrame:
    """docs without `text`, with `n_words`, `n_removed`, `spans` (array of (start, length), the maximal removed runs of
    words) and `kept`, the words that stay.

    Words end at white space and are otherwise unchanged; a null or empty text has none, and an empty table gives no rows. A
    word goes if it is in a run of `length` words of its document that also starts in a document with a smaller key, judged
    on the input; of equal runs the smallest key's stays. `kept` joins the words by one blank or, if spaced is set, is the
    text without what was removed: a text that loses nothing stays as it is, null included. Rows with equal keys are not
    smaller than each other, and a row with a null key neither loses words nor takes any. Other columns and repeated rows
    stay; columns of the result's names are replaced. A text of any length is one row of one chunk, whose task holds some
    dozen times its bytes.
    """
    new = ["n_words", "n_removed", "spans", kept]
    carry = [f for f in docs.schema.fields if f.name not in (key, text, *new)]

    def finish(chunk: Chunk, starts: np.ndarray) -> pa.Table:
        gone = covered(chunk, starts)
        counts, removed, spans, left = np.diff(chunk.first), [], [], []
        absent = chunk.rows.column("text").is_null().to_pylist()
        for i, (a, b) in enumerate(zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist(), strict=True)):
            own = gone[a:b]
            removed.append(int(own.sum()))
            s, n = runs(np.flatnonzero(own))
            spans.append([{"start": int(x), "length": int(y)} for x, y in zip(s, n, strict=True)])
            whole = chunk.raw[chunk.offsets[i] : chunk.offsets[i + 1]].tobytes()
            if spaced and not removed[-1]:
                left.append(None if absent[i] else whole.decode())
            elif spaced:
                s, n = runs(np.flatnonzero(~own) + a)
                ends = [int(chunk.starts[e]) if e < b else int(chunk.offsets[i + 1]) for e in (s + n).tolist()]
                begins = [int(chunk.starts[x]) if x > a else int(chunk.offsets[i]) for x in s.tolist()]
                left.append(b"".join(chunk.raw[x:y].tobytes() for x, y in zip(begins, ends, strict=True)).decode())
            else:
                found = whole.split()
                left.append(b" ".join(compress(found, (~own).tolist()) if removed[-1] else found).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        columns = {"key": chunk.rows.column("key"), **{f"c_{f.name}": chunk.rows.column(f"c_{f.name}") for f in carry}}
        return pa.table(columns | {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, span), "left": pa.array(left, pa.string())})

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    schema = T.StructType([
        T.StructField("key", T.LongType()), *(T.StructField(f"c_{f.name}", f.dataType) for f in carry), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("left", T.StringType()),
    ])
    exchange = Exchange(docs, key, text, [f.name for f in carry], Setting("words", length, max(1, length // 2 - 1)))
    out = repeated_spans(exchange, finish, schema)
    return out.select(F.col("key").alias(key), *(F.col(f"`c_{f.name}`").alias(f.name) for f in carry), "n_words", "n_removed", "spans", F.col("left").alias(kept))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_words(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), first AS (
  SELECT g, min(doc_id) AS first FROM g GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN first USING (g) WHERE doc_id > first
), kept AS (
  SELECT word.doc_id, count(gone.p) AS n, string_agg(CASE WHEN gone.p IS NULL THEN x END, ' ' ORDER BY word.p) AS t
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
