"""Benchmark decontamination with DataFrame functions only: a broadcast hash set of the benchmark's normalised n-grams,
a scan of the documents' word windows against it, and a comparison of the words of each hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .url_filter import lowered

#: What lies between the words of a normalised text; words are digits, a-z and everything beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A set of windows of up to this many is broadcast, some 60 MB; a larger one is joined by a shuffle.
BROADCAST_WINDOWS = 200_000


def normal_words(text: Column) -> Column:
    """The words of a text in order; none of a null text."""
    return F.array_remove(F.split(F.coalesce(lowered(text), F.lit("")), BETWEEN), "")


def run_hashes(rows: DataFrame, widths: list[int], words: str = "words") -> DataFrame:
    """rows with an array `h<w>` for each width: the hashes of all runs of w words, by start. Runs of 1, 2, 4, ... words
    are hashed from two of half the width, and any other width from those, so a place costs a few steps at any width."""
    out = rows.withColumn("_p1", F.transform(words, lambda w: F.xxhash64(w)))
    have = {1: "_p1"}

    def joined(df: DataFrame, left: str, right: str, shift: int, name: str) -> DataFrame:
        """Hash of the run at i of `left` and the run at i + shift of `right`."""
        n = F.greatest(F.size(right) - shift, F.lit(0))
        return df.withColumn(name, F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), lambda a, b: F.xxhash64(a, b)))

    p = 1
    while 2 * p <= max(widths, default=1):
        out = joined(out, have[p], have[p], p, f"_p{2 * p}")
        p *= 2
        have[p] = f"_p{p}"
    for w in widths:
        p = 1 << (w.bit_length() - 1)
        name, done = have[p], p
        while done < w:
            p = 1 << ((w - done).bit_length() - 1)
            out = joined(out, name, have[p], done, f"_q{w}_{done + p}")
            name, done = f"_q{w}_{done + p}", done + p
        out = out.withColumn(f"h{w}", F.col(name))
    return out.select(*(f"`{c}`" for c in rows.columns), *(f"h{w}" for w in widths))


def benchmark_windows(benchmark: DataFrame, n: int, item: str, text: str) -> DataFrame:
    """(hash, width, run, items): the distinct windows and the ids, as strings, of the items that have each; an item of
    fewer than n words, but not none, is one window."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), normal_words(F.col(text)).alias("words"))
    hashed = run_hashes(rows, list(range(1, n + 1)))
    own = F.concat(*(F.when((F.size("words") == w) if w < n else F.lit(True), F.col(f"h{w}")).otherwise(F.array().cast("array<bigint>")) for w in range(1, n + 1)))
    runs = hashed.select("item", "words", F.least(F.size("words"), F.lit(n)).alias("width"), F.posexplode(own).alias("at", "hash"))
    return runs.groupBy("hash", "width", F.slice("words", F.col("at") + 1, F.col("width")).alias("run")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of docs: `key`, `n_words`, `n_hit` (words inside any occurrence of a benchmark window),
    `items` (sorted array of the items, as strings, with occurring windows) and `spans` (array of (start, width) of the
    occurrences, in words).

    Words are runs of digits, letters a-z after A-Z are lower-cased, and characters beyond ASCII. A window is n words in
    a row of an item; an item of fewer words, but not none, is one window. Hits found by hash are confirmed on the words.
    Null and empty texts have no words, on either side; an item with a null id counts through its words but is not
    listed. Repeated rows, and rows that share a key, are judged apart. An empty benchmark hits nothing.

    Documents are scanned once and not shuffled: only a row each and its hits are grouped. The windows are broadcast up to
    BROADCAST_WINDOWS, a count taken beforehand, and joined by hash beyond it.
    """
    known = benchmark_windows(benchmark, n, item, item_text)
    widths = sorted(r[0] for r in known.select("width").distinct().collect())
    few = known.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    known = known.select(F.col("hash").alias("known"), F.col("width").alias("known_width"), "run", "items")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), normal_words(F.col(text)).alias("words"))
    sentinel = F.array(F.lit(None).cast("bigint"))
    scanned = run_hashes(rows, widths).select("row", "key", "words", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(sentinel, *(f"h{w}" for w in widths))).alias("at", "hash"))
    start, width = place(F.col("at") - 1, F.col("n_words").cast("int"), widths)
    scanned = scanned.withColumns({"start": start, "width": width})
    own = F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("width"))
    if not few:  # rows that are shuffled take their window along instead of all the words
        scanned = scanned.select("row", "key", "n_words", "start", "width", "hash", own.alias("own"))
        own = F.col("own")
    met = scanned.join(F.broadcast(known) if few else known, F.col("hash") == F.col("known"), "left")
    same = F.col("known").isNotNull() & (F.col("width") == F.col("known_width")) & (own == F.col("run"))
    found = met.where((F.col("start") < 0) | same).select("row", "key", "n_words", F.when(F.col("start") >= 0, F.struct("start", "width")).alias("span"), "items")
    grouped = found.groupBy("row", "key", "n_words").agg(F.array_sort(F.collect_list("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return grouped.select(F.col("key").alias(key), "n_words", covered(F.col("spans")).alias("n_hit"), "items", "spans")


def place(at: Column, n_words: Column, widths: list[int]) -> tuple[Column, Column]:
    """(start, width) of entry `at` of the arrays of all widths one after the other; -1 before the first."""
    start, width, before = F.lit(-1), F.lit(0), F.lit(0)
    for w in widths:
        start, width = F.when(at >= before, at - before).otherwise(start), F.when(at >= before, F.lit(w)).otherwise(width)
        before = before + F.greatest(n_words - w + 1, F.lit(0))
    return start, width


def covered(spans: Column) -> Column:
    """Number of places inside any of some sorted (start, width) spans."""
    first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(state: Column, span: Column) -> Column:
        end = span["start"] + span["width"]
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + F.greatest(F.lit(0), end - F.greatest(state["end"], span["start"]))).alias("n"))

    return F.aggregate(spans, first, add, lambda s: s["n"].cast("long"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
), hit AS (
  SELECT doc_id, n, i, item FROM dw JOIN bw USING (n, g)
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON places.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
