"""Near-duplicates by b-bit MinHash: minima of random permutations of a document's shingles give band keys and, cut to
their low bits and packed, a signature. Documents that share a band key are candidates; equal fields of two signatures,
corrected for chance collisions, estimate their similarity, and the full sets confirm what the estimate leaves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, checkpointed, copied_out, dealt_out, hot_values, lower_bytes, mixed, table, text_bytes, word_hashes, words
from .components import components

#: 56 bands of 6 minima: documents of similarity 0.8 share no band once in 25 million.
BANDS, ROWS = 56, 6
#: Low bits kept of each minimum, in fields of 2 bits, 32 to a long.
BITS = 2
EVEN = 0x5555555555555555
#: Rows of a bucket that are compared in one task.
BLOCK = 512


def shingles(column, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text) of blocks of an Arrow column of texts. A-Z are lower-cased,
    words end at white space; a text of fewer than `size` words, but not none, is one shingle."""
    offsets, raw = text_bytes(column)
    for i, j in blocks(offsets, 1 << 20):
        own = offsets[i : j + 1] - offsets[i]
        lower = lower_bytes()[raw[offsets[i] : offsets[j]]]
        starts, ends, first = words(lower, own)
        hashes = word_hashes(lower, starts, ends)
        n = max(0, len(hashes) - size + 1)
        runs = np.zeros(n, np.uint64)
        for k in range(size):
            runs = mixed(runs * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + n] + np.uint64(k + 1))
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(runs[a : b - size + 1]))
            elif b > a:
                whole = np.full(1, b - a, np.uint64)
                for h in hashes[a:b]:
                    whole = mixed(whole * np.uint64(0x369DEA0F31A53F85) + h)
                out.append(whole)
            else:
                out.append(np.zeros(0, np.uint64))
        yield i, out


def permutations(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 2**32, n).astype(np.uint32)[:, None]


def minima(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray, most: int = 1 << 12) -> np.ndarray:
    """The least image of the hashes under each permutation."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, high.shape[1], most):
        image = high[:, i : i + most] * factors
        image += shifts
        image ^= image >> np.uint32(15)
        np.minimum(out, image.min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, n, x, y, bands, bits): number of shingles, a 128-bit hash of the set, the band keys and the packed low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = permutations(BANDS * ROWS)
        fields = BANDS * ROWS
        longs = -(-fields * BITS // 64)
        place = (np.arange(fields, dtype=np.uint64) % np.uint64(64 // BITS)) * np.uint64(BITS)
        for batch in batches:
            for i, sets in shingles(batch.column(1), size):
                n = np.array([len(s) for s in sets], np.int64)
                x = np.array([int(mixed(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                y = np.array([int(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                least = np.stack([minima(s, factors, shifts) for s in sets]).astype(np.uint64)
                keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS)).copy()
                for r in range(ROWS):
                    keys = mixed(keys * np.uint64(0x9FB21C651E98DF25) + least[:, r::ROWS])
                low = (least & np.uint64((1 << BITS) - 1)) << place
                packed = np.zeros((len(sets), longs * 64 // BITS), np.uint64)
                packed[:, :fields] = low
                packed = packed.reshape(len(sets), longs, 64 // BITS).sum(axis=2, dtype=np.uint64)
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sets)), pa.array(n), pa.array(x), pa.array(y), lists(keys), lists(packed)], names=["id", "n", "x", "y", "bands", "bits"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n long, x long, y long, bands array<long>, bits array<long>")


def id_filter(ids: DataFrame, most: int = 1 << 26) -> tuple[int, np.ndarray]:
    """(m, bits): a bitmap of the ids modulo m, sixteen bits for each id but `most` bits (8 MB) in all. An id whose bit is
    not set is not there; with more ids more others pass."""
    m = min(most, 16 * ids.count()) + 1
    at = F.pmod("id", F.lit(m)) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    bits = np.zeros((m // 32768 + 1) * 32768, bool)
    for r in rows:
        start = (r["bucket"] - 1) * 32768
        bits[start : start + 32768] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
    return m, np.packbits(bits)


def set_table(docs: DataFrame, key: str, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """(id, set): the sorted 64-bit hashes of the distinct shingles of the documents that have one of the ids wanted, and of
    some others. A filter of bounded size finds them where they are read, so that texts aren't shuffled."""
    m, bits = id_filter(wanted)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(sent.value)
        for batch in batches:
            batch = batch.filter(pa.array(there[np.mod(batch.column(0).to_numpy(zero_copy_only=False), m)] > 0))
            for i, sets in shingles(batch.column(1), size):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    return rows.mapInArrow(run, "id long, set binary")


def estimated(a: Column, b: Column) -> Column:
    """Similarity by the share of equal fields of two signatures, less what chance makes equal."""
    unequal = F.aggregate(F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q)), F.lit(0), lambda n, x: n + F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(EVEN))))
    chance = 2.0**-BITS
    return ((1 - unequal / (BANDS * ROWS)) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """Six standard deviations of the estimate below the threshold."""
    chance = 2.0**-BITS
    equal = chance + threshold * (1 - chance)
    return threshold - 6 * math.sqrt(equal * (1 - equal) / (BANDS * ROWS)) / (1 - chance)


def alike(a: pa.Array, b: pa.Array, percent: pa.Array) -> pa.Array:
    """100 * intersection >= percent * union of two sets of sorted hashes."""
    out = []
    for x, y, p in zip(a, b, percent, strict=True):
        x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        small, large = (x, y) if len(x) < len(y) else (y, x)
        at = np.minimum(np.searchsorted(large, small), max(len(large) - 1, 0))
        both = int((large[at] == small).sum()) if len(large) else 0
        out.append(100 * both >= p.as_py() * (len(x) + len(y) - both))
    return pa.array(out, pa.bool_())


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    met = pairs.join(right, "b").join(left, "a")
    return met.where(F.arrow_udf(alike, "boolean")("set_a", "set_b", F.lit(percent))).select("a", "b")


def across(buckets: DataFrame, least: float) -> DataFrame:
    """(b, block, found): for each row b of a bucket (bucket, id, component, size, block, bands, bits, n, major) the rows of
    other components, by block, that pass the estimate; a pair is asked for by its row of the smaller component, and only in
    the first band that it shares, which its band keys tell.

    A bucket's rows are dealt into parts of about BLOCK rows; those outside its major component go to all parts, and a task
    compares them with its part's rows by array operations.
    """
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), count).cast("int")
    minor = F.col("component") != F.col("major")
    dealt = buckets.withColumns({"own": own, "minor": minor}).withColumn("part", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0), count - 1)).otherwise(F.array("own"))))
    dealt = dealt.select("bucket", "part", "own", "minor", "id", "component", "size", "block", "bands", "bits")
    chance = 2.0**-BITS
    most = int((1 - (chance + least * (1 - chance))) * BANDS * ROWS)

    def run(rows: pa.Table) -> pa.Table:
        lists = lambda c: rows.column(c).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        ids, comp, size, block, own = (rows.column(c).to_numpy() for c in ("id", "component", "size", "block", "own"))
        bits, bands, minor = lists("bits").view(np.uint64), lists("bands"), rows.column("minor").to_numpy()
        bucket = rows.column("bucket")[0].as_py()
        home = np.flatnonzero(own == rows.column("part")[0].as_py())
        asks, asked = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p in np.flatnonzero(minor):
            rest = home[(comp[home] != comp[p]) & (~minor[home] | (ids[home] > ids[p]))]
            x = bits[rest] ^ bits[p]
            rest = rest[np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(EVEN)).sum(axis=1, dtype=np.int64) <= most]
            if not len(rest):
                continue
            same = bands[rest] == bands[p]
            rest = rest[bands[p][same.argmax(axis=1)] == bucket]
            mine = (size[p] < size[rest]) | ((size[p] == size[rest]) & (ids[p] > ids[rest]))
            asks.append(np.where(mine, p, rest))
            asked.append(np.where(mine, rest, p))
        asks, asked = np.concatenate(asks), np.concatenate(asked)
        order = np.lexsort((block[asked], ids[asks]))
        asks, asked = asks[order], asked[order]
        new = np.append(True, (ids[asks][1:] != ids[asks][:-1]) | (block[asked][1:] != block[asked][:-1])) if len(asks) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        found = pa.ListArray.from_arrays(pa.array(np.append(begin, len(asks)).astype(np.int32)), pa.array(ids[asked]))
        return pa.table({"b": ids[asks][begin], "block": block[asked][begin], "found": found})

    return dealt.groupBy("bucket", "part").applyInArrow(run, "b long, block long, found array<long>")


def linked_blocks(asked: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) among what was asked for, (b, block, found): one for each row b, block and component. members
    is (id, component, block); a block has some BLOCK rows of one component, and each of its tasks holds their sets and
    meets one asking set after the other, so that candidate pairs are never rows. A block that many ask has several tasks."""
    wanted = checkpointed(asked.groupBy("b", "block").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")))
    hot = hot_values(wanted, "block", wanted.count(), BLOCK)
    there = copied_out(members.join(wanted.select("block").distinct(), "block", "left_semi"), hot, "block").join(sets, "id").select("block", "salt", "id", F.col("set").alias("own"))
    wanted = dealt_out(wanted, hot, "block", "b").join(sets.select(F.col("id").alias("b"), "set"), "b")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("id").to_numpy()
        sizes = np.array([len(x.as_buffer()) // 8 for x in right.column("own")], np.int64)
        every = np.frombuffer(b"".join(x.as_py() for x in right.column("own")), np.uint64)
        owner = np.repeat(np.arange(len(ids)), sizes)
        a, b = [], []
        for who, x, found in zip(left.column("b").to_pylist(), left.column("set"), left.column("found"), strict=True):
            x = np.frombuffer(x.as_buffer(), np.uint64)
            if not len(x) or not len(every):
                continue
            hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
            both = np.bincount(owner[hit], minlength=len(ids))
            good = ids[100 * both >= percent * (sizes + len(x) - both)]
            good = good[np.isin(good, found.values.to_numpy())]
            if len(good):
                a.append(min(who, int(good[0])))
                b.append(max(who, int(good[0])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return wanted.groupBy("block", "salt").cogroup(there.groupBy("block", "salt")).applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: `key`, `n_shingles`, `component_id` (the smallest key reachable over links, itself
    included) and `kept` (the key is its component's).

    A document's set is that of its runs of `size` words, A-Z lower-cased; with fewer words the whole sequence is the only
    one, and a null or empty text has none and is linked with nothing. Documents are linked if 100 * intersection >=
    percent * union (percent of 80 or more, or the bands would miss links). An empty table gives no rows, and texts of any
    length are read whole, one at a time. Rows that share a key share a component; a row with a null key is linked with
    nothing, has a null component and is kept.

    Documents with the same set form a class, found by an aggregation; classes that share a band key are candidates. Each
    bucket first links its members to its smallest one, which a group of copies passes in full, so its size adds rows in
    proportion. Only buckets whose members then lie in different components are searched for pairs between those, in
    blocks; sets travel to blocks and not to pairs. No cap on buckets or partners.
    """
    if percent < 80:
        raise ValueError("the bands find links of 80 percent or more")
    marked = checkpointed(signatures(docs, key, text, size))
    real = marked.where("id is not null and n > 0")
    classes = checkpointed(real.groupBy("x", "y", "n").agg(F.min_by(F.struct("id", "bands", "bits"), "id").alias("r")).select("x", "y", "n", "r.id", "r.bands", "r.bits"))
    bands = classes.select("id", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    buckets = checkpointed(bands.join(shared, "bucket"))
    bits = classes.select("id", "bits")
    stars = buckets.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    estimate = estimated(F.col("bits_a"), F.col("bits_b"))
    least = least_estimate(percent / 100)
    both = stars.join(bits.select(F.col("id").alias("b"), F.col("bits").alias("bits_b")), "b").join(bits.select(F.col("id").alias("a"), F.col("bits").alias("bits_a")), "a")
    pairs = both.where(estimate >= least).select("a", "b")
    asked = buckets.select("id").distinct()
    sets = checkpointed(set_table(docs, key, text, size, asked))
    links = checkpointed(confirmed(pairs, sets, percent))
    found = checkpointed(components(links))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK))
    placed = buckets.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")).join(sizes, "component", "left")
    members = checkpointed(placed.select("id", "component", F.coalesce("size", F.lit(1)).alias("size")).select("id", "component", "size", F.xxhash64("component", part).alias("block")))
    together = buckets.select("bucket", "id", "n").join(members, "id")
    split = together.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max_by("component", F.struct("size", "component")).alias("major")).where("low <> high").select("bucket", "major")
    open_ = together.join(split, "bucket").join(classes.select("id", "bands", "bits"), "id")
    asked = checkpointed(across(open_, least))
    links = links.unionByName(linked_blocks(asked, members, sets, percent))
    found = checkpointed(components(links))
    of_set = classes.select("x", "y", "n", F.col("id").alias("class"))
    placed = marked.join(of_set, ["x", "y", "n"], "left").join(found.select(F.col("id").alias("class"), "component"), "class", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "class")).otherwise(F.col("id"))
    own = F.when(F.col("id").isNotNull(), own)
    return placed.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0))
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id, w.doc_id <= coalesce(least.b, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.a = w.doc_id
"""
