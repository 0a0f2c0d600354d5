"""What several corpus operators share: reading tables, Arrow text buffers, vectorised hashing, checkpoints."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the session names in spark.checkpoint.dir; only a local session without one, as in
    tests, gets a temporary folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables that operators wrote for their own later steps, since they were last dropped.
SAVED: list[str] = []
#: Whether the files of a query's shuffles go when it ends; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, instead: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """df, computed once and written as Parquet beside the checkpoints. Unlike a checkpoint it is compressed, later steps read
    only the columns that they need, and Spark knows its size: the sizes that it estimates for checkpoints of joins of
    checkpoints grow without bound. Its shuffles' files go as soon as it is written. instead: paths that are no longer needed
    then; the new one takes their place. codec: of the Parquet files, where it is not the session's."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/saved-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    SAVED.append(path)
    if instead is not None:
        drop_saved(spark, instead)
        instead.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(spark: SparkSession, paths: list[str] = SAVED) -> None:
    """Deletes what `saved` wrote: for callers whose results are written, as a DataFrame that needs it can't be read after."""
    while paths:
        path = paths.pop()
        if path in SAVED:
            SAVED.remove(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: At most twice so many values are hot, as each has more than this share of the rows.
HOT_SHARE = 10_000


def hot_values(df: DataFrame, column: str, rows: int, least: int) -> DataFrame:
    """(column, parts): the values that more than `least` of df's rows have, and more than one in HOT_SHARE, and how many tasks
    should share them. There are fewer than HOT_SHARE of them whatever the data, so that they may be broadcast."""
    most = max(least, rows // HOT_SHARE)
    counts = df.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return F.broadcast(counts.select(column, F.ceil(F.col("n") / most).cast("int").alias("parts")))


def dealt_out(df: DataFrame, hot: DataFrame, column: str, by: str) -> DataFrame:
    """df with `salt`: rows of a hot value are dealt to its parts by another column."""
    return df.join(hot, column, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")).cast("int"), F.lit(0))).drop("parts")


def copied_out(df: DataFrame, hot: DataFrame, column: str) -> DataFrame:
    """df with `salt`: rows of a hot value are copied to each of its parts."""
    return df.join(hot, column, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column in UTF-8: text i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def blocks(offsets: np.ndarray, most: int):
    """Ranges (i, j) of texts that together hold about `most` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        np.multiply(out[:more], np.uint64(pow(base, done, 2**64)), out=out[done : done + more])
        done += more
    return out[:n]


class Rolling:
    """Hashes of runs of symbols. Symbols are 64-bit values; a run's hash is the sum of symbol * BASE**i over it, moved
    to the origin, and mixed; every run of a block is then one subtraction and one product away."""

    def __init__(self, symbols: np.ndarray):
        self.inverse = powers(BASE_INVERSE, len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * powers(BASE, len(symbols)), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Of the run of `width` symbols that starts at each place."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n] + np.uint64(width))


def byte_table(seed: int = 7) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def space_bytes() -> np.ndarray:
    """Which bytes separate words: space and 9 to 13."""
    out = np.zeros(256, bool)
    out[[9, 10, 11, 12, 13, 32]] = True
    return out


def lower_bytes() -> np.ndarray:
    """Each byte with A-Z in lower case."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words of some texts, and first[i] is the number of words before text i
    (one entry more than texts). Words end at white space and at the end of their text."""
    word = np.zeros(len(raw) + 1, bool)
    word[:-1] = ~space_bytes()[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = word[edges]
    starts = np.flatnonzero(begins)
    stops = word[:-1] & ~word[1:]
    inner = offsets[1:][np.diff(offsets) > 0]
    inner = inner[(inner > 0)]
    stops[inner - 1] = word[inner - 1]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 7) -> np.ndarray:
    """64-bit hashes of words given as byte ranges."""
    return Rolling(byte_table(seed)[raw]).of(starts, ends) if len(raw) else np.zeros(0, np.uint64)
