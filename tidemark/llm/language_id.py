"""Language identification by rank-order profiles: a text's most frequent character n-grams are compared to those of each
language by the sum of their displacements in rank (the out-of-place distance)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, table, text_bytes

UNKNOWN = "und"
#: Bits of a code point; an n-gram of up to three characters is one 64-bit number, the first character highest.
BITS = np.uint64(21)


def is_letter() -> np.ndarray:
    """Which code points are letters."""
    import sys

    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngram_counts(text: str, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of 1 to 3 characters within the words of a text, in lower case; a word is a run of letters with
    one blank on either side. Blanks alone don't count. No letter: none."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    alpha = letter[codes]
    if not alpha.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    padded = np.zeros(len(codes) + 2, np.int64)
    padded[1:-1] = np.where(alpha, codes, 32)
    padded[0] = padded[-1] = 32
    blank = padded == 32
    padded = padded[np.append(True, ~(blank[1:] & blank[:-1]))].astype(np.uint64)
    blank = padded == 32
    one = padded[~blank]
    two = (padded[:-1] << BITS) | padded[1:]
    three = (two[:-1] << BITS) | padded[2:]
    three = three[~blank[1:-1]]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The n-grams from the most frequent on, `most` at most; of equal counts the smaller number first."""
    if len(grams) > most:
        cut = np.partition(counts, len(counts) - most)[len(counts) - most]
        some = counts >= cut
        grams, counts = grams[some], counts[some]
    return grams[np.lexsort((grams, -counts))][:most]


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = 400) -> dict[str, list[int]]:
    """The `size` most frequent n-grams of each language over all rows with a text and a language, most frequent first.

    Counts are summed within each task before they are shuffled, so a language of many rows is no hot key. What reaches
    the driver is `size` numbers a language.
    """

    letters = docs.sparkSession.sparkContext.broadcast(is_letter())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters.value
        total: dict[str, pd.Series] = {}
        for batch in batches:
            offsets, _ = text_bytes(batch.column(0))
            for i, j in blocks(offsets, 1 << 20):
                found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
                for x, name in zip(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist(), strict=True):
                    found.setdefault(name, []).append(ngram_counts(x, letter))
                for name, parts in found.items():
                    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                    sums = pd.Series(np.bincount(at, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64), grams.astype(np.int64))
                    total[name] = total[name].add(sums, fill_value=0) if name in total else sums
        for name, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(sums), pa.string()), pa.array(sums.index.to_numpy(np.int64)), pa.array(sums.to_numpy().astype(np.int64))], names=["lang", "gram", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(first.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def identify_language(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", pred: str = "lang_pred", score: str = "score", size: int = 400) -> DataFrame:
    """docs with `pred`, the language of least out-of-place distance, and `score`, 1 less the distance as a share of the
    largest possible one.

    The text's own profile has its `size` most frequent n-grams; each adds the difference of its ranks, or `size` if the
    language's profile lacks it. Of equally near languages the first by name is taken. `und` with score 0 if the text is
    null, empty or has no letter, or if there are no profiles. Texts of any length are read whole. Rows keep their other columns, text included; repeated rows
    stay, an empty table stays empty, and a column of the result's names is replaced. The profiles are `size` numbers a language and go to all tasks.
    """
    names = sorted(profiles)
    known = np.unique(np.array([g for v in profiles.values() for g in v], np.int64))
    rank = np.full((len(names), len(known) + 1), size, np.int64)
    for i, name in enumerate(names):
        rank[i, np.searchsorted(known, profiles[name])] = np.arange(len(profiles[name]))
    sent = docs.sparkSession.sparkContext.broadcast((is_letter(), names, known.astype(np.uint64), rank))

    @F.arrow_udf("struct<pred string, score double>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letter, names, known, rank = sent.value

        def judge(x: str | None) -> tuple[str, float]:
            grams, counts = ngram_counts(x or "", letter)
            if not len(grams) or not names:
                return UNKNOWN, 0.0
            own = ranked(grams, counts, size)
            at = np.searchsorted(known, own)
            hit = known[np.minimum(at, len(known) - 1)] == own
            there = rank[:, np.where(hit, at, len(known))]
            apart = np.where(there < size, np.abs(there - np.arange(len(own))), size).sum(axis=1)
            best = int(apart.argmin())
            return names[best], 1 - float(apart[best]) / (size * len(own))

        for column in batches:
            found = [judge(x.as_py()) for x in column]
            yield pa.StructArray.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=["pred", "score"])

    kept = [c for c in docs.columns if c not in (pred, score)]
    own = "judged"
    while own in docs.columns:
        own += "_"
    found = docs.withColumn(own, judged(F.col(f"`{text}`")))
    return found.select(*(F.col(f"`{c}`") for c in kept), F.col(f"{own}.pred").alias(pred), F.col(f"{own}.score").alias(score))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id's text leaves `fold` when divided by `folds`."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    profiles = learn_profiles(docs.where(~F.col("held_out")))
    return identify_language(docs, profiles).select("doc_id", "held_out", "lang_pred", "score")
