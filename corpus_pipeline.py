"""A training-data pipeline over `documents`: language identification, near-duplicate removal, removal of repeated spans,
benchmark decontamination and tokenising. Each stage works on all that the one before kept, written as Parquet and reread.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import bpe_encode_decode
from tidemark.llm.common import drop_saved, ensure_checkpoint_dir, table
from tidemark.llm.decontaminate import contamination
from tidemark.llm.language_id import UNKNOWN, identify_language, learn_profiles
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.substring_dedup import remove_repeated_words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language is found; those without a letter, or without a text, go. Where no document names
    its language there are no profiles, and all with a letter stay."""
    profiles = learn_profiles(docs)
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = identify_language(docs, profiles, pred="_pred", score="_score")
    return found.where(F.col("_pred") != UNKNOWN).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group linked by 80 % of their five-word shingles. Rows that share an
    id stay or go together; a row without an id is linked with nothing and stays, as does one without text."""
    gone = near_duplicates(docs, size=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words in runs of 50 that a document with a smaller id has too; a document that loses all its words goes.
    n_chars is the length of what stays. A document without an id or without words stays as it is."""
    cut = remove_repeated_words(docs, kept="text", spaced=True)
    return cut.where("n_words = 0 or n_removed < n_words").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark item, all rows of their id; those without text stay."""
    hit = contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("doc_id").distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["doc_id"]), "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, with the text as it was and as the tokens decode; a null text has none."""
    import public_tokenizers

    coded = bpe_encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: The languages are found by a profile distance that has no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written beside the session's checkpoints and read again, and goes when
    the next stage is written. An empty table passes through as one."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), []
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_saved(spark)
        drop_saved(spark, before)
        before = [path]
    return docs
