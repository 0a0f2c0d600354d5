"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, table, text_bytes

#: Between a letter and a blank that another letter follows: byte-level pre-tokenisers always end a token here.
SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def pieces(text: str, most: int) -> list[str]:
    """text cut at safe boundaries, the first after each `most` characters; the pieces' tokens are the text's tokens."""
    out, at = [], 0
    while len(text) - at > most and (m := SAFE.search(text, at + most)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]] if at else [text]


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", prefix: str = "", batch_bytes: int = 1 << 18, piece_chars: int = 1 << 16) -> DataFrame:
    """docs without `text`, with `<prefix>n_bytes` and `<prefix>n_tokens` of each text.

    tokenizer_path names the JSON file of a byte-level BPE of the tokenizers library, without normaliser; it is read on
    the driver and sent to the tasks. No special tokens are added, nothing is cut or padded. Texts go to the library in
    batches of about batch_bytes bytes; a text of over piece_chars characters is cut at safe boundaries and its pieces'
    counts are added, so that one long text can't hold up a batch. Null counts as an empty text: 0 bytes, 0 tokens.
    Every row keeps its other columns and repeated rows stay; a column of the result's names is replaced.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    new = [f"{prefix}n_bytes", f"{prefix}n_tokens"]
    carried = [f for f in docs.schema.fields if f.name != text and f.name not in new]
    schema = T.StructType([*carried, *(T.StructField(c, T.LongType()) for c in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_str(sent.value)
        encoder.no_truncation()
        encoder.no_padding()
        for batch in batches:
            column = batch.column(0)
            offsets, _ = text_bytes(column)
            counts = []
            for i, j in blocks(offsets, batch_bytes):
                parts = [pieces(x or "", piece_chars) for x in column.slice(i, j - i).to_pylist()]
                lengths = iter([len(e) for e in encoder.encode_batch_fast([p for x in parts for p in x], add_special_tokens=False)])
                counts += [sum(next(lengths) for _ in x) for x in parts]
            sizes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sizes, pa.array(counts, pa.int64())], names=[f.name for f in schema.fields])

    return docs.select(text, *(F.col(f"`{f.name}`") for f in carried)).mapInArrow(run, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 512)
