import re

import corpus_pipeline
from tidemark.llm.common import table

from .test_documents import brute_components, hits, windows_of
from .test_repeats import as_words, brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "substring_dedup", "decontaminate", "encode"]
    rows = {k: t for k, t in rows.items() if t and any(c.isalpha() for c in t)}
    kept = brute_components(rows.items(), 5, 80)
    rows = {k: t for k, t in rows.items() if kept[k][2]}
    gone = dict(zip(rows, brute(list(rows.items()), 50, as_words), strict=True))
    left = {k: [w.decode() for w, g in zip(as_words(t), gone[k], strict=True) if not g] for k, t in rows.items()}
    rows = {k: v for k, v in left.items() if v}
    windows = windows_of([(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()])
    rows = {k: v for k, v in rows.items() if not hits(" ".join(v), windows)[1]}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"]) for r in out} == rows
    assert all(r["n_tokens"] == len(r["ids"]) and r["n_tokens"] > 0 for r in out)


def test_stages_keep_the_columns(spark, docs, empty):
    from pyspark.sql import functions as F

    for frame in (docs, empty):
        now = frame.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF)
            if name != "encode":
                assert out.columns == now.columns
            out.collect()


def test_texts_stay_where_no_language_is_named(spark):
    rows = [(1, "some words"), (2, None), (3, ""), (4, "... 123 !!!"), (5, "日本語"), (None, "é")]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()} == {1, 5, None}
