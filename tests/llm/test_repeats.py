import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import repeats, suffix_dedup
from tidemark.llm.common import CLEANUP, saved
from tidemark.llm.substring_dedup import op7_substring_dedup, remove_repeated_words
from tidemark.llm.suffix_dedup import bounds, op4_suffix_dedup, remove_repeated_bytes, suffix_order


def brute(rows, width, symbols):
    """{row number: which symbols go} by comparing all windows."""
    first: dict = {}
    cut = [(k, symbols(t)) for k, t in rows]
    for k, s in cut:
        if k is not None:
            for i in range(len(s) - width + 1):
                w = tuple(s[i : i + width])
                first[w] = min(first.get(w, k), k)
    out = []
    for k, s in cut:
        gone = [False] * len(s)
        if k is not None:
            for i in range(len(s) - width + 1):
                if first[tuple(s[i : i + width])] < k:
                    gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def spans(gone):
    out, i = [], 0
    while i < len(gone):
        j = i
        while j < len(gone) and gone[j]:
            j += 1
        if j > i:
            out.append((i, j - i))
        i = max(j, i + 1)
    return out


def as_bytes(text):
    return list((text or "").encode())


def as_words(text):
    return (text or "").encode().split()


def expected(rows, width, symbols, join):
    out = defaultdict(list)
    for (k, t), gone in zip(rows, brute(rows, width, symbols), strict=True):
        left = join([x for x, g in zip(symbols(t), gone, strict=True) if not g])
        out[k].append((len(gone), sum(gone), spans(gone), left))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def found(df, column):
    out = defaultdict(list)
    for r in df.collect():
        out[r[0]].append((r[1] if isinstance(r[1], int) else None, r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r[column]) if not isinstance(r[column], str) else r[column].encode()))
    return {k: sorted(v, key=repr) for k, v in out.items()}


@pytest.fixture(params=[(4 << 20, 256), (700, 256), (700, 1)])
def chunks(request, monkeypatch):
    """One chunk for all, many small ones, and with minimizers hot as soon as two chunks have them."""
    monkeypatch.setattr(repeats, "CHUNK_BYTES", request.param[0])
    monkeypatch.setattr(repeats, "LARGE_CHUNK", request.param[0])
    monkeypatch.setattr(repeats, "HOT", request.param[1])
    return request.param


@pytest.mark.parametrize("rows", [[(i, f"{i} " + "x" * 40) for i in range(200)], [(7, f"{i} " + "x" * 40) for i in range(200)], [(None, f"{i} " + "x" * 40) for i in range(200)], [(i * i * 10**12, "x" * 40) for i in range(200)]])
def test_chunks_have_like_sizes(spark, monkeypatch, rows):
    """Whatever the keys: different, all the same, all null, or clustered."""
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 400)
    monkeypatch.setattr(repeats, "LARGE_CHUNK", 400)
    sizes = [r["count"] for r in repeats.in_chunks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", [])[0].groupBy("chunk").count().collect()]
    assert len(sizes) > 12 and max(sizes) < 30


def repeated_rows():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    make = lambda n: " ".join(rng.choice(words, n))
    passages = [make(20) for _ in range(4)]
    rows = [(i, " ".join(x for _ in range(rng.integers(1, 5)) for x in (make(rng.integers(0, 15)), passages[rng.integers(4)], "\n")) if rng.random() < 0.8 else make(rng.integers(0, 60))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, rows[3][1]), (62, rows[3][1]), (63, "ab" * 400), (64, "ab" * 300), (None, rows[5][1]), (65, rows[5][1] + " über"), (66, "é" * 60), (67, "é" * 60)]


def test_bytes(spark, chunks):
    rows = repeated_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = remove_repeated_bytes(df, length=30)
    assert found(out, "kept") == expected(rows, 30, as_bytes, bytes)


def test_words(spark, chunks):
    rows = repeated_rows()
    df = spark.createDataFrame([(*r, i, "s") for i, r in enumerate(rows)], "doc_id long, text string, n_words int, spans string").repartition(5)
    out = remove_repeated_words(df, length=8)
    assert out.columns == ["doc_id", "n_words", "n_removed", "spans", "kept"]
    assert found(out, "kept") == expected(rows, 8, as_words, b" ".join)


def test_spaced_text(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(1, f"a\n{passage}  b"), (2, f"  x\ty\n{passage}\n\nz z"), (3, None), (4, "  as it\n was "), (5, passage)]
    out = remove_repeated_words(spark.createDataFrame(rows, "doc_id long, text string"), length=10, kept="text", spaced=True)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: rows[0][1], 2: "  x\ty\nz z", 3: None, 4: "  as it\n was ", 5: ""}


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_bytes(none).count() == 0
    assert remove_repeated_words(none).count() == 0
    only = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert remove_repeated_words(only, length=2).where("n_removed > 0").count() == 0


def test_no_shuffle_outlives_what_is_saved(spark):
    """Each step of the graph shuffles all text again, so that files of ended steps would add up to several times the input."""
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in held.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before, setting = files(), spark.conf.get(CLEANUP, None)
    out = saved(spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").agg({"id": "sum"}))
    assert files() <= before and spark.conf.get(CLEANUP, None) == setting
    assert out.count() == 7


@settings(max_examples=60, deadline=None)
@given(text=st.lists(st.integers(0, 3), min_size=1, max_size=60), length=st.integers(1, 20))
def test_bounds_are_common_prefixes(text, length):
    text = np.array([*text, 5], np.int16)
    order = suffix_order(text, length)
    turned = [tuple(np.roll(text, -i)[:length]) for i in order]
    assert turned == sorted(turned)
    assert bounds(text[order - 1], length).tolist() == [i == 0 or turned[i] != turned[i - 1] for i in range(len(turned))]


def test_several_transforms_of_a_part(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 200)
    rows = repeated_rows()
    out = remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), length=30)
    assert found(out, "kept") == expected(rows, 30, as_bytes, bytes)


def test_mail_where_all_bytes_repeat(spark, monkeypatch):
    """All segments then are candidates, of which the mail has a fingerprint, a minimizer and a key once."""
    rng = np.random.default_rng(11)
    texts = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(150)]
    rows = [(1000 * k + i, t) for k in range(3) for i, t in enumerate(texts)]
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 100_000)
    monkeypatch.setattr(repeats, "LARGE_CHUNK", 100_000)
    mail, asked = [], suffix_dedup.Exchange.asked
    monkeypatch.setattr(suffix_dedup.Exchange, "asked", lambda self, sent, answer: [mail.append(sent), out := asked(self, sent, answer), mail.append(out)][1])
    out = remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r["n_removed"] for r in out.where("doc_id >= 1000").collect()} == {2000}
    sent = sum(len(zlib.compress(bytes(r["data"]), 1)) for m in mail for r in m.select("data").collect())
    assert sent < 1.9 * sum(len(t) for _, t in rows)


def test_mail_does_not_grow_with_copies(spark, monkeypatch):
    """A text that an earlier document has sends a digest; its segments are those of that document."""
    rng = np.random.default_rng(12)
    texts = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(150)]
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 100_000)
    monkeypatch.setattr(repeats, "LARGE_CHUNK", 100_000)
    mail, asked = [], suffix_dedup.Exchange.asked
    monkeypatch.setattr(suffix_dedup.Exchange, "asked", lambda self, sent, answer: [mail.append(sent), out := asked(self, sent, answer), mail.append(out)][1])
    sent = []
    for copies in (1, 4):
        mail.clear()
        rows = [(1000 * k + i, t) for k in range(copies) for i, t in enumerate(texts)]
        out = remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
        assert {(r["doc_id"] >= 1000, r["n_removed"]) for r in out.collect()} == {(k > 0, 2000 * (k > 0)) for k in range(copies)}
        sent.append(sum(len(bytes(r["data"])) for m in mail for r in m.where("kind <> 'state'").select("data").collect()))
    assert sent[1] < 1.5 * sent[0]


@pytest.mark.parametrize(("query", "symbols", "join"), [(op4_suffix_dedup, as_bytes, bytes), (op7_substring_dedup, as_words, b" ".join)])
def test_queries(spark, query, symbols, join):
    sf = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {k: (v[0][0], v[0][1], hashlib.sha256(v[0][3]).hexdigest()) for k, v in expected(rows, 50, symbols, join).items()}
    assert {r["doc_id"]: (r[1], r["n_removed"], r["kept_sha256"]) for r in query(spark, sf).collect()} == want
