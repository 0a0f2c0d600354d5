import hashlib
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

os.environ["TOKENIZERS_PARALLELISM"] = "false"

from tokenizers import Tokenizer

from tidemark.llm.bpe import Codec, bpe_encode_decode, op5_bpe
from tidemark.llm.token_counts import op10_token_counts, pieces, token_counts

TRICKY = st.text(alphabet=st.one_of(st.sampled_from("abcdeXYZ '’.,!?\n\t 0123éÉßİΣς日本ａ́<|>"), st.characters(codec="utf-8")), max_size=80)


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def both(request, vocabulary):
    text = open(vocabulary(request.param), encoding="utf-8").read()
    return Codec(text), Tokenizer.from_str(text)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(TRICKY, max_size=4))
def test_codec_is_the_library(both, texts):
    codec, library = both
    texts = [*texts, "".join(texts) + "<|endoftext|>" + "".join(texts)]
    counts, ids, decoded = codec.batch(texts)
    at = 0
    for text, n, back in zip(texts, counts.tolist(), decoded, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[at : at + n].tolist() == want
        assert back == library.decode(want, skip_special_tokens=False)
        at += n


def test_codec_forgets_and_goes_on(vocabulary):
    text = open(vocabulary("word_bpe_49k.json"), encoding="utf-8").read()
    codec, library = Codec(text, most_words=3), Tokenizer.from_str(text)
    for x in ("one two three four five", "six seven", "one two six eight nine"):
        assert codec.batch([x])[1].tolist() == library.encode(x, add_special_tokens=False).ids


def test_encode_and_decode(docs, empty, vocabulary):
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = bpe_encode_decode(docs, path, batch_bytes=1000)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["ids"], r["decoded"]) == (want, library.decode(want, skip_special_tokens=False))
    assert bpe_encode_decode(empty, path).count() == 0
    assert "text" not in bpe_encode_decode(docs, path, ids="n_tokens", keep_text=False).columns


def test_counts(docs, empty, vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    out = token_counts(docs, path, batch_bytes=500, piece_chars=50)
    assert sorted(out.columns) == sorted([*(c for c in docs.columns if c not in ("text", "n_tokens")), "n_bytes", "n_tokens"])
    texts = {r["score"]: r["text"] or "" for r in docs.collect()}
    for r in out.collect():
        text = texts[r["score"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    assert token_counts(empty, path).count() == 0


@settings(max_examples=100, deadline=None)
@given(text=st.text(alphabet="abAB '.\n1é<|endoftext>", max_size=200), most=st.integers(1, 40))
def test_pieces_have_the_texts_tokens(vocabulary, text, most):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    cut = pieces(text, most)
    assert "".join(cut) == text
    assert [i for p in cut for i in library.encode(p, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids


def test_encoding_query(spark, vocabulary):
    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op5_bpe(spark, sf).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[k] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_count_query(spark, vocabulary):
    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        want[r["doc_id"]] = (len((r["text"] or "").encode()), n, n > 512)
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in op10_token_counts(spark, sf).collect()} == want


def test_one_piece_of_half_a_million_letters(spark, vocabulary):
    """A text without a place to cut it is counted whole."""
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = ["日本語" * 60_000, "QUJD" * 100_000]
    rows = token_counts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), vocabulary("byte_bpe_50k.json")).collect()
    assert {r["id"]: r["n_tokens"] for r in rows} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
