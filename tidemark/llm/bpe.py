"""BPE encoding and decoding. The merges of a word are found with a segment tree over its adjacent pairs: a leaf holds
(rank, place) of the pair that starts there, a node the smaller of its children's, so the root yields the leftmost pair
of lowest rank. A merge changes three leaves, each in a logarithmic number of steps, until the root has no pair left."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, table, text_bytes

NONE = np.iinfo(np.int64).max
#: Characters that the fast way of splitting takes; their normal form, case and class are the same in all libraries.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7E¡-įı-ɏ]*")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable in Latin-1, else
    the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The merges of a BPE vocabulary over ids, and segment trees of many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str, prefix: str = ""):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.width = max(vocab.values(), default=0) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b[len(prefix) :]] for a, b in pairs], np.int64)
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        letters = byte_letters()
        self.inner = np.array([vocab.get(letters[b], -1) for b in range(256)], np.int64)
        self.last = np.array([vocab.get(letters[b] + suffix, -1) for b in range(256)], np.int64)

    def leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """rank * size + place of pairs that merge, NONE of others and where right is negative."""
        if not len(self.keys):
            return np.full(left.shape, NONE)
        pair = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where((right >= 0) & (left >= 0) & (self.keys[at] == pair), self.rank[at] * size + place, NONE)

    def forest(self, ids: np.ndarray) -> np.ndarray:
        """The merged ids of words of up to ids.shape[1] symbols, -1 where none is left; words are padded with -1."""
        n, size = ids.shape
        ids = np.concatenate([ids, np.full((n, 1), -1)], axis=1)
        after = np.broadcast_to(np.arange(1, size + 2), ids.shape).copy()
        after[:, size] = size
        before = np.broadcast_to(np.arange(-1, size), ids.shape).copy()
        tree = np.full((n, 2 * size), NONE)
        tree[:, size:] = self.leaf(ids[:, :-1], ids[:, 1:], np.arange(size)[None, :], size)
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        rows = np.arange(n)
        while True:
            rows = rows[tree[rows, 1] < NONE]
            if not len(rows):
                return np.where(ids[:, :-1] >= 0, ids[:, :-1], -1)
            rank, place = np.divmod(tree[rows, 1], size)
            gone = after[rows, place]
            then = after[rows, gone]
            ids[rows, place] = self.made[rank]
            ids[rows, gone] = -1
            after[rows, place] = then
            before[rows, then] = place
            prior = before[rows, place]
            has = prior >= 0
            changed = np.concatenate([rows, rows, rows[has]])
            leaves = np.concatenate([gone, place, prior[has]])
            tree[changed, size + leaves] = np.concatenate([
                np.full(len(rows), NONE),
                self.leaf(ids[rows, place], ids[rows, then], place, size),
                self.leaf(ids[rows[has], prior[has]], ids[rows[has], place[has]], prior[has], size),
            ])
            node = (size + leaves) >> 1
            while node[0]:
                tree[changed, node] = np.minimum(tree[changed, 2 * node], tree[changed, 2 * node + 1])
                node = node >> 1

    def encode(self, words: list[bytes], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids): ids of the words one after the other, counts[i] of them are word i's."""
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        raw = np.frombuffer(b"".join(words), np.uint8)
        flat = self.inner[raw]
        flat[starts[1:][lengths > 0] - 1] = self.last[raw[starts[1:][lengths > 0] - 1]]
        kept = np.full(len(flat), -1)
        size = 1
        while size < max(1, int(lengths.max(initial=0))) * 2:
            group = np.flatnonzero((lengths > size // 2) & (lengths <= size))
            step = max(1, most // size)
            for part in (group[i : i + step] for i in range(0, len(group), step)):
                places = np.arange(size)[None, :]
                inside = places < lengths[part, None]
                at = np.where(inside, starts[part, None] + places, 0)
                merged = self.forest(np.where(inside, flat[at], -1)) if size > 1 else flat[at]
                kept[at[inside]] = merged[inside]
            size *= 2
        return np.add.reduceat(np.append(kept >= 0, 0), starts[:-1]).astype(np.int64) * (lengths > 0) if len(words) else lengths, kept[kept >= 0]


class Codec:
    """Encodes and decodes texts by a JSON file of the tokenizers library that holds a byte-level BPE."""

    def __init__(self, model: str, most_words: int = 400_000):
        from tokenizers import Tokenizer

        spec = json.loads(model)
        bpe = spec["model"]
        if bpe["type"] != "BPE" or bpe.get("dropout") or bpe.get("byte_fallback") or bpe.get("ignore_merges"):
            raise ValueError("a plain BPE model is needed")
        self.library = Tokenizer.from_str(model)
        self.merges = Merges(bpe["vocab"], bpe["merges"], bpe.get("end_of_word_suffix") or "", bpe.get("continuing_subword_prefix") or "")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.names = np.array(["" for _ in range(max([*bpe["vocab"].values(), *added.values()]) + 1)], object)
        for name, i in (bpe["vocab"] | added).items():
            self.names[i] = name
        self.spaced = spec["decoder"] is None
        self.bytes = {c: b for b, c in byte_letters().items()}
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        simple = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["use_regex"]
        self.pattern = regex.compile(parts[0]["pattern"]["Regex"]) if simple else None
        self.most_words = most_words
        self.forget()
        self.added = added

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.written: list[str] = []
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def split(self, text: str) -> list[str]:
        """The words of a text, each special token as a word of its own name behind a 0 character."""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return [w for i, x in enumerate(parts) for w in (["\0" + x] if i % 2 else self.split(x))]
        if self.pattern and PLAIN.fullmatch(text):
            return self.pattern.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
        text = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        found = self.library.pre_tokenizer.pre_tokenize_str(text)
        return ["\1" + w for w, _ in found]

    def raw(self, word: str) -> bytes:
        return bytes(self.bytes[c] for c in word[1:]) if word[0] == "\1" else word.encode()

    def learn(self, new: list[str]) -> None:
        """Adds words to those whose ids are known."""
        plain = [w for w in new if w[0] != "\0"]
        special = [w for w in new if w[0] == "\0"]
        counts, ids = self.merges.encode([self.raw(w) for w in plain])
        counts = np.concatenate([counts, np.ones(len(special), np.int64)])
        ids = np.concatenate([ids, [self.added[w[1:]] for w in special]]).astype(np.int32)
        names, at = self.names[ids].tolist(), 0
        for w, n in zip(plain + special, counts.tolist(), strict=True):
            self.places[w] = len(self.written)
            self.written.append((" " if self.spaced else "").join(names[at : at + n]))
            at += n
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.cumsum(self.counts) - self.counts

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(counts, ids, decoded texts) of some texts."""
        if len(self.places) > self.most_words:
            self.forget()
        split = [self.split(x) for x in texts]
        if new := [w for w in dict.fromkeys(w for x in split for w in x) if w not in self.places]:
            self.learn(new)
        places = [list(map(self.places.__getitem__, x)) for x in split]
        flat = np.array([p for x in places for p in x], np.int64)
        if not len(flat):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.int32), ["" for _ in texts]
        n = self.counts[flat]
        ids = self.ids[np.repeat(self.starts[flat] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in places])])
        total = np.concatenate([[0], np.cumsum(n)])
        counts = total[ends[1:]] - total[ends[:-1]]
        if self.spaced:
            decoded = [" ".join(map(self.written.__getitem__, x)) for x in places]
        else:
            decoded = [self.unspaced("".join(map(self.written.__getitem__, x))) for x in places]
        return counts, ids, decoded

    def unspaced(self, letters: str) -> str:
        return b"".join(bytes([self.bytes[c]]) if c in self.bytes else c.encode() for c in letters).decode("utf-8", "replace")


def bpe_encode_decode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep_text: bool = True, batch_bytes: int = 1 << 20) -> DataFrame:
    """docs with `ids` (array of int), the text's tokens, and `decoded` (string), the text those ids decode to.

    tokenizer_path names the JSON file of a byte-level BPE of the tokenizers library; it is read on the driver and sent
    to the tasks. Ids are those of encode(text, add_special_tokens=False) without truncation or padding; special strings
    inside a text become their tokens, which decoding keeps. Without a decoder in the file, decoding joins the tokens'
    names by one blank, as the library does. Null encodes as an empty text: no ids, decoded "". Every row keeps its other
    columns (and the text, unless keep_text is false) and repeated rows stay; a column of the result's names is replaced. Tasks remember the ids of the words they
    met, a bounded number; a batch holds about batch_bytes bytes of text, or one longer text.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    carried = [f for f in docs.schema.fields if f.name not in (ids, decoded) and (keep_text or f.name != text)]
    schema = T.StructType([*carried, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            column = batch.column(0)
            offsets, _ = text_bytes(column)
            for i, j in blocks(offsets, batch_bytes):
                counts, found, back = codec.batch([x or "" for x in column.slice(i, j - i).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(found))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), lists, pa.array(back, pa.string())], names=[f.name for f in schema.fields])

    return docs.select(F.col(text).alias("_text"), *(F.col(f"`{f.name}`") for f in carried)).mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), keep_text=False)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
