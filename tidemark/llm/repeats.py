"""What suffix-array and substring deduplication share: documents dealt into chunks, and the exchange that tells a chunk which
of its windows can repeat at all.

A chunk is a few MB of documents, by a hash of key and text, so that neither long texts nor clustered, equal or null keys
make a large one. Chunks never exchange texts whole. Every window has a minimizer, the least hash of the shorter runs in it;
equal windows have equal minimizers, so a window can only repeat if its minimizer is met in two documents. Neighbouring
windows with one minimizer form a segment. A value leaves a chunk once however many documents of it have it, so no value is
hotter than the number of chunks, and values are dealt to parts by hash. The documents' one exchange is reused by every pass.
Where all windows of a text that an earlier document has as a whole are known to repeat, it can be left out of all later mail,
which then doesn't grow with copies (see Exchange.minimizers).
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, byte_table, mixed, partitions, text_bytes, word_hashes, words

#: Text of a chunk: the first, or as much as makes so many chunks, up to the last.
CHUNK_BYTES, CHUNKS, LARGE_CHUNK = 4 << 20, 1 << 14, 16 << 20
#: Text whose values one part of an exchange answers for.
PART_BYTES = 64 << 20
#: A minimizer that more chunks than this have is hot: its segments are not gathered in one part.
HOT = 256
MAIL = "p long, chunk long, kind string, data binary"
STATE = "state"


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of consecutive numbers in a sorted array."""
    if not len(places):
        return places, places
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    starts = np.concatenate([[0], cut])
    return places[starts], np.diff(np.append(starts, len(places)))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers in some runs, one run after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


@dataclass(frozen=True)
class Setting:
    """unit: `bytes` or `words`; width: of a window; anchor: of the runs whose least hash is the minimizer."""

    unit: str
    width: int
    anchor: int


class Chunk:
    """The documents of one chunk in order of key, and their symbols as one sequence."""

    def __init__(self, rows: pa.Table, setting: Setting, seed: int = 7):
        order = pc.sort_indices(rows, [("key", "ascending"), ("text", "ascending")])
        self.rows, self.setting = rows.take(order).combine_chunks(), setting
        self.offsets, self.raw = text_bytes(self.rows.column("text"))
        keys = self.rows.column("key")
        self.real = ~keys.is_null().to_numpy(zero_copy_only=False)
        self.keys = keys.fill_null(0).to_numpy().astype(np.int64)
        if setting.unit == "words":
            self.starts, self.ends, self.first = words(self.raw, self.offsets)
            self.symbols = self.word_symbols(seed)
        else:
            self.first = self.offsets
            self.table = byte_table(seed)
        self.n = int(self.first[-1])

    def word_symbols(self, seed: int, step: int = 1 << 16) -> np.ndarray:
        out = np.zeros(len(self.starts), np.uint64)
        for i in range(0, len(out), step):
            a, b = self.starts[i : i + step], self.ends[i : i + step]
            out[i : i + step] = word_hashes(self.raw[a[0] : b[-1]], a - a[0], b - a[0], seed)
        return out

    def part(self, a: int, b: int) -> np.ndarray:
        return self.symbols[a:b] if self.setting.unit == "words" else self.table[self.raw[a:b]]

    def valid(self) -> np.ndarray:
        """Starts of the windows that lie within one document with a key."""
        fits = np.maximum(np.diff(self.first) - self.setting.width + 1, 0) * self.real
        return spread(self.first[:-1], fits)

    def key_at(self, places: np.ndarray) -> np.ndarray:
        """The keys of the documents that some symbols lie in."""
        return self.keys[np.searchsorted(self.first, places, "right") - 1]

    def minimizers(self, starts: np.ndarray, step: int = 1 << 18) -> np.ndarray:
        """Of the windows at some sorted starts."""
        width, anchor = self.setting.width, self.setting.anchor
        out = np.zeros(len(starts), np.uint64)
        at = np.searchsorted(starts, np.arange(0, self.n + step, step))
        for k, a in enumerate(range(0, self.n, step)):
            i, j = at[k], at[k + 1]
            if i == j:
                continue
            low = int(starts[i])
            least = Rolling(self.part(low, int(starts[j - 1]) + width)).windows(anchor)
            span, want = 1, width - anchor + 1
            while 2 * span <= want:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < want:
                least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
            out[i:j] = least[starts[i:j] - low]
        return out

    def hashes(self, starts: np.ndarray, lengths: np.ndarray, step: int = 1 << 18) -> np.ndarray:
        """Of the runs of symbols at some sorted starts."""
        out = np.zeros(len(starts), np.uint64)
        at = np.searchsorted(starts, np.arange(0, self.n + step, step))
        for k in range(len(at) - 1):
            i, j = at[k], at[k + 1]
            if i == j:
                continue
            low, ends = int(starts[i]), starts[i:j] + lengths[i:j]
            out[i:j] = Rolling(self.part(low, int(ends.max()))).of(starts[i:j] - low, ends - low)
        return out

    def windows_like(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, which): the windows of documents with a key that equal one at some places, and which of these."""
        width = self.setting.width
        starts = self.valid()
        if not len(places) or not len(starts):
            return starts[:0], starts[:0]
        order = np.argsort(places, kind="stable")
        known = self.hashes(places[order], np.full(len(places), width))
        by_hash = np.argsort(known, kind="stable")
        own = self.hashes(starts, np.full(len(starts), width))
        at = np.minimum(np.searchsorted(known[by_hash], own), len(known) - 1)
        same = known[by_hash][at] == own
        return starts[same], order[by_hash][at[same]]

    def copies(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(documents, which text each has, the first document of each text, 128-bit digests of these texts) of the documents
        with a key and a window; as the documents are in order of key, the first has the least."""
        some = np.flatnonzero(self.real & (np.diff(self.first) >= self.setting.width))
        data = b"".join(hashlib.blake2b(self.raw[self.offsets[i] : self.offsets[i + 1]], digest_size=16).digest() for i in some.tolist())
        digests = np.frombuffer(data, np.uint64).reshape(-1, 2)
        which, first = grouped(digests[:, 0], digests[:, 1], some)
        return some, which, some[first], digests[first]

    def leave(self, copies: np.ndarray) -> np.ndarray:
        """Leaves out the documents of some bits: they have no windows from now on. The starts of those that they had."""
        gone = np.unpackbits(copies, count=len(self.real)) > 0
        self.real &= ~gone
        docs = np.flatnonzero(gone)
        return spread(self.first[docs], self.first[docs + 1] - self.first[docs] - self.setting.width + 1)

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, counts of windows, minimizers) of the runs of consecutive windows of one document and minimizer."""
        starts = self.valid()
        least = self.minimizers(starts)
        if not len(starts):
            return starts, starts, least
        cut = np.flatnonzero((np.diff(starts) != 1) | (least[1:] != least[:-1])) + 1
        begin = np.concatenate([[0], cut])
        return starts[begin], np.diff(np.append(begin, len(starts))), least[begin]


def grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, first row of each group) of rows that agree in all columns but the last, which ranks them."""
    order = np.lexsort(columns[::-1])
    n = len(order)
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in columns[:-1]:
            new[1:] |= c[order][1:] != c[order][:-1]
    number = np.zeros(n, np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def parts_of(values: np.ndarray, parts: int) -> np.ndarray:
    """The part that answers for each value, by its high bits."""
    return ((values >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def dealt(part: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order, [(part, from, to)]): rows in order of their parts, and the range of each part that has some."""
    order = np.argsort(part, kind="stable")
    there, begin = np.unique(part[order], return_index=True)
    return order, list(zip(there.tolist(), begin.tolist(), np.append(begin, len(part))[1:].tolist(), strict=True))


def low(values: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_low(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.view(np.uint64).ravel()


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers, their first bytes together, then their second bytes, and so on: small numbers compress well."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def short(values: np.ndarray) -> np.ndarray:
    """Numbers of zero or more in the least type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


class Mail:
    """Rows to other tasks."""

    def __init__(self, chunk: int):
        self.chunk, self.rows = chunk, []

    def add(self, p: int, kind: str, data: bytes) -> None:
        self.rows.append((p, self.chunk, kind, data))

    def state(self, parts: int, **arrays) -> None:
        """What the chunk's own next pass needs, by way of some part."""
        self.add(self.chunk % parts, STATE, pickle.dumps(arrays))

    def table(self) -> pa.Table:
        p, chunk, kind, data = zip(*self.rows, strict=True) if self.rows else ((), (), (), ())
        return pa.table({"p": pa.array(p, pa.int64()), "chunk": pa.array(chunk, pa.int64()), "kind": pa.array(kind, pa.string()), "data": pa.array(data, pa.binary())})


def received(rows: pa.Table) -> tuple[dict[int, bytes], dict]:
    """(data by part, state)."""
    data, state = {}, {}
    for p, kind, x in zip(rows.column("p").to_pylist(), rows.column("kind").to_pylist(), rows.column("data").to_pylist(), strict=True):
        if kind == STATE:
            state = pickle.loads(x)
        else:
            data[p] = x
    return data, state


def answers(part: np.ndarray, parts: int, data: dict[int, bytes], dtype) -> np.ndarray:
    """What the parts said of rows that were dealt to them."""
    order, cuts = dealt(part, parts)
    out = np.zeros(len(part), dtype)
    for p, a, b in cuts:
        out[order[a:b]] = np.frombuffer(data[p], dtype)
    return out


def resolver(answer: Callable[[list[bytes]], list[bytes]]) -> Callable[[pa.Table], pa.Table]:
    """Answers the mail of one part: answer gives a reply to each of the chunks' data; states pass by."""

    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("p")[0].as_py() if rows.num_rows else 0
        out, chunks, data = [], [], []
        for c, k, x in zip(rows.column("chunk").to_pylist(), rows.column("kind").to_pylist(), rows.column("data").to_pylist(), strict=True):
            if k == STATE:
                out.append((part, c, k, x))
            else:
                chunks.append(c)
                data.append(x)
        out += [(part, c, "answer", x) for c, x in zip(chunks, answer(data) if data else [], strict=True)]
        mail = Mail(0)
        mail.rows = out
        return mail.table()

    return run


def minimizer_chunks(data: list[bytes]) -> list[bytes]:
    """Of each minimizer, a byte: 0 if one chunk has it, 1 if several have, 2 if it is hot."""
    counts = [len(x) // 5 for x in data]
    values = np.concatenate([from_low(x, 5) for x in data])
    order = np.argsort(values)
    new = np.append(True, values[order][1:] != values[order][:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(values)))
    answer = np.zeros(len(values), np.uint8)
    answer[order] = np.repeat(np.where(size > HOT, 2, np.where(size > 1, 1, 0)).astype(np.uint8), size)
    edges = np.concatenate([[0], np.cumsum(counts)])
    return [answer[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def text_answers(data: list[bytes]) -> list[bytes]:
    """Of each text, a byte: 1 if another chunk has it in a document with a smaller key."""
    counts = [len(x) // 24 for x in data]
    digests = np.frombuffer(b"".join(x[: 16 * n] for x, n in zip(data, counts, strict=True)), np.uint64).reshape(-1, 2)
    keys = np.concatenate([np.cumsum(from_planes(x[16 * n :])) for x, n in zip(data, counts, strict=True)])
    which, first = grouped(digests[:, 0], digests[:, 1], keys)
    answer = (keys[first][which] < keys).astype(np.uint8)
    edges = np.concatenate([[0], np.cumsum(counts)])
    return [answer[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def number(table: pa.Table) -> int:
    return table.column("chunk")[0].as_py()


def candidates(chunk: Chunk, got: pa.Table, parts: int, cut: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, counts, minimizers, hot) of the segments whose minimizer several documents have. cut: all segments, if known."""
    begin, count, own = cut or chunk.segments()
    values, which = np.unique(own, return_inverse=True)
    said = answers(parts_of(values, parts), parts, received(got)[0], np.uint8)
    keys = chunk.key_at(begin) if len(begin) else begin
    lowest, highest = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), np.iinfo(np.int64).min)
    np.minimum.at(lowest, which, keys)
    np.maximum.at(highest, which, keys)
    keep = ((said > 0) | (lowest < highest))[which] if len(begin) else np.zeros(0, bool)
    return begin[keep], count[keep], own[keep], (said == 2)[which][keep] if len(begin) else keep


class Exchange:
    """The documents in chunks, and passes over them that meet mail: a pass reads each chunk once with what came for it."""

    def __init__(self, docs: DataFrame, key: str, text: str, carry: list[str], setting: Setting):
        self.setting = setting
        self.rows, self.parts = in_chunks(docs, key, text, carry)
        self.groups = self.rows.groupBy("chunk")

    def asked(self, mail: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
        return mail.groupBy("p").applyInArrow(resolver(answer), MAIL)

    def met(self, mail: DataFrame, run: Callable[[Chunk, int, pa.Table], pa.Table], schema) -> DataFrame:
        """run(chunk, its number, its mail) of every chunk."""
        setting = self.setting

        def both(table: pa.Table, got: pa.Table) -> pa.Table:
            return run(Chunk(table, setting), number(table), got)

        return self.groups.cogroup(mail.groupBy("chunk")).applyInArrow(both, schema)

    def minimizers(self, copies: bool = True) -> DataFrame:
        """Mail that tells each chunk of its minimizers (see minimizer_chunks). Without copies, its state has as `copies` a bit
        for each document, whether one with a smaller key has the same text; those that have are left out."""
        setting, parts = self.setting, self.parts

        def told(chunk: Chunk, own: int, **state) -> pa.Table:
            mail = Mail(own)
            values = np.unique(chunk.segments()[2])
            order, cuts = dealt(parts_of(values, parts), parts)
            for p, a, b in cuts:
                mail.add(p, "minimizers", low(values[order[a:b]], 5))
            if state:
                mail.state(parts, **state)
            return mail.table()

        def first_told(chunk: Chunk, own: int, got: pa.Table) -> pa.Table:
            docs, which, first, digests = chunk.copies()
            said = answers(parts_of(digests[:, 0], parts), parts, received(got)[0], np.uint8)
            gone = np.zeros(len(chunk.keys), bool)
            gone[docs] = (said > 0)[which] | (chunk.keys[first][which] < chunk.keys[docs])
            chunk.leave(bits := np.packbits(gone))
            return told(chunk, own, copies=bits)

        def send(table: pa.Table) -> pa.Table:
            return told(Chunk(table, setting), number(table))

        return self.asked(self.groups.applyInArrow(send, MAIL) if copies else self.met(self.texts(), first_told, MAIL), minimizer_chunks)

    def texts(self) -> DataFrame:
        """Mail that tells each chunk of its texts (see text_answers)."""
        setting, parts = self.setting, self.parts

        def send(table: pa.Table) -> pa.Table:
            chunk, mail = Chunk(table, setting), Mail(number(table))
            _, _, first, digests = chunk.copies()
            order, cuts = dealt(parts_of(digests[:, 0], parts), parts)
            for p, a, b in cuts:
                some = order[a:b]
                mail.add(p, "texts", digests[some].tobytes() + planes(np.diff(chunk.keys[first[some]], prepend=0)))
            return mail.table()

        return self.asked(self.groups.applyInArrow(send, MAIL), text_answers)


def in_chunks(docs: DataFrame, key: str, text: str, carry: list[str]) -> tuple[DataFrame, int]:
    """(rows (chunk, key, text, carry), number of parts). The driver sees the sum of the texts' bytes."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *(F.col(f"`{c}`").alias(f"c_{c}") for c in carry))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = max(CHUNK_BYTES, min(LARGE_CHUNK, total // CHUNKS))
    count = max(-(-total // size), partitions(spark))
    chunk = F.pmod(F.xxhash64("key", "text"), F.lit(count))
    return rows.select(chunk.alias("chunk"), "*"), max(partitions(spark), -(-total // (PART_BYTES // CHUNK_BYTES * size)))


def covered(chunk: Chunk, starts: np.ndarray) -> np.ndarray:
    """Which symbols lie in a window at some starts."""
    change = np.zeros(chunk.n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + chunk.setting.width, -1)
    return np.cumsum(change)[:-1] > 0


def second_prints(chunk: Chunk) -> Rolling:
    """Hashes of runs of words that share nothing with those of Chunk.symbols."""
    return Rolling(mixed(chunk.word_symbols(1013) ^ np.uint64(0x5851F42D4C957F2D)))
