"""Language-model scores: a log-bilinear neural model trained in numpy by noise-contrastive estimation, and an add-one
unigram base.

The predicted vector of the next word is a sum over the two words before it of their vectors, weighted by position; its
product with a word's vector plus the word's bias is the word's score. Words of like frequency form bins; a bin has a score
of the same kind, and scores are normalised over the bins and over the words of a bin by batched matrix products. The
vocabulary is the words of the corpus above a count, the end of a text, and one class for all other words, among which a
word has its add-one share of that class.

Texts are dealt to rounds and shards by a hash of themselves and their keys. The shards of a round all start from the same
weights, each learns from its texts in a fixed order, and their changes are averaged before the next round; so the model
depends on the texts alone, not on how a table is partitioned, stored or sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, checkpointed, lower_bytes, partitions, table, text_bytes, word_hashes, words
from .language_id import held_out
from .repeats import answers, dealt, parts_of

END = np.uint64(0x5851F42D4C957F2D)
#: Text whose distinct words one part counts and answers for.
PART_BYTES = 256 << 20


@dataclass(frozen=True)
class Training:
    """How a model is made. Words that occur `often` times, or as often as the root of the number of training tokens divided
    by `share`, are in the vocabulary, which so grows with the root of the corpus and is what the driver holds; in any case
    the `least` most frequent words are. A shard has `shard` bytes of text, or more if there were over `shards` of them, up
    to `large`."""

    often: int = 20
    share: int = 50
    least: int = 1021
    size: int = 16
    noise: int = 64
    batch: int = 1024
    rate: float = 0.2
    rounds: int = 4
    shard: int = 16 << 20
    shards: int = 1 << 12
    large: int = 256 << 20

    def threshold(self, tokens: int) -> int:
        return max(self.often, int(tokens**0.5 / self.share))

    def shards_of(self, size: int) -> int:
        """Shards of a round, for texts of so many bytes."""
        return max(1, round(size / self.rounds / max(self.shard, min(self.large, size // self.shards))))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the tokens of some texts, words in lower case and an end behind each text; first[i] is the number
    of tokens before text i."""
    lower = lower_bytes()[raw]
    starts, ends, first = words(lower, offsets)
    n = np.diff(first)
    out = np.full(len(starts) + len(n), END, np.uint64)
    first = first + np.arange(len(first))
    inner = np.ones(len(out), bool)
    inner[first[1:] - 1] = False
    out[inner] = word_hashes(lower, starts, ends)
    return out, first


def token_blocks(column, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, first) of blocks of an Arrow column of texts."""
    offsets, raw = text_bytes(column)
    for i, j in blocks(offsets, most):
        yield i, *tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(values, return_inverse=True)
    return distinct, np.bincount(which, counts, len(distinct)).astype(np.int64)


def corpus_counts(training: DataFrame, parts: int, most: int = 1 << 20) -> DataFrame:
    """(p, n, kinds, words, counts): of each part the tokens and the distinct words of all training texts, and these words
    with their counts as packed numbers, sorted. Words are counted within a task before they are sent; a task holds up to
    `most` of them at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            order, cuts = dealt(parts_of(values, parts), parts)
            data = [values[order[a:b]].tobytes() + counts[order[a:b]].tobytes() for _, a, b in cuts]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in cuts], pa.int64()), pa.array(data, pa.binary())], names=["p", "data"])

        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, found, _ in token_blocks(batch.column(0)):
                found, n = np.unique(found, return_counts=True)
                values, counts = summed(np.concatenate([values, found]), np.concatenate([counts, n]))
                if len(values) > most:
                    yield sent(values, counts)
                    values, counts = values[:0], counts[:0]
        if len(values):
            yield sent(values, counts)

    def add(rows: pa.Table) -> pa.Table:
        data = [x.as_py() for x in rows.column("data")]
        values = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 16) for x in data])
        counts = np.concatenate([np.frombuffer(x, np.int64, len(x) // 16, len(x) // 2) for x in data])
        values, counts = summed(values, counts)
        return pa.table({"p": [rows.column("p")[0].as_py()], "n": [int(counts.sum())], "kinds": [len(values)], "words": pa.array([values.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    return training.mapInArrow(count, "p long, data binary").groupBy("p").applyInArrow(add, "p long, n long, kinds long, words binary, counts binary")


def frequent(counted: DataFrame, threshold: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the words that occur `threshold` times, or of the `least` most frequent ones if fewer do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, c in zip(batch.column(0), batch.column(1), strict=True):
                values, counts = np.frombuffer(w.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64)
                top = chosen(values, counts, threshold, least)
                yield pa.RecordBatch.from_arrays([pa.array(values[top].view(np.int64)), pa.array(counts[top])], names=["word", "n"])

    found = counted.select("words", "counts").mapInArrow(run, "word long, n long").toArrow()
    values, counts = (found.column(c).to_numpy().astype(np.int64) for c in ("word", "n"))
    values = values.view(np.uint64)
    top = chosen(values, counts, threshold, least)
    top = top[np.argsort(values[top])]
    return values[top], counts[top]


def chosen(values: np.ndarray, counts: np.ndarray, threshold: int, least: int) -> np.ndarray:
    """Places of the words of a vocabulary, the most frequent first."""
    order = np.lexsort((values, -counts))
    return order[: max(least, int((counts >= threshold).sum()))]


class Model:
    """Log-bilinear model over classes: 0 to k - 1 are words, k is any other word; k + 1 stands before a text."""

    CONTEXT = 2

    def __init__(self, vocabulary: np.ndarray, share: np.ndarray, how: Training, seed: int = 3):
        """vocabulary: sorted hashes of the words; share: of each class in the training tokens."""
        self.vocabulary, self.k, self.how = vocabulary, len(vocabulary), how
        rng = np.random.default_rng(seed)
        scale = 0.3 / np.sqrt(how.size)
        self.share = np.maximum(share, 1e-9)
        # bins of equal sums of roots of shares, from the most frequent on: the cheapest for scoring
        self.order = np.argsort(-self.share, kind="stable")
        roots = np.cumsum(np.sqrt(self.share[self.order]))
        found = np.unique(np.minimum((roots - roots[0]).astype(np.int64), int(roots[-1])), return_inverse=True)[1]
        self.edges = np.concatenate([[0], np.flatnonzero(np.diff(found)) + 1, [len(found)]])
        self.bin = np.empty(self.k + 1, np.int64)
        self.bin[self.order] = found
        self.bin_share = np.bincount(self.bin, self.share)
        self.tables = None
        self.weights = {
            "before": rng.normal(0, scale, (self.k + 2, how.size)).astype(np.float32),
            "next": rng.normal(0, scale, (self.k + 1, how.size)).astype(np.float32),
            "place": np.ones((self.CONTEXT, how.size), np.float32),
            "bias": np.log(self.share).astype(np.float32)[:, None],
            "bins": rng.normal(0, scale, (len(self.bin_share), how.size)).astype(np.float32),
            "bin_bias": np.log(self.bin_share).astype(np.float32)[:, None],
        }
        #: Sums of squares of what has changed each row, which slow its next changes.
        self.past = {name: np.full(len(w), 1e-4, np.float32) for name, w in self.weights.items()}

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, hashes)
        return np.where(self.vocabulary[np.minimum(at, self.k - 1)] == hashes, at, self.k) if self.k else np.zeros(len(hashes), np.int64)

    def contexts(self, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class before each token and the one before that."""
        one, two = np.full(len(classes), self.k + 1), np.full(len(classes), self.k + 1)
        one[1:], two[2:] = classes[:-1], classes[:-2]
        begin = first[:-1]
        one[begin] = self.k + 1
        two[begin] = self.k + 1
        second = begin + 1
        second = second[second < first[1:]]
        two[second] = self.k + 1
        return one, two

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        """One batch of noise-contrastive estimation of words and of bins; its noise words serve all of its tokens. Only
        the rows that it meets are changed."""
        w, n = self.weights, len(target)
        vectors = (w["before"][one], w["before"][two])
        predicted = vectors[0] * w["place"][0] + vectors[1] * w["place"][1]
        back, changes = 0, []
        for name, bias, share, cumulative, real_row in (("next", "bias", self.share, self.cumulative, target), ("bins", "bin_bias", self.bin_share, self.bin_cumulative, self.bin[target])):
            noise = np.searchsorted(cumulative, rng.random(self.how.noise)).clip(0, len(share) - 1)
            chance = self.chances[name]
            truth, lie = w[name][real_row], w[name][noise]
            real = np.einsum("ij,ij->i", predicted, truth) + w[bias][real_row, 0] - chance[real_row]
            false = predicted @ lie.T + (w[bias][noise, 0] - chance[noise])
            with np.errstate(over="ignore"):  # to infinity, and so to a share of 0
                up = 1 / (1 + np.exp(real))
                down = np.exp(np.negative(false, out=false), out=false)
            down += 1
            np.divide(-1, down, out=down)
            back = back + up[:, None] * truth + down @ lie
            grad = np.empty((n + len(noise), predicted.shape[1] + 1), np.float32)
            grad[:n, :-1], grad[n:, :-1] = up[:, None] * predicted, down.T @ predicted
            grad[:n, -1], grad[n:, -1] = up, down.sum(axis=0)
            rows, times, grad = summed_rows(np.concatenate([real_row, noise]), grad)
            changes += [(name, rows, times, grad[:, :-1]), (bias, rows, times, grad[:, -1:])]
        place = np.stack([(back * vectors[0]).sum(axis=0), (back * vectors[1]).sum(axis=0)])
        changes.append(("place", np.arange(self.CONTEXT), n, place))
        changes.append(("before", *summed_rows(np.concatenate([one, two]), np.concatenate([back * w["place"][0], back * w["place"][1]]))))
        for name, rows, times, g in changes:
            g = g / n
            past = self.past[name][rows] + (g * g).mean(axis=1)
            self.past[name][rows] = past
            w[name][rows] += self.how.rate * g / np.sqrt(past)[:, None]
            if name in self.met:
                self.met[name][rows] += times

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], seed: int) -> int:
        """Learns from (classes, first) of blocks of texts; the number of tokens."""
        self.cumulative = np.cumsum(self.share / self.share.sum())
        self.bin_cumulative = np.cumsum(self.bin_share / self.bin_share.sum())
        self.met = {"before": np.zeros(self.k + 2, np.float32), "next": np.zeros(self.k + 1, np.float32)}
        self.chances = {name: np.log(share * self.how.noise).astype(np.float32) for name, share in (("next", self.share), ("bins", self.bin_share))}
        self.tables = None
        rng, n = np.random.default_rng(seed), 0
        for target, first in batches:
            one, two = self.contexts(target, first)
            order = rng.permutation(len(target))
            for i in range(0, len(order), self.how.batch):
                some = order[i : i + self.how.batch]
                self.step(one[some], two[some], target[some], rng)
            n += len(target)
        return n

    def ready(self) -> None:
        """Tables for scoring: what the words before add to the prediction, and the words' vectors in the order of bins."""
        w = self.weights
        rank = np.empty(self.k + 1, np.int64)
        rank[self.order] = np.arange(self.k + 1)
        self.tables = (w["before"] * w["place"][0], w["before"] * w["place"][1], w["next"][self.order], w["bias"][self.order, 0], rank)

    def score(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 probability of each token's class: of its bin, normalised once for each pair of words before, and of the
        word within the bin."""
        if self.tables is None:
            self.ready()
        near, far, following, bias, rank = self.tables
        w, own, at = self.weights, self.bin[target], rank[target]
        pairs, which = np.unique(one * (self.k + 2) + two, return_inverse=True)
        order = np.argsort(which, kind="stable")
        predicted = near[pairs // (self.k + 2)] + far[pairs % (self.k + 2)]
        out = np.empty(len(target))
        out[order] = log_shares(predicted, w["bins"], w["bin_bias"][:, 0], which[order], own[order])
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(len(self.bin_share) + 1))
        for c in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(self.edges) > 1)):
            low, high = self.edges[c], self.edges[c + 1]
            tokens = order[cuts[c] : cuts[c + 1]]
            out[tokens] += log_shares(near[one[tokens]] + far[two[tokens]], following[low:high], bias[low:high], np.arange(len(tokens)), at[tokens] - low)
        return out / np.log(10)


def log_shares(predicted: np.ndarray, vectors: np.ndarray, bias: np.ndarray, row: np.ndarray, column: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """log of the softmax over vectors of the predicted rows, at (row, column); row is sorted. By pieces that stay in a
    processor's cache."""
    out, step, turned, ones = np.empty(len(row)), max(1, most // len(bias)), np.ascontiguousarray(vectors.T), np.ones(len(bias), np.float32)
    cuts = np.searchsorted(row, np.arange(0, len(predicted) + step, step))
    room = np.empty((min(step, len(predicted)), len(bias)), np.float32)
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = predicted[i * step : (i + 1) * step]
        scores = np.matmul(part, turned, out=room[: len(part)])
        scores += bias
        here = row[a:b] - i * step
        found = scores[here, column[a:b]]
        if scores.max(initial=0) > 60:  # beyond what sums of exponentials of this precision bear
            scores -= (top := scores.max(axis=1))[:, None]
        else:
            top = np.zeros(1, np.float32)
        np.exp(scores, out=scores)
        out[a:b] = found - (np.log(scores @ ones) + top)[here]
    return out


def summed_rows(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, how often each is there, sums of their values)."""
    order = np.argsort(rows.astype(np.uint32), kind="stable")
    rows = rows[order]
    begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return rows[begin], np.diff(np.append(begin, len(rows))), np.add.reduceat(values[order], begin)


#: Weights whose rows the shards meet in part, and those that every shard changes.
ROWS, REST = ("before", "next"), ("place", "bins", "bin_bias")


def changed(model: Model, start: Model) -> np.ndarray:
    """What a shard sends of the rows that it met: row, how often, change of weights and bias, sums of squares of both."""
    size, k = model.how.size, model.k
    out = np.zeros(sum(int((model.met[n] > 0).sum()) for n in ROWS), row_type(size))
    at = 0
    for n, base in zip(ROWS, (0, k + 2), strict=True):
        rows = np.flatnonzero(model.met[n])
        part = out[at : at + len(rows)]
        part["row"], part["met"] = rows + base, model.met[n][rows]
        part["change"][:, :size] = model.weights[n][rows] - start.weights[n][rows]
        part["past"][:, 0] = model.past[n][rows] - start.past[n][rows]
        if n == "next":
            part["change"][:, size:] = model.weights["bias"][rows] - start.weights["bias"][rows]
            part["past"][:, 1] = model.past["bias"][rows] - start.past["bias"][rows]
        at += len(rows)
    return out


def row_type(size: int) -> np.dtype:
    return np.dtype([("row", np.int32), ("met", np.float32), ("change", np.float32, size + 1), ("past", np.float32, 2)])


def apply(model: Model, found: np.ndarray) -> None:
    """Adds averaged changes (see changed) to a model."""
    size, k = model.how.size, model.k
    for n, base, end in (("before", 0, k + 2), ("next", k + 2, 2 * k + 3)):
        x = found[(found["row"] >= base) & (found["row"] < end)]
        rows = x["row"] - base
        model.weights[n][rows] += x["change"][:, :size]
        model.past[n][rows] += x["past"][:, 0]
        if n == "next":
            model.weights["bias"][rows] += x["change"][:, size:]
            model.past["bias"][rows] += x["past"][:, 1]


def encoded(rows: DataFrame, model, shards: int) -> DataFrame:
    """(shard, mark, classes) of texts (mark, text): the class of each token, dealt by the text's mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for i, hashes, first in token_blocks(batch.column(1)):
                kinds = own.classes(hashes).astype(np.uint16 if own.k < 1 << 16 else np.uint32)
                data = [kinds[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                mark = batch.column(0).slice(i, len(data))
                shard = pa.array((mark.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) >> np.uint64(16)) % np.uint64(shards)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([shard, mark, pa.array(data, pa.binary())], names=["shard", "mark", "classes"])

    return rows.mapInArrow(run, "shard long, mark long, classes binary")


def learner(sent, turn: int, parts: int):
    """Learns from one shard in one turn, from the weights sent; what it changed, in groups of rows."""

    def learn(rows: pa.Table) -> pa.Table:
        import copy

        start, shard = sent.value, rows.column("shard")[0].as_py()
        own = copy.deepcopy(start)
        order = sorted(range(rows.num_rows), key=lambda i, m=rows.column("mark").to_pylist(): m[i])
        kind = np.uint16 if own.k < 1 << 16 else np.uint32
        texts = [np.frombuffer(x.as_buffer(), kind) for x in rows.column("classes").combine_chunks().take(pa.array(order))]
        first = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, first[-1], 1 << 18)), len(texts)))
        blocks_ = ((np.concatenate(texts[a:b]).astype(np.int64), first[a : b + 1] - first[a]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        n = own.train(blocks_, 1000 * turn + shard)
        found = changed(own, start)
        flat = np.concatenate([x for name in REST for x in ((own.weights[name] - start.weights[name]).ravel(), own.past[name] - start.past[name])]).astype(np.float64) * n
        data = [found[found["row"] % parts == g].tobytes() for g in range(parts)] + [flat.tobytes()]
        g = [*range(parts), -1 - shard % 16]
        return pa.table({"g": pa.array(g, pa.int64()), "shard": pa.array([shard] * len(g), pa.int64()), "n": pa.array([0] * parts + [n], pa.int64()), "data": pa.array(data, pa.binary())})

    return learn


def adder(size: int):
    """Averages what shards changed of one group of rows."""

    def add(rows: pa.Table) -> pa.Table:
        g = rows.column("g")[0].as_py()
        order = np.argsort(rows.column("shard").to_numpy(), kind="stable")
        data = [rows.column("data")[i].as_buffer() for i in order.tolist()]
        if g < 0:
            out = sum(np.frombuffer(x, np.float64) for x in data)
        else:
            found = np.concatenate([np.frombuffer(x, row_type(size)) for x in data])
            values = np.column_stack([found["change"] * found["met"][:, None], found["past"] * found["met"][:, None], found["met"]])
            at, _, sums = summed_rows(found["row"], values) if len(found) else (found["row"], 0, values)
            out = np.zeros(len(at), row_type(size))
            out["row"], out["met"] = at, sums[:, -1]
            out["change"], out["past"] = sums[:, : size + 1] / sums[:, -1:], sums[:, size + 1 : -1] / sums[:, -1:]
        return pa.table({"g": pa.array([g], pa.int64()), "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})

    return add


def train_model(training: DataFrame, vocabulary: np.ndarray, share: np.ndarray, size: int, how: Training) -> Model:
    """A model of all training texts (text and what else tells rows apart, so that copies of a text lie in different shards),
    of `size` bytes. Each text is learned from once, in its round and shard. A word's
    changes are averaged by how often the shards met it, the rest by their numbers of tokens. A shard sends the words that it
    met only, and shards are dealt to more partitions than there are shards, so that few tasks have two. The common start is made of the corpus-wide counts alone."""
    model = Model(vocabulary, share, how)
    if not model.k:
        return model
    spark = training.sparkSession
    marked = training.select(F.xxhash64(*training.columns).alias("mark"), "text")
    shards, parts = how.shards_of(size), partitions(spark)
    for r in range(how.rounds):
        sent = spark.sparkContext.broadcast(model)

        mine = marked.where(F.pmod("mark", F.lit(how.rounds)) == r)
        changes = encoded(mine, sent, shards).repartition(4 * shards, "shard").groupBy("shard").applyInArrow(learner(sent, r, parts), "g long, shard long, n long, data binary")
        found = sorted(changes.groupBy("g").applyInArrow(adder(how.size), "g long, n long, data binary").toArrow().to_pylist(), key=lambda x: x["g"])
        n = sum(x["n"] for x in found)
        if n:
            flat = sum(np.frombuffer(x["data"], np.float64) for x in found if x["g"] < 0) / n
            for name in REST:
                for held in (model.weights[name], model.past[name]):
                    held += flat[: held.size].reshape(held.shape).astype(np.float32)
                    flat = flat[held.size :]
            for x in found:
                if x["g"] >= 0:
                    apply(model, np.frombuffer(x["data"], row_type(how.size)))
    return model


def learned_model(training: DataFrame, counted: DataFrame, size: int, how: Training) -> tuple[Model, np.ndarray, int, int]:
    """(model, counts of its vocabulary, tokens, distinct tokens) of training texts and their corpus_counts."""
    total, kinds = (int(x or 0) for x in counted.agg(F.sum("n"), F.sum("kinds")).first())
    vocabulary, counts = frequent(counted, how.threshold(total), how.least)
    share = np.append(counts, total - int(counts.sum()) + 1) / (total + 1)
    return train_model(training, vocabulary, share, size, how), counts, total, kinds


SCORED = "key long, held_out boolean, n_tokens long, n_known long, base double, score double, rare binary"
MAIL = "p long, chunk long, data binary"


def scored(docs: DataFrame, model, counts, total: int) -> DataFrame:
    """(key, held_out, n_tokens, n_known, base, score, rare) of docs (key, text, learn): sums over the words of the vocabulary,
    and the hashes of all other words. Each row is scored where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = model.value, counts.value
        plain = np.log10(np.append(held, 0) + 1.0)
        for batch in batches:
            for i, hashes, first in token_blocks(batch.column(1), 1 << 19):
                begin, n = first[:-1], np.diff(first)
                kinds_of = own.classes(hashes)
                inside = kinds_of < own.k
                score = own.score(*own.contexts(kinds_of, first), kinds_of) if total else np.zeros(len(hashes))
                places = np.concatenate([[0], np.cumsum(~inside)])[first]
                rare = hashes[~inside]
                data = [rare[a:b].tobytes() for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
                sums = [np.add.reduceat(x, begin) for x in (inside.astype(np.int64), np.where(inside, plain[kinds_of], 0.0), score)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, len(n)), pa.array([not x for x in batch.column(2).slice(i, len(n)).to_pylist()], pa.bool_()), pa.array(n.astype(np.int64)),
                    pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]), pa.array(data, pa.binary()),
                ], names=["key", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

    return docs.mapInArrow(run, SCORED)


def score_texts(docs: DataFrame, training: str, key: str = "doc_id", text: str = "text", how: Training = Training()) -> DataFrame:
    """One row for each row of docs: `key`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`.

    training names a boolean column: only rows where it is true are learned from, a null counts as false; held_out is its
    opposite. Tokens are words, A-Z lower-cased, that end at white space, and one end for each text; null is an empty
    text, and an empty table gives no rows. n_known counts tokens that training texts hold. base_score sums
    log10((c + 1) / (N + V + 1)) over the tokens; c, N and V are the token's count, all tokens and distinct tokens of the
    training texts. score is the model's log10 probability of the whole text, its end included. Without training texts
    base_score is the same sum of zeros and score is 0. Equal texts, repeated rows included, have equal scores; so have equal
    tables, however they are partitioned. Other columns are left out. A text of any length is scored in one task, block by
    block, but must fit its memory some dozen times.

    Counts cover all training texts. Texts are scored where they are read; only the hashes of words outside the vocabulary
    are exchanged for their counts, once for each chunk of rows, so that no word is hotter than there are chunks. What the
    driver sees is the vocabulary (see Training), sums and the averaged weights.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.coalesce(F.col(training), F.lit(False)).alias("learn"))
    learned = rows.where("learn").select("key", "text")
    sizes = {r["learn"]: r["size"] or 0 for r in rows.groupBy("learn").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    parts = max(partitions(spark), -(-sum(sizes.values()) // PART_BYTES))
    counted = checkpointed(corpus_counts(learned.select("text"), parts))
    model, counts, total, kinds = learned_model(learned, counted, sizes.get(True, 0), how)
    other, other_kinds = total - int(counts.sum()), kinds - len(counts)
    found = scored(rows, spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(counts), total)
    chunks = max(partitions(spark), -(-sum(sizes.values()) // (16 << 20)))
    found = found.withColumn("chunk", F.pmod(F.xxhash64("key", "rare"), F.lit(chunks)))
    groups = found.groupBy("chunk")

    def rare_words(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, number of each row's) of a chunk, in a fixed order of its rows."""
        column = rows.column("rare").combine_chunks()
        n = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) // 8
        return np.frombuffer(b"".join(x.as_py() for x in column), np.uint64), n

    def ask(rows: pa.Table) -> pa.Table:
        values = np.unique(rare_words(rows)[0])
        order, cuts = dealt(parts_of(values, parts), parts)
        p, data = [p for p, _, _ in cuts], [values[order[a:b]].tobytes() for _, a, b in cuts]
        return pa.table({"p": pa.array(p, pa.int64()), "chunk": pa.array([rows.column("chunk")[0].as_py()] * len(p), pa.int64()), "data": pa.array(data, pa.binary())})

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        values = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in held.column("words")]) if held.num_rows else np.zeros(0, np.uint64)
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in held.column("counts")]) if held.num_rows else np.zeros(0, np.int64)
        out = []
        for x in asked.column("data"):
            want = np.frombuffer(x.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(values, want), max(len(values) - 1, 0))
            out.append((np.where(values[at] == want, n[at], 0) if len(values) else np.zeros(len(want))).astype(np.uint32).tobytes())
        return pa.table({"p": asked.column("p"), "chunk": asked.column("chunk"), "data": pa.array(out, pa.binary())})

    def judge(rows: pa.Table, got: pa.Table) -> pa.Table:
        hashes, n = rare_words(rows)
        values, which = np.unique(hashes, return_inverse=True)
        count = answers(parts_of(values, parts), parts, dict(zip(got.column("p").to_pylist(), got.column("data").to_pylist(), strict=True)), np.uint32)[which]
        owner = np.repeat(np.arange(len(n)), n)
        logs = np.log10(count + 1.0)
        sums = np.bincount(owner, logs, len(n))
        known = rows.column("n_known").to_numpy() + np.bincount(owner, count > 0, len(n)).astype(np.int64)
        tokens_ = rows.column("n_tokens").to_numpy()
        base = rows.column("base").to_numpy() + sums - tokens_ * np.log10(total + kinds + 1.0)
        score = rows.column("score").to_numpy() + (sums - n * np.log10(other + other_kinds + 1.0) if total else 0.0)
        return pa.table({"key": rows.column("key"), "held_out": rows.column("held_out"), "n_tokens": tokens_, "n_known": known, "base_score": base, "score": score})

    replies = groups.applyInArrow(ask, MAIL).groupBy("p").cogroup(counted.select("p", "words", "counts").groupBy("p")).applyInArrow(answer, MAIL)
    done = groups.cogroup(replies.groupBy("chunk")).applyInArrow(judge, "key long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs.withColumn("learn", ~held_out(F.col("doc_id"), 7, 2)), "learn")
