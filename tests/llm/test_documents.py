import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import minhash
from tidemark.llm.components import components
from tidemark.llm.decontaminate import contamination, op3_decontaminate
from tidemark.llm.language_id import identify_language, learn_profiles, op9_language_id
from tidemark.llm.lm import Model, Training, corpus_counts, frequent, learned_model, op8_lm_score, score_texts, tokens
from tidemark.llm.minhash import near_duplicates, op6_minhash

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# --- decontamination


def hits(text, windows):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    gone, items = set(), set()
    for w, own in windows.items():
        for i in range(len(words) - len(w) + 1):
            if tuple(words[i : i + len(w)]) == w:
                gone |= set(range(i, i + len(w)))
                items |= own
    return len(words), len(gone), sorted(items)


def windows_of(rows, n=10):
    out = {}
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        k = min(n, len(words))
        for j in range(len(words) - k + 1) if k else ():
            out.setdefault(tuple(words[j : j + k]), set()).add(str(i))
    return out


@pytest.mark.parametrize("bound", [200_000, 0])
def test_contamination(spark, docs, empty, monkeypatch, bound):
    """Also without the broadcast, as with a benchmark beyond its bound."""
    from tidemark.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    long_ = next(t for i, t in texts if i == 9)
    items = [(1, " ".join(long_.split()[20:45]).upper()), (2, "schöne-Tage, über"), (3, None), (4, "!!"), (5, long_[200:300]), (6, "one"), (7, " ".join(long_.split()[20:45]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *hits(t, windows_of(items))) for i, t in texts if i is not None)
    got = contamination(docs, bench)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect() if r["doc_id"] is not None) == want
    assert got.count() == docs.count()
    assert contamination(empty, bench).count() == 0
    assert contamination(docs, bench.where("item_id < 0")).where("n_hit > 0").count() == 0


def test_contamination_stays_in_the_jvm(spark):
    plan = op3_decontaminate(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- near duplicates


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        words = plain_words(t)
        sets[i] = {tuple(words[j : j + size]) for j in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
    ids = sorted(sets)
    own = {i: i for i in ids}

    def top(i):
        while own[i] != i:
            i = own[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                own[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, empty, size):
    rows = {(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None}
    got = near_duplicates(docs, size=size).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: tuple(r[1:]) for r in got if r["doc_id"] is not None} == brute_components(rows, size, 80)
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [512, 5])
def test_chains_of_near_copies(spark, monkeypatch, block):
    """Copies that drift: neighbours are linked, ends are not, and the smallest is near few of them. Also in small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[4 * k : 4 * k + 100])) for k in range(30)]
    rows += [(200 + k, " ".join(w if i % 9 else f"{w}x{k}" for i, w in enumerate(words[200:300]))) for k in range(40)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2)
    assert {r["doc_id"]: tuple(r[1:]) for r in got.collect()} == brute_components(rows, 2, 80)


def test_near_duplicate_query(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: tuple(r[1:]) for r in op6_minhash(spark, SF).collect()} == brute_components(rows, 2, 80)


def test_estimate_is_near_the_similarity(spark):
    words = [f"w{i}" for i in range(600)]
    rows = [(1, " ".join(words[:300])), (2, " ".join(words[30:330]))]
    bits = {r["id"]: r["bits"] for r in minhash.signatures(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 1).collect()}
    pair = spark.createDataFrame([(bits[1], bits[2])], "a array<long>, b array<long>")
    assert abs(pair.select(minhash.estimated(F.col("a"), F.col("b"))).first()[0] - 270 / 330) < 0.1
    assert 0.6 < minhash.least_estimate(0.8) < 0.8


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 7), (95, 100)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    from tidemark.llm import common
    from tidemark.llm import components as module

    monkeypatch.setattr(module, "HUB", 10)
    monkeypatch.setattr(common, "HOT_SHARE", 50)
    edges = [(1, i) for i in range(100, 400)] + [(2, i) for i in range(390, 500)] + [(i, i + 1) for i in range(600, 640)] + [(7, 8)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {1: 1, 2: 1, 7: 7, 8: 7} | {i: 1 for i in range(100, 500)} | {i: 600 for i in range(600, 641)}


# --- language identification


def test_language(spark, docs, empty):
    known = spark.createDataFrame([("the cat and the dog with this thing", "en"), ("der Hund und die Katze mit schönen Dingen", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    profiles = learn_profiles(known)
    assert sorted(profiles) == ["de", "en"]
    out = identify_language(docs, profiles)
    assert out.columns == ["doc_id", "text", "lang", "n_tokens", "spans", "lang_pred", "score"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect() if r["doc_id"] is not None}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 12))
    assert (got[5][0], got[10][0]) == ("en", "de")
    assert all(0 <= s <= 1 for _, s in got.values())
    assert identify_language(empty, profiles).count() == 0
    assert learn_profiles(empty) == {}
    assert {r["lang_pred"] for r in identify_language(docs, {}).collect()} == {"und"}


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    out = op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


# --- language model


def base_scores(rows):
    counts = Counter(w for learn, t in rows.values() if learn for w in [*plain_words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for k, (_, t) in rows.items():
        tokens = [*plain_words(t), None]
        out[k] = (len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
    return out


def test_scores(spark, docs, empty):
    learn = docs.withColumn("learn", F.when(F.col("doc_id").isNotNull(), F.col("doc_id") % 3 > 0)).withColumn("doc_id", F.col("n_tokens").cast("long"))
    rows = {r["doc_id"]: (bool(r["learn"]), r["text"]) for r in learn.collect()}
    got = {r["doc_id"]: r for r in score_texts(learn, "learn").collect()}
    want = base_scores(rows)
    assert {k: (r["n_tokens"], r["n_known"], r["train_tokens"]) for k, r in got.items()} == {k: v[:3] for k, v in want.items()}
    assert all(abs(r["base_score"] - want[k][3]) < 1e-6 * max(1, abs(want[k][3])) for k, r in got.items())
    assert {k: not r["held_out"] for k, r in got.items()} == {k: v[0] for k, v in rows.items()}
    assert score_texts(empty.withColumn("learn", F.lit(True)), "learn").count() == 0
    none = score_texts(docs.withColumn("learn", F.lit(False)), "learn").collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in none} == {(0, 0, 0.0, 0.0)}


def test_model_is_a_distribution():
    import numpy as np

    vocabulary = np.sort(np.random.default_rng(0).integers(1, 2**62, 20).astype(np.uint64))
    model = Model(vocabulary, np.full(21, 1 / 21), Training())
    rng = np.random.default_rng(1)
    text = vocabulary[np.cumsum(rng.integers(0, 2, 20_000)) % 20]
    model.train(iter([(model.classes(text), np.array([0, len(text)]))]), 1)
    model.ready()
    one, two = np.repeat(np.arange(22), 21), np.repeat(np.arange(22)[::-1], 21)
    total = (10 ** model.score(one, two, np.tile(np.arange(21), 22))).reshape(22, 21).sum(axis=1)
    assert np.allclose(total, 1, atol=1e-4)
    classes = model.classes(text)
    assert model.score(*model.contexts(classes, np.array([0, len(text)])), classes).mean() > math.log10(1 / 21) + 0.2


def test_vocabulary_grows_with_the_corpus(spark):
    """Two thousand words that each come twice before one of their own: more than a constant vocabulary held."""
    text = " ".join(f"w{i}" for i in range(2000))
    rows = spark.createDataFrame([(text,)] * 40, "text string")
    assert len(frequent(corpus_counts(rows, 1), Training().threshold(40 * 2001), 1021)[0]) == 2001
    assert [Training().threshold(n) for n in (10**4, 10**8, 10**12)] == [20, 200, 20_000]
    docs = spark.createDataFrame([(i, text, True) for i in range(40)] + [(100, "w7 w1500 w1501 w1502", False), (101, "w7 w1500 w300 w1100", False)], "doc_id long, text string, learn boolean")
    got = {r["doc_id"]: r for r in score_texts(docs, "learn").collect()}
    assert got[100]["score"] > got[101]["score"] and abs(got[100]["base_score"] - got[101]["base_score"]) < 1e-6


def test_the_driver_learns_from_no_texts(spark, monkeypatch):
    import numpy as np

    from tidemark.llm.lm import token_blocks, train_model

    monkeypatch.setattr(Model, "train", None)  # of this process only, not of the tasks
    rows = spark.createDataFrame([("a b a b",)] * 400, "text string").repartition(4)
    _, hashes, _ = next(token_blocks(rows.toArrow().column(0)))
    words = np.unique(hashes)
    model = train_model(rows, words, np.array([0.4, 0.4, 0.19, 0.01]), 2800, Training())
    assert not np.allclose(model.weights["place"], 1)


def test_scores_do_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").withColumn("learn", F.col("doc_id") % 5 > 0)
    one, eight = ({r["doc_id"]: r["score"] for r in score_texts(docs.repartition(n, *by), "learn").collect()} for n, by in ((1, []), (8, ["text"])))
    assert one.keys() == eight.keys() and all(abs(one[k] - eight[k]) < 1e-6 * max(1, abs(one[k])) for k in one)


def test_scores_are_sums_of_log_softmaxes(spark):
    """Each token's probability by the definition: its bin among the bins, it among its bin, and its share of other words."""
    import numpy as np

    how = Training(often=5, least=60, rounds=2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 3000").withColumn("learn", F.col("doc_id") % 4 > 0)
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, "learn", how=how).collect()}
    learned = docs.where("learn").select("doc_id", "text")
    size = learned.agg(F.sum(F.octet_length("text"))).first()[0]
    model, counts, total, kinds = learned_model(learned, corpus_counts(learned.select("text"), 3), size, how)
    w, all_counts = model.weights, Counter()
    rows = docs.collect()
    hashes = {r["doc_id"]: tokens(raw := np.frombuffer((r["text"] or "").encode(), np.uint8), np.array([0, len(raw)]))[0].tolist() for r in rows}
    for r in rows:
        all_counts.update(hashes[r["doc_id"]] if r["learn"] else [])
    place = {int(v): i for i, v in enumerate(model.vocabulary)}
    other = total - int(counts.sum()) + kinds - len(counts)
    checked = 0
    for r in rows[:60]:
        one = two = model.k + 1
        score = 0.0
        for h in hashes[r["doc_id"]]:
            c = place.get(h, model.k)
            predicted = w["before"][one].astype(float) * w["place"][0] + w["before"][two].astype(float) * w["place"][1]
            bins = w["bins"] @ predicted + w["bin_bias"][:, 0]
            inside = np.flatnonzero(model.bin == model.bin[c])
            words_ = w["next"][inside] @ predicted + w["bias"][inside, 0]
            own = w["next"][c] @ predicted + w["bias"][c, 0]
            score += (bins[model.bin[c]] - np.log(np.exp(bins).sum()) + own - np.log(np.exp(words_).sum())) / np.log(10)
            score += math.log10((all_counts[h] + 1) / (other + 1)) if c == model.k else 0
            one, two = c, one
        assert abs(score - got[r["doc_id"]]) < 1e-4 * max(1, abs(score))
        checked += 1
    assert checked == 60


def test_scores_beat_unigrams_and_bigrams_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    out = op8_lm_score(spark, sf).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = {True: [], False: []}
    for r in rows:
        texts[zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2].append([*plain_words(r["text"]), None])
    pairs = Counter(p for t in texts[False] for p in zip(["<s>", *t], t))
    before = Counter(a for t in texts[False] for a in ["<s>", *t[:-1]])
    kinds = len({w for t in texts[False] for w in t})
    bigram = sum(math.log10((pairs[p] + 1) / (before[p[0]] + kinds + 1)) for t in texts[True] for p in zip(["<s>", *t], t))
    assert out[0] > bigram
    assert (out[0] - out[1]) / out[2] > 0.03


# --- language identification by hand


def grams_by_hand(text):
    """Characters, pairs and triples within words that are padded by one blank; no blank alone, none in the middle of three."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    out = Counter()
    for w in words:
        out.update(w)
    line = f" {' '.join(words)} " if words else ""
    out.update(line[i : i + 2] for i in range(len(line) - 1))
    out.update(line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
    return out


def order_of(text):
    """The number that an n-gram's letters are: the first highest."""
    n = 0
    for c in text:
        n = (n << 21) | ord(c)
    return n


def profile_by_hand(counts, size=400):
    return sorted(counts, key=lambda g: (-counts[g], order_of(g)))[:size]


def test_language_query_against_distances_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    counts = {}
    for r in rows:
        if not held[r["doc_id"]] and r["lang"] is not None and r["text"] is not None:
            counts.setdefault(r["lang"], Counter()).update(grams_by_hand(r["text"]))
    profiles = {k: {g: i for i, g in enumerate(profile_by_hand(v))} for k, v in counts.items()}
    got = {r["doc_id"]: r for r in op9_language_id(spark, sf).collect()}
    assert got.keys() == held.keys() and all(got[k]["held_out"] == v for k, v in held.items())
    for r in rows:
        own = profile_by_hand(grams_by_hand(r["text"]))
        if not own:
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        apart = {k: sum(abs(p[g] - i) if g in p else 400 for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        assert got[r["doc_id"]]["lang_pred"] == best
        assert abs(got[r["doc_id"]]["score"] - (1 - apart[best] / (400 * len(own)))) < 1e-9


def test_language_keeps_a_column_of_any_name(spark):
    docs = spark.createDataFrame([(1, "the text", "en", 5, 6)], "doc_id long, text string, lang string, judged int, _judged int")
    out = identify_language(docs, learn_profiles(docs)).first()
    assert (out["judged"], out["_judged"], out["lang_pred"]) == (5, 6, "en")
