import re
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import media
from tidemark.llm.media import agreeing, decode_image, described_batch, encode_image, filed_together, image_copies, matches, near, op2_media_copies, page_images, pattern
from tidemark.llm.url_filter import filter_urls, match_rules, mine_rules, op1_url_filter, url_host, url_path, url_tokens

URLS = [
    (1, "HTTP://Example.COM/en/7?x=1#y", ("example.com", "/en/7", "example.com/en/7", "allow")), (2, "http://a.example.com/en/6", ("a.example.com", "/en/6", "com/en/", "block")),
    (3, "https://b.net/de/1", ("b.net", "/de/1", "net/de/", "allow")), (4, "https://x.example.net/de/80/", ("x.example.net", "/de/80/", "example.net/de/8", "block")),
    (5, "http://notexample.com/en/7", ("notexample.com", "/en/7", "com/en/", "block")), (6, "ftp://o.org/es/", ("o.org", "/es/", "org/es/", "block")),
    (7, "no scheme", ("", "", None, "allow")), (8, None, ("", "", None, "allow")), (9, "", ("", "", None, "allow")), (10, "http://", ("", "", None, "allow")),
    (11, "http://h?q=http://z/p", ("h", "", None, "allow")), (12, "http://h#/en/", ("h", "", None, "allow")), (13, "a://b://c/d", ("b:", "//c/d", None, "allow")),
    (14, "http://MÜNCHEN.com/EN/", ("mÜnchen.com", "/EN/", None, "allow")), (14, "http://MÜNCHEN.com/EN/", ("mÜnchen.com", "/EN/", None, "allow")), (15, "http://com/en/\nx", ("com", "/en/\nx", "com/en/", "block")),
]


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u, "mine") for i, u, _ in URLS], "page_id long, url string, rule string")
    out = filter_urls(pages, spark.createDataFrame([], "url string, bad boolean"))
    assert out.columns == ["page_id", "url", "host", "path", "rule", "confidence", "verdict"]
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()), key=repr) == sorted(((i, *w) for i, _, w in URLS), key=repr)
    assert filter_urls(pages.where("page_id < 0"), pages.selectExpr("url", "true AS bad")).count() == 0


def labelled(spark):
    rows = [(f"http://h{i}.{'spam' if i % 2 else 'good'}.io/{'buy' if i % 3 else 'read'}/{i}", bool(i % 2 and i % 3)) for i in range(300)]
    return spark.createDataFrame([*rows, (None, True), ("http://x.io", None)], "url string, bad boolean")


def test_mined_rules(spark):
    known = labelled(spark).select(url_tokens(url_host(spark_col("url")), url_path(spark_col("url"))).alias("tokens"), "bad")
    rules = mine_rules(known, confidence=0.8)
    assert ("host:spam.io", "path1:buy") in [r for r, _ in rules]
    assert all(not set(a) < set(b) for a, _ in rules for b, _ in rules)
    assert rules == mined_by_hand(labelled(spark).collect(), confidence=0.8)
    assert mine_rules(known) == mined_by_hand(labelled(spark).collect())
    assert mine_rules(known.where("not bad")) == [] and mine_rules(known.where("bad is null")) == []
    verdicts = filter_urls(spark.createDataFrame([(1, "http://new.spam.io/buy/9"), (2, "http://new.spam.io/read/9"), (3, "http://new.good.io/buy/9")], "page_id int, url string"), labelled(spark), confidence=0.8)
    assert {r["page_id"]: r["verdict"] for r in verdicts.collect()} == {1: "block", 2: "allow", 3: "allow"}


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_index_matches_as_sets_do(spark):
    rules = [(("a", "b"), 0.9), (("c",), 0.7), (("a", "b", "d"), 1.0)]
    rows = [["a", "b"], ["a"], ["b", "c"], ["d", "b", "a"], [], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>")
    got = [r[0] for r in df.orderBy("i").select(match_rules(rules, spark_col("t"))).collect()]
    want = [max((c for items, c in rules if set(items) <= set(r or ())), default=None) for r in rows]
    assert got == want


def plain_tokens(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    parts = host.split(".")
    out = ["host:" + ".".join(parts[-n:]) for n in (1, 2, 3, len(parts))] if host else []
    return list(dict.fromkeys(out + [f"path{i}:{s}" for i, s in enumerate(path.split("/")) if i and s]))


def mined_by_hand(rows, support=0.0005, confidence=0.0, lift=1.5, least=5):
    """All combinations of all URLs' tokens, counted."""
    rows = [(set(plain_tokens(u)), bad) for u, bad in rows if bad is not None]
    every, bad = Counter(), Counter()
    for tokens, b in rows:
        for n in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), n):
                every[c] += 1
                bad[c] += b
    n, usual = len(rows), sum(b for _, b in rows) / len(rows)
    good = {c: bad[c] / every[c] for c in every if bad[c] >= max(least, support * n) and bad[c] / every[c] >= max(confidence, lift * usual - 1e-12)}
    return sorted((c, p) for c, p in good.items() if not any(set(o) < set(c) for o in good))


def test_url_query_against_rules_mined_by_hand(spark):
    sf = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    bad = {r["doc_id"]: r["toxic"] == 1 or r["quality"] == 0 for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    number = {r["page_id"]: int(m[1]) for r in pages if (m := re.search(r"://[^/]*/(?:[a-z]*/)?(\d+)(?:[./?#]|$)", r["url"]))}
    rules = mined_by_hand([(r["url"], bad[number[r["page_id"]]]) for r in pages if number.get(r["page_id"]) in bad])
    assert len(rules) > 3
    got = {r["page_id"]: r for r in op1_url_filter(spark, sf).collect()}
    assert len(got) == len(pages)
    blocked = 0
    for r in pages:
        tokens, g = set(plain_tokens(r["url"])), got[r["page_id"]]
        best = max((p for c, p in rules if set(c) <= tokens), default=None)
        assert g["confidence"] == best or abs(g["confidence"] - best) < 1e-12
        if g["rule"] is None:
            assert g["verdict"] == ("block" if best is not None else "allow")
            blocked += best is not None
    assert blocked > 0


def test_columns_of_url_filters_own_names(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", 5, "mine")], "page_id int, url string, _fixed int, host string")
    out = filter_urls(pages, labelled(spark)).first()
    assert out["_fixed"] == 5 and out["host"] == "a.com"
    long_url = spark.createDataFrame([(1, "http://" + "a." * 50_000 + "com/en/" + "x" * 100_000)], "page_id int, url string")
    assert filter_urls(long_url, labelled(spark)).first()["verdict"] == "block"


def scene(seed, size=(160, 200)):
    rng = np.random.default_rng(seed)
    coarse = rng.random((size[0] // 4, size[1] // 4)).repeat(4, axis=0).repeat(4, axis=1)
    return (coarse * 255).astype(np.uint8)


@pytest.fixture(scope="module")
def pictures():
    a, b = scene(1), scene(2)
    rng = np.random.default_rng(3)
    noisy = np.clip(a * 0.85 + 12 + rng.normal(0, 3, a.shape), 0, 255)
    colour = np.stack([b, b, b], axis=2)
    return [
        (1, encode_image(a)), (2, encode_image(a[20:130, 40:180])), (3, encode_image(np.rot90(a))), (4, encode_image(noisy)), (5, encode_image(b)), (6, encode_image(b)),
        (7, b"P6 # made\n200 160\n255\n" + colour.astype(np.uint8).tobytes()), (8, None), (9, b""), (10, b"P5 10 10 255\nshort"), (11, b"GIF89a"), (12, encode_image(np.zeros((50, 50)))), (None, encode_image(a)),
        (13, encode_image(scene(9))),
    ]


def test_image_copies(spark, pictures):
    df = spark.createDataFrame(pictures, "id long, image binary").repartition(3)
    got = {r["id"]: r for r in image_copies(df).collect()}
    assert {k: r["class_id"] for k, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9, 10: 10, 11: 11, 12: 12, None: None, 13: 13}
    assert got[1]["n_links"] == 3 and got[13]["n_links"] == 0 and got[8]["n_features"] == 0
    assert image_copies(df.where("id < 0")).count() == 0


def test_copies_behind_other_images_of_their_keys(spark):
    """Each corner of the last two images is in one of the smaller ones too, none of which has enough of them."""
    a = scene(6, (36, 200))
    parts = [(i, encode_image(a[:, 8 * i : 8 * i + 28])) for i in range(22)]
    df = spark.createDataFrame([*parts, (100, encode_image(a)), (101, encode_image(a * 0.9))], "id long, image binary")
    got = {r["id"]: r["class_id"] for r in image_copies(df).collect()}
    assert got[100] == got[101]


def test_copies_of_short_pages(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 9, k)) for k in (9, 20, 60, 90, 130)]
    rows = [(10 * i, t) for i, t in enumerate(texts)] + [(10 * i + 1, t[:-6] + "edited") for i, t in enumerate(texts)]
    got = {r["id"]: r for r in image_copies(page_images(spark.createDataFrame(rows, "page_id long, html string"))).collect()}
    assert {k: r["class_id"] for k, r in got.items()} == {k: k // 10 * 10 for k in got}
    assert all(r["n_features"] >= 6 for r in got.values())


def test_copies_of_small_pictures(spark):
    a = scene(11, (16, 160))
    df = spark.createDataFrame([(1, encode_image(a)), (2, encode_image(a * 0.9)), (3, encode_image(a[:, 20:140])), (4, encode_image(scene(12, (16, 160))))], "id long, image binary")
    assert {r["id"]: r["class_id"] for r in image_copies(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_recall_of_edited_pictures(spark):
    """Of noisy, cropped, turned, darkened and shrunken copies, and of pictures that share a part, nine in ten are found; every
    picture stands against all others."""
    rng, rows = np.random.default_rng(21), []
    for i in range(16):
        a = scene(100 + i)
        edits = [a, np.clip(a + rng.normal(0, 4, a.shape), 0, 255), a[15:130, 25:180], np.rot90(a), np.clip(a * 0.7 + 20, 0, 255), a[:, ::-1][:, ::-1][8:, 3:], np.hstack([a[:, 40:], scene(300 + i)[:, :60]])]
        rows += [(100 * i + k, encode_image(np.ascontiguousarray(e))) for k, e in enumerate(edits)]
    got = {r["id"]: r["class_id"] for r in image_copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert all(got[k] // 100 == k // 100 for k in got)
    copies = [k for k in got if k % 100]
    assert sum(got[k] == k // 100 * 100 for k in copies) / len(copies) >= 0.9


def test_links_against_all_pairs(spark):
    """Classes of pages by comparing all corners of all pairs."""
    sf = "/root/testdata/sf0.01"
    images = page_images(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")).collect()
    n, corners = described_batch([r["image"] for r in images], pattern())
    at = np.concatenate([[0], np.cumsum(n)])
    own = [tuple(corners[k][a:b] for k in ("place", "low", "high")) for a, b in zip(at[:-1], at[1:], strict=True)]
    root = list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = []
    for i in range(len(own)):
        for j in range(i):
            place, there = filed_together(own[i], own[j], 16)
            if len(place) >= 6:
                place, there = matches(own[i], own[j], 16)
                if agreeing(place, there) >= 6:
                    links.append((i, j))
                    root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r["page_id"]: r["class_id"] for r in op2_media_copies(spark, sf).collect()}
    together = sum(got[images[i]["id"]] == got[images[j]["id"]] for i, j in links)
    assert len(links) > 20 and together / len(links) >= 0.97
    apart = {images[i]["id"]: find(i) for i in range(len(own))}
    assert all(apart[a] == apart[c] for a, c in got.items())


def corners_of(*images):
    n, corners = described_batch([encode_image(x) for x in images], pattern())
    at = np.concatenate([[0], np.cumsum(n)])
    return [tuple(corners[k][a:b] for k in ("place", "low", "high")) for a, b in zip(at[:-1], at[1:], strict=True)]


def test_near_descriptors_are_all_found():
    a = scene(31)
    one, two = corners_of(a, np.clip(a + np.random.default_rng(1).normal(0, 20, a.shape), 0, 255))
    i, j = near(*one[1:], *two[1:], 16)
    assert sorted(zip(one[0][i], two[0][j], strict=True)) == sorted(zip(*matches(one, two, 16), strict=True)) and len(i) > 100
    none = np.zeros(0, np.uint64)
    assert len(near(none, none, *two[1:], 16)[0]) == len(near(*one[1:], none, none, 16)[0]) == 0


def test_order_of_parts_and_memory_of_their_tables():
    """A table for 23 bits takes 64 MB and little more, whatever the descriptors."""
    values = np.random.default_rng(6).integers(0, 300, 2000)
    order, there = media.by_value(values)
    assert order.tolist() == np.argsort(values, kind="stable").tolist() and there.tolist() == sorted(values.tolist())
    tracemalloc.start()
    halves = values.astype(np.uint64)
    assert sum(len(i) for i, _ in media.lookups(values[:9], halves[:9], values, halves, 23, 0, 64)) == sum((values == v).sum() for v in values[:9])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 << 20


@pytest.mark.parametrize("within", [0, 1, 5, 16, 20])
def test_near_at_any_distance_and_step(monkeypatch, within):
    """Also where one value has more corners than are compared at once, and in another order of the bits."""
    monkeypatch.setattr(media, "COMPARED", 50)
    monkeypatch.setattr(media, "LOOKED", 64)
    a = scene(32)
    one, two = corners_of(a, np.clip(a + np.random.default_rng(2).normal(0, 12, a.shape), 0, 255))
    one, two = (tuple(np.concatenate([v, w[:20].repeat(10)]) for v, w in zip(x, one, strict=True)) for x in (one, two))
    apart = np.bitwise_count(one[1][:, None] ^ two[1]) + np.bitwise_count(one[2][:, None] ^ two[2])
    want = sorted(zip(*np.nonzero(apart <= within), strict=True))
    order = media.balanced(*two[1:])
    assert sorted(order.tolist()) == list(range(128)) and len(want) > 100
    assert sorted(zip(*near(*one[1:], *two[1:], within), strict=True)) == want
    turned = [x for v in (one, two) for x in media.reordered(*v[1:], order)]
    assert sorted(zip(*near(*turned, within), strict=True)) == want
    assert sorted(zip(*near(*turned, within, lambda i, j: i > j), strict=True)) == [(i, j) for i, j in want if i > j]


def test_parts_of_bits_that_depend_little_on_each_other(spark):
    """Most time goes to pairs of corners whose parts are near. On pages' corners they are less than 70 % of those where parts are
    the bits as they come, six that may differ in two bits each."""
    images = page_images(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")).collect()
    corners = described_batch([r["image"] for r in images], pattern())[1]
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, len(corners["low"]), (2, 400_000))

    def compared(halves, cuts, flips):
        return sum((np.bitwise_count((v[a] ^ v[b]) >> np.uint64(f) & np.uint64((1 << n) - 1)) <= next(flips)).sum() for v, c in zip(halves, cuts, strict=True) for f, n in c)

    plain = (corners["low"], corners["high"])
    before = compared(plain, [((0, 22), (22, 21), (43, 21))] * 2, iter([2] * 6))
    order = media.balanced(*(v[:: len(v) // 20_000 + 1] for v in plain))
    assert compared(media.reordered(*plain, order), media.CUTS, iter([2, 2, 2, 2, 2, 1])) < 0.7 * before


def test_links_without_equal_halves(spark, monkeypatch):
    """Noisy copies with enough corners that match, but too few whose halves are equal; blocks of about one picture."""
    monkeypatch.setattr(media, "BLOCK", 100)
    rows = []
    for seed in range(400, 440):
        a = scene(seed, (60, 80))
        b = np.clip(a + np.random.default_rng(seed).normal(0, 26, a.shape), 0, 255)
        one, two = corners_of(a, b)
        if len(filed_together(one, two, 16)[0]) < 6 and agreeing(*matches(one, two, 16)) >= 6:
            rows += [(2 * seed, encode_image(a)), (2 * seed + 1, encode_image(b))]
    rows = rows[:8]
    assert len(rows) == 8
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in image_copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert got == {k: (k // 2 * 2, 1) for k, _ in rows}


def test_corners_are_written_once_and_not_shuffled(spark, monkeypatch):
    """Of all tables that are saved one has corners, and no shuffle before any of them has, in several blocks of images that
    have tokens in common."""
    monkeypatch.setattr(media, "BLOCK", 300)
    tables, plans, save = [], [], media.saved

    def watched(df, *args, **named):
        tables.append(df.columns)
        plans.append(spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
        return save(df, *args, **named)

    monkeypatch.setattr(media, "saved", watched)
    a = scene(50)
    images = spark.createDataFrame([(i, encode_image(np.roll(a, 40 * i, axis=1))) for i in range(5)], "id long, image binary")
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["id"]: (r["class_id"], r["n_features"]) for r in image_copies(images).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert {c for c, _ in got.values()} == {0} and sum(n for _, n in got.values()) > 2 * media.BLOCK
    assert sum("low" in t for t in tables) == 1
    shuffled = [columns for plan in plans for columns in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]
    assert len(shuffled) > 3 and not [x for x in shuffled if re.search(r"\blow", x)]


def test_image_formats():
    a = scene(4, (8, 12))
    assert np.allclose(decode_image(encode_image(a)), a / 255, atol=1e-6)
    assert decode_image(None) is None and decode_image(b"P5 4 4 65535\n" + bytes(32)) is None and decode_image(b"P5") is None


def test_pages_as_pictures(spark):
    pages = spark.createDataFrame([(1, "<p>Hello <b>you</b></p><script>x</script>"), (2, None), (3, "<br>"), (4, "Hello you")], "page_id long, html string")
    got = {r["id"]: r["image"] for r in page_images(pages).collect()}
    assert got[1] == got[4] and got[2] is None and got[3] is None
    assert op2_media_copies(spark, "/root/testdata/sf0.001").count() == 50
