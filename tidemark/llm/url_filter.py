"""URL filters: fixed host and path rules, then association rules that Spark's FP-growth mines from labelled URLs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """A verdict on a host, its subdomains and the paths that begin with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule(BLOCK, "com", "/en/"),
    Rule(ALLOW, "example.com", "/en/7"),
    Rule(ALLOW, "net", "/de/"),
    Rule(BLOCK, "example.net", "/de/8"),
    Rule(BLOCK, "org", "/es/"),
)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; empty without `://`."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: its host, the last one, two and three labels of it, and its path's segments with their depth.
    A host gives four tokens at most, however many labels it has, so that those that always come together stay few."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    domains = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3), size), lambda n: F.concat(F.lit("host:"), F.array_join(F.slice(labels, F.greatest(size - n + 1, F.lit(1)), F.least(n, size)), ".")))
    segments = F.transform(F.split(path, "/"), lambda s, i: F.when((i > 0) & (s != ""), F.concat(F.lit("path"), i.cast("string"), F.lit(":"), s)))
    return F.array_distinct(F.array_compact(F.concat(F.when(host != "", domains).otherwise(F.array().cast("array<string>")), segments)))


def mine_rules(labelled: DataFrame, tokens: str = "tokens", label: str = "bad", support: float = 0.0005, confidence: float = 0.0, lift: float = 1.5, least: int = 5) -> list[tuple[tuple[str, ...], float]]:
    """Token combinations that predict a bad URL: (tokens, confidence), by FP-growth over the tokens of all labelled rows
    with a marker token on bad ones.

    A rule is kept if its combination together with the marker is in `support` of the rows and in `least` rows, if `confidence`
    of the rows with the combination are bad, at `lift` times the usual rate or more, and if no other such rule has a part of
    its tokens. Spark finds and prunes them; what reaches the driver is bounded by the support and not by the table. No
    labelled rows or no bad ones: no rules. Rows whose label or tokens are null don't count; repeated rows count each time.
    """
    marked = labelled.where(F.col(label).isNotNull() & F.col(tokens).isNotNull()).select(F.when(F.col(label), F.array_append(F.col(tokens), F.lit("\0bad"))).otherwise(F.col(tokens)).alias("items"), F.col(label).alias("bad"))
    n, bad = marked.agg(F.count("*"), F.count_if("bad")).first()
    if not bad:
        return []
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / n)), minConfidence=min(1.0, max(confidence, lift * bad / n))).fit(marked.select("items"))
    rules = model.associationRules.where((F.element_at("consequent", 1) == "\0bad") & (F.col("lift") >= lift) & (F.round(F.col("support") * n) >= least))
    rules = checkpointed(rules.select(F.array_sort("antecedent").alias("items"), "confidence"))
    # every proper part of a rule's tokens, as the bits of a number
    parts = F.expr("transform(sequence(1L, shiftleft(1L, size(items)) - 2L), b -> filter(items, (x, i) -> getbit(b, i) = 1))")
    wider = rules.where(F.size("items") > 1).select("items", F.explode(parts).alias("part")).join(rules.select(F.col("items").alias("part")), "part", "left_semi").select("items").distinct()
    found = rules.join(wider, "items", "left_anti").collect()
    return sorted((tuple(r["items"]), float(r["confidence"])) for r in found)


def match_rules(rules: list[tuple[tuple[str, ...], float]], tokens: Column) -> Column:
    """The highest confidence of the mined rules whose tokens a row all has, null if none: the tokens of a batch of rows look up
    their rules in an inverted index, and a rule matches a row that met it as often as it has tokens. A row's tokens are
    distinct. The rules go to all tasks; they are as few as their support makes them."""
    if not rules:
        return F.lit(None).cast("double")
    words, which = np.unique([t for items, _ in rules for t in items], return_inverse=True)
    order = np.argsort(which, kind="stable")
    posting = np.repeat(np.arange(len(rules)), [len(items) for items, _ in rules])[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(words)))])
    size, confidence = np.array([len(items) for items, _ in rules]), np.array([c for _, c in rules])
    index = pa.array(words.tolist(), pa.string())

    @F.arrow_udf("double")
    def matched(rows: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(rows), 0).to_numpy().astype(np.int64)
        word = pc.fill_null(pc.index_in(rows.flatten(), value_set=index), -1).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(rows)), n)[word >= 0]
        word = word[word >= 0]
        count = first[word + 1] - first[word]
        rule = posting[np.repeat(first[word] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
        met, times = np.unique(np.repeat(row, count) * len(size) + rule, return_counts=True)
        met = met[times == size[met % len(size)]]
        best = np.full(len(rows), -1.0)
        np.maximum.at(best, met // len(size), confidence[met % len(size)])
        return pa.array(best, mask=best < 0)

    return matched(tokens)


def fixed_rule(rules: tuple[Rule, ...], host: Column, path: Column, value: str) -> Column:
    """`name` or `verdict` of the longest fixed rule that fits, null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, value))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, labelled: DataFrame, url: str = "url", label: str = "bad", rules: tuple[Rule, ...] = RULES, support: float = 0.0005, confidence: float = 0.0, lift: float = 1.5, least: int = 5) -> DataFrame:
    """pages with `host`, `path`, `rule`, `verdict` and `confidence`.

    labelled has `url` and a boolean `label`; token combinations mined from it (mine_rules) block a URL that no fixed rule
    fits; any other URL is allowed. `rule` is the longest fixed rule that fits (its host and all subdomains, a path that
    begins with its own), else null; of equally long ones the last given. `confidence` is that of the best mined rule that
    fits, also where a fixed rule decides. A URL that is null or has no `://` has an empty host and path; URLs of any length
    are judged whole. Rows keep their other columns, repeated rows stay, an empty table stays empty, and a column of the
    result's names is replaced.
    """
    known = labelled.select(url_tokens(url_host(F.col(url)), url_path(F.col(url))).alias("tokens"), F.col(label).alias("bad"))
    mined = mine_rules(known, support=support, confidence=confidence, lift=lift, least=least)
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", "confidence")]
    split = pages.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    host, path = F.col("host"), F.col("path")
    judged = split.withColumns({"rule": fixed_rule(rules, host, path, "name"), "confidence": match_rules(mined, url_tokens(host, path))})
    mined_verdict = F.when(F.col("confidence").isNotNull(), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return judged.withColumn("verdict", F.coalesce(fixed_rule(rules, host, path, "verdict"), mined_verdict))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose document has a label: the number in a page's path is the id of the document whose text it
    shows. Bad is toxic or of low quality."""
    named = pages.select("url", F.regexp_extract(url_path(F.col("url")), r"/([0-9]{1,18})(?:[./]|$)", 1).try_cast("long").alias("doc_id"))
    return named.join(labels.select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad")), "doc_id").select("url", "bad")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, page_labels(pages, table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict", "confidence")
