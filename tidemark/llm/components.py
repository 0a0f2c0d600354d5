"""Connected components of a graph of long ids, by alternating large and small stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import copied_out, dealt_out, hot_values, saved


#: A node with more neighbours is a hub: they meet its least one in several tasks.
HUB = 1000


def star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Links the neighbours of each node, the larger ones or the smaller ones and itself, to the least of them. The least
    is found by an aggregation, which combines before it shuffles, and joined back; a hub's neighbours are dealt to several
    tasks for that join. rows: the number of edges, or a bound of it."""
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        around = around.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hubs = hot_values(around, "u", 2 * rows, HUB)
    met = dealt_out(around, hubs, "u", "v").join(copied_out(least, hubs, "u"), ["u", "salt"])
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): the smallest id that it is connected to. Self-links and repeated links
    don't matter; no edges give no rows. Each round halves the depth at least, and what each star gives is written."""
    now = saved(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    nodes = now.select(F.col("a").alias("id")).unionByName(now.select(F.col("b").alias("id"))).distinct()
    signature = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before, last = None, []
    while (found := signature(now)) != before:
        before = found
        for large in (True, False):
            now = saved(star(now, large, rows=found[0]), instead=last)
    return nodes.join(now.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
