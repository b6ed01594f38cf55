"""Connected components of a link table, by alternating star contraction.

Each round is a group-by with a minimum and a join; no neighbourhood is
collected, so a node with very many links is one partial aggregate per task.
Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlfold.llm.staging import free, stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours, small star: its smaller ones
    and itself, are linked to the smallest of its neighbourhood."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else both.filter("v < u")
    smallest = around.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    moved = around.join(smallest, "u")
    if large:
        moved = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            smallest.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node with a link in ``links(u, v)``; the root is
    the component's smallest node. Self-links, repeated links and links in both
    directions are fine; nodes may be of any ordered type."""
    def content(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = stage(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before, after = None, content(now)
    while before != after:
        past, now = now, stage(_star(_star(now, large=True), large=False), "links")
        free(past)
        before, after = after, content(now)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
