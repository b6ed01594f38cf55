"""Ranking helpers that stay balanced when one key owns most rows.

``rank_within`` numbers rows inside each group without a window partitioned
by the group key: rows are range-partitioned on (key, order) - the range
partitioner splits a hot key over many tasks - and written once with their
partition and position. Counts, offsets and each key's first row are then all
read from that one table: a second range exchange could cut elsewhere, and
its offsets would belong to other partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlfold.session import cut_lineage

_LOW33 = (1 << 33) - 1


def global_index(df: DataFrame, order_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """Add ``_gidx``: 0-based position of each row in ``order_cols`` order."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = (
        df.repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_mid", 33))
        .withColumn("_lix", F.col("_mid").bitwiseAND(F.lit(_LOW33)))
    )
    s = cut_lineage(s)  # every reader below must see the same partitions
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: a bounded table, safe to order globally and broadcast
    offsets = counts.withColumn(
        "_off",
        F.coalesce(F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select("_pid", "_off")
    return (
        s.join(F.broadcast(offsets), "_pid")
        .withColumn("_gidx", F.col("_off") + F.col("_lix"))
        .drop("_mid", "_pid", "_lix", "_off")
    )


def rank_within(df: DataFrame, key: str, order: str, rank_col: str = "rank",
                size_col: str | None = "group_size") -> DataFrame:
    """0-based rank of each row inside its ``key`` group, ordered by ``order``
    (unique within the group), plus the group size."""
    g = global_index(df, [key, order])
    # one row per key, as a table of its own: the join reads two plain exchanges,
    # whose hot key Spark can split
    first = cut_lineage(g.groupBy(key).agg(F.min("_gidx").alias("_first"), F.count(F.lit(1)).alias("_n")))
    out = g.join(first, key).withColumn(rank_col, (F.col("_gidx") - F.col("_first")).cast("bigint"))
    if size_col:
        out = out.withColumn(size_col, F.col("_n"))
    return out.drop("_gidx", "_first", "_n")
