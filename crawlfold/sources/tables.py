"""Readers: domain lists, page snapshots, driver tables.

A *snapshot* is ``(url STRING, body STRING)`` (optionally ``final_url``,
``rendered``): what a fetch of ``url`` returned. A URL with no row, or an
empty body, is a failed fetch; every fetch in the pipelines is a join on
``url`` against this table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlfold.functions.urls import strip_ws

# cells are kept as they stand: quotes doubled, blanks not trimmed
CSV_CELLS = {"header": True, "encoding": "UTF-8", "quote": '"', "escape": '"',
             "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("body", T.StringType(), True),
])

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_ordered_csv(spark: SparkSession, path: str, col: str = "input_pos") -> DataFrame:
    """Rows of the CSV files at ``path`` (columns by the header's names, cells as
    they stand, blank lines skipped) with their position from 0: by file name, then
    by place in the file. A file's blocks may be read by any task: rows are
    numbered by (file, block, place in the block), which no packing of blocks
    into tasks changes."""
    from crawlfold.session import cut_lineage

    raw = spark.read.options(**CSV_CELLS).csv(path)
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_row"))
    placed = cut_lineage(placed)  # both readers below must see the same blocks; rows stay where they are read
    # a task reads a block from end to end, so its rows have consecutive numbers; one row
    # per block: a bounded table, safe to order globally and broadcast
    blocks = placed.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    out = placed.join(F.broadcast(starts), ["_file", "_block"])
    return out.select(*raw.columns, (F.col("_row") + F.col("_shift")).cast("bigint").alias(col))


def write_ordered_csv(df: DataFrame, path: str, col: str = "input_pos", files: int | None = None,
                      finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write rows as CSV files whose names and lines follow ``col`` (which is not
    written): a range partitioning, so no task holds them all. ``finish`` makes of
    the dealt rows those to be written, so that wide cells are not dealt out; it must
    leave each row in its partition, as a broadcast join does."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, col)
    rows = finish(dealt) if finish else dealt
    rows.sortWithinPartitions(col).drop(col).write.options(**CSV_CELLS).csv(path)


def domains_a(df: DataFrame, col: str = "domain") -> DataFrame:
    """Pipeline A domain list: rows with a non-empty value, untrimmed,
    duplicates kept."""
    others = [c for c in df.columns if c != col]
    return df.filter(F.col(col).isNotNull() & (F.col(col) != "")).select(*others, F.col(col).alias("domain"))


def domains_b(df: DataFrame, col: str = "domain") -> DataFrame:
    """Pipeline B domain list: whitespace-stripped, empty rows skipped."""
    others = [c for c in df.columns if c != col]
    return df.select(*others, strip_ws(F.col(col)).alias("domain")).filter(F.col("domain") != "")


def read_domain_csv(spark: SparkSession, path: str, mode: str = "a") -> DataFrame:
    """``(input_pos, domain)`` of CSV files with a ``domain`` column, in input order
    (``input_pos`` counts all rows, also those that the mode drops)."""
    raw = read_ordered_csv(spark, path).select("input_pos", "domain")
    return domains_a(raw) if mode == "a" else domains_b(raw)


def fetched(snapshot: DataFrame) -> DataFrame:
    """Rows that count as a successful fetch (non-empty body)."""
    return snapshot.filter(F.col("body").isNotNull() & (F.col("body") != ""))
