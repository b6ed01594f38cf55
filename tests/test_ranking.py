import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from crawlfold.operators.ranking import rank_within


@pytest.mark.parametrize("rows,parts", [(2_500, 8), (2_500, 16), (100_000, 8), (100_000, 16), (300_000, 16)])
def test_rank_within_equals_row_number_with_payload(spark, tmp_path, rows, parts):
    """Payload columns, skewed keys, all columns written out."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.range(rows).select(
            F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") * 7919 % 61).cast("string"))).alias("host"),
            (F.col("id") * 104_729 % 1_000_003).alias("page_id"),
            F.repeat(F.md5(F.col("id").cast("string")), 4).alias("payload"))
        df.write.parquet(f"{tmp_path}/in")
        df = spark.read.parquet(f"{tmp_path}/in")
        rank_within(df, "host", "page_id").write.parquet(f"{tmp_path}/out")
        got = spark.read.parquet(f"{tmp_path}/out")
        w = Window.partitionBy("host")
        want = df.select("*", (F.row_number().over(w.orderBy("page_id")) - 1).cast("bigint").alias("rank"),
                         F.count(F.lit(1)).over(w).alias("group_size"))
        assert got.count() == rows
        assert got.exceptAll(want.select(got.columns)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
