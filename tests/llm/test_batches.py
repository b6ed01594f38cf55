"""Batches between Spark and the Python workers of the corpus pipeline."""

import corpus_pipeline as P
from pyspark.sql import functions as F

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stages_send_small_batches_and_keep_a_size_that_is_set(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    before = spark.conf.get(KEY)
    try:
        spark.conf.unset(KEY)
        docs = spark.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
        P.drop_near_duplicates(spark, docs, "")
        got = docs.mapInArrow(sizes, "n bigint").agg(F.max("n"), F.sum("n")).first()
        assert got[0] <= P.BATCH_ROWS and got[1] == 2500
        spark.conf.set(KEY, 77)
        P.small_batches(spark)
        assert spark.conf.get(KEY) == "77"
    finally:
        spark.conf.set(KEY, before)
