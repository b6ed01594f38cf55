"""Corpus pipeline: toxicity filter, line dedup, near-dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlfold.llm import line_dedup, mixing, near_dedup, packing, toxicity
from crawlfold.llm.staging import stage, unused


BATCH_ROWS = 1000  # texts that travel at once between Spark and a Python worker


def small_batches(spark: SparkSession) -> None:
    """Smaller batches than Spark's 10,000 rows, unless the session sets its own
    size: a batch is held by the JVM, outside its heap, and by the worker, there
    and back, which adds up where all stages share their executors."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is under one half."""
    small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "toxicity")
    scored = toxicity.score_texts(docs, model, score_col=score, segments_col=unused(docs, "segments"))
    return scored.filter(F.col(score) < 0.5).select(docs.columns)


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without recurring template lines; n_chars follows the text."""
    short = line_dedup.dedup_lines(docs, added=(unused(docs, "n_lines"), unused(docs, "dropped_lines")))
    return short.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    small_batches(spark)
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at rates of at most one that bring the expected token shares of
    the quality domains to their targets."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fitted = mixing.fit(docs, labels, mixing.QUALITY_TARGETS, label_col="quality", max_rate=1.0)
    added = tuple(unused(docs, c) for c in mixing.ADDED)
    return mixing.apply_rates(mixing.rate_documents(docs, fitted, added=added), added=added).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 2048 tokens, 64 segments and 2040
    loss-bearing tokens (a row per piece)."""
    import public_tokenizers

    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, path, max_segments=packing.MAX_SEGMENTS, max_loss=packing.MAX_LOSS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_template_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

# SQL cannot express the classifiers, the tokenizer or the packing heuristic
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
