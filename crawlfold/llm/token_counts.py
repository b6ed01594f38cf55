"""Token counts with a digest cache.

The cache is a Parquet table ``(content, tokenizer, n_tokens)``: SHA-256 of the
normalised content and digest of the tokenizer's version. A call joins the
distinct digests of its texts to the cache, encodes only the distinct misses
and appends them. Normalisation must not change counts, so it is only null ->
empty. Texts cross the network once: copies are combined on the map side
before the one shuffle by digest, so a text that a third of the rows share is
one row per task there.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlfold.llm import encoders
from crawlfold.llm.staging import shared_path, stage
from crawlfold.session import ship_package

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens bigint"


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache table; a path that does not exist yet is an empty cache."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def _encoder(tokenizer_path: str, version: str):
    def run(batches):
        encode = encoders.load(tokenizer_path)
        for batch in batches:
            texts, counts = batch.column("_text"), []
            for i in range(0, len(texts), 64):  # few ids at a time, however long the texts
                counts += [len(ids) for ids in encode([t or "" for t in texts.slice(i, 64).to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                names=["content", "tokenizer", "n_tokens"])
    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 512) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)``, a row per row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and repeated
    ids are each counted; an empty table gives no rows; other columns of
    ``docs`` are not read. Two jobs appending the same digest at once leave two
    equal cache rows, which the read combines.
    """
    spark = docs.sparkSession
    ship_package(spark)
    version = encoders.file_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    known = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).select("content")
    distinct = docs.select(digest.alias("content"), text.alias("_text")).dropDuplicates(["content"])
    misses = distinct.join(known, "content", "left_anti")
    misses.mapInArrow(_encoder(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    rows = docs.select(F.col(id_col), digest.alias("content"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    counts = read_cache(spark, cache_path).filter(F.col("tokenizer") == version)
    # only this table's digests, combined on the map side: past runs' counts are left before they are grouped
    counts = counts.join(rows.select("content").distinct(), "content", "left_semi")
    # one row a digest, as a table of its own: the join below then reads two plain
    # exchanges, whose hot digests Spark can split
    counts = stage(counts.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return rows.join(counts, "content").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all ``documents`` for byte_bpe_50k.json, with a new cache."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_path(spark, "token-cache"))
