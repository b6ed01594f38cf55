"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

A text is the multiset of its white-space-separated words, weighted by count.
For sample k and word w, two hashes give r ~ Gamma(2, 1), c ~ Gamma(2, 1) and
b ~ U(0, 1), the same in every text. With weight S, t = floor(ln S / r + b) and
a = c exp(-r (t - b + 1)); the word of least a is the sample, and (word, t)
agrees between two texts with probability sum(min) / sum(max), the generalised
Jaccard similarity. As a is a function of (word, t), the least a itself stands
for the sample. A fingerprint is 32 bits of each of ``SAMPLES`` samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlfold.llm.staging import free, stage

SAMPLES = 32
WORD_GAP = r"[\x20\x09-\x0D]+"
_LOW = (1 << 25) - 1


def _a(word: Column, log_weight: Column, k: int) -> Column:
    """The value a of sample ``k``: five uniform numbers from 128 hashed bits."""
    x, y = F.xxhash64(word, F.lit(2 * k)), F.xxhash64(word, F.lit(2 * k + 1))

    def low(h: Column) -> Column:
        return h.bitwiseAND(F.lit(_LOW)).cast("double") + 0.5

    def mid(h: Column) -> Column:
        return F.shiftrightunsigned(h, 25).bitwiseAND(F.lit(_LOW)).cast("double") + 0.5

    # a sum of two exponential numbers is -ln of a product of two uniform ones
    r = -F.ln(low(x) * mid(x) * 2.0 ** -50)
    c = -F.ln(low(y) * mid(y) * 2.0 ** -50)
    b = (F.shiftrightunsigned(x, 50).cast("double") * 16384.0 + F.shiftrightunsigned(y, 50).cast("double") + 0.5) * 2.0 ** -28
    return c * F.exp(-r * (F.floor(log_weight / r + b).cast("double") - b + 1.0))


def sample_rows(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` and ``samples`` (array of int) of rows that each have a key of
    their own; texts without words are absent. Both groupings follow the
    partitioning of ``rows`` where that is by (some of) ``keys``."""
    words = rows.select(*keys, F.explode(F.split(text_col, WORD_GAP, -1)).alias("_w")).filter("_w <> ''")
    counted = words.select(*keys, F.xxhash64("_w").alias("_h")).groupBy(*keys, "_h").agg(F.ln(F.count(F.lit(1)).cast("double")).alias("_s"))
    least = counted.groupBy(*keys).agg(*[F.min(_a(F.col("_h"), F.col("_s"), k)).alias(f"_a{k}") for k in range(SAMPLES)])
    return least.select(*keys, F.array(*[F.hash(f"_a{k}") for k in range(SAMPLES)]).alias("samples"))


def to_text(samples: Column) -> Column:
    """Hexadecimal fingerprint; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; 1 for two texts without words, 0 for one."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(SAMPLES))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, samples, fingerprint)`` of each distinct row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), F.xxhash64(F.lit(1), id_col, text).alias("_k1"), F.xxhash64(F.lit(2), text, id_col).alias("_k2"), text.alias("_text"))
    rows = rows.dropDuplicates(["_k1", "_k2"])
    samples = sample_rows(rows, ["_k1", "_k2"], "_text")
    return rows.join(samples, ["_k1", "_k2"], "left").select(id_col, "samples", to_text(F.col("samples")).alias("fingerprint"))


def successors(rows: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """``rows`` with ``next_<c>`` of the row that follows in ``order`` (after the
    last: the first). Rows are dealt by range, so each task orders its own share;
    only one row per partition is ordered on its own."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    here = F.struct(*columns)
    after = dealt.withColumn("_next", F.lead(here).over(Window.partitionBy("_part").orderBy(*order)))
    after = after.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    after = stage(after, "followed")
    free(dealt)
    heads = after.filter("_rank = 1").select("_part", here.alias("_head"))  # a row per partition
    w = Window.orderBy("_part")
    heads = heads.withColumn("_following", F.coalesce(F.lead("_head").over(w), F.first("_head").over(w)))
    joined = after.join(F.broadcast(heads.select("_part", "_following")), "_part")
    found = F.coalesce("_next", "_following")
    return joined.select(*rows.columns, *[found[c].alias(f"next_{c}") for c in columns])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, a row per row of
    ``docs``: ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next)``.

    Edited: the last floor(n_chars / 2) code points are replaced by as many
    first ones (or all) of the next document, by descending id (nulls last,
    ties by text hash; after the last: the first). Rows that repeat both id and
    text are one document. Null texts are empty; texts without words have an
    empty fingerprint. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.lit(1), id_col, text).alias("k1"),
                       F.xxhash64(F.lit(2), text, id_col).alias("k2"), text.alias("_text"))
    narrow = rows.groupBy("_id", "k1", "k2", F.length("_text").alias("n")).agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col("_id").desc_nulls_last(), F.col("k1").asc(), F.col("k2").asc()]
    follow = stage(successors(narrow, order, ["k1", "k2"]), "successors")

    # every text once, by its key: all uses below read this one exchange
    texts = rows.select("k1", "k2", "_text").dropDuplicates(["k1", "k2"])
    wanted = follow.select(F.col("k1").alias("of1"), F.col("k2").alias("of2"), F.expr("n div 2").alias("take"),
                           F.col("next_k1").alias("k1"), F.col("next_k2").alias("k2"))
    tails = texts.join(wanted, ["k1", "k2"]).select(
        F.col("of1").alias("k1"), F.col("of2").alias("k2"), F.substr("_text", F.lit(1), F.col("take").cast("int")).alias("_tail"))
    half = F.length("_text") - F.expr("length(_text) div 2")
    edits = texts.join(tails, ["k1", "k2"]).select(
        "k1", "k2", F.concat(F.substr("_text", F.lit(1), half.cast("int")), "_tail").alias("_edited"))
    signed = (edits.select("k1", "k2", F.unhex(F.sha2("_edited", 256)).alias("sha"))
              .join(sample_rows(texts, ["k1", "k2"], "_text").withColumnRenamed("samples", "own"), ["k1", "k2"], "left")
              .join(sample_rows(edits, ["k1", "k2"], "_edited").withColumnRenamed("samples", "edited"), ["k1", "k2"], "left"))
    signed = stage(signed, "samples")

    following = signed.select(F.col("k1").alias("next_k1"), F.col("k2").alias("next_k2"), F.col("own").alias("following"))
    joined = follow.join(following, ["next_k1", "next_k2"]).join(signed, ["k1", "k2"])
    # rows that repeat a document get its result: as often as it stands there
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(
        F.col("_id").alias(id_col), F.col("n").cast("bigint").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"),
        to_text(F.col("own")).alias("fingerprint"), to_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
