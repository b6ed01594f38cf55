"""Toxic passages as maximum-scoring segments.

Token scores are log-odds of the toxic against the clean class under a Dirichlet
prior (half a token each, and the corpus shares of the tokens). A token that says
nothing surely is scored by its first ``STEM`` bytes in the same way, so unseen
inflections count. One linear scan
per text finds all maximal scoring segments; extreme-value statistics (lambda
from the clean token distribution, K from the clean texts' best segments) turn
segment scores into p-values, and the significant ones are aggregated into the
text's evidence, which a logistic curve maps to a probability.

What is learned is small and bounded: counts of 2**BUCKETS_LOG2 hashed tokens
and stems and a few numbers, from at most ``MAX_PER_CLASS`` labelled texts of each class
(those of the smallest id hash). Every text is then scored whole in one narrow
pass: no shuffle, no key, bounded memory.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlfold.llm import bytetext
from crawlfold.llm.staging import free, stage
from crawlfold.session import ship_package

BUCKETS_LOG2 = 20
MAX_PER_CLASS = 15_000  # labelled texts of each class that are learned from
PRIOR_TOKENS = 500.0  # weight of the prior's corpus shares, in tokens
SURE = 1.5  # standard errors that a score is taken below its estimate
STEM = 4  # bytes of the stem of a token that is longer by 2 at least
DRIFT = 0.25  # what a token that says nothing costs
ALPHA = 0.01  # significance of a passage

SEGMENT = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                        T.StructField("score", T.DoubleType()), T.StructField("p_value", T.DoubleType())])


@dataclass
class Model:
    """Scores by token bucket (not a number: unsure) and by stem bucket (the last
    is for tokens without a stem), and the calibration."""

    scores: np.ndarray
    stems: np.ndarray
    lam: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    prior: float = 0.0
    trained: bool = False


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of a score sequence,
    in order, in linear time. Runs without a positive score are single steps."""
    above = np.flatnonzero(scores > 0)
    if not len(above):
        return []
    cuts = above[np.flatnonzero(np.diff(above, prepend=-2) > 1)]  # starts of positive runs
    stops = above[np.flatnonzero(np.diff(above, append=len(scores) + 2) > 1)] + 1
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[float, float, int, int]] = []  # left sum, right sum, start, end
    best: list[int] = []  # for each, the nearest earlier candidate of smaller left sum
    for a, b in zip(cuts.tolist(), stops.tolist()):
        left, right = float(sums[a]), float(sums[b])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = best[j]
            if j < 0 or found[j][1] >= right:
                found.append((left, right, a, b))
                best.append(j)
                break
            left, a = found[j][0], found[j][2]
            del found[j:], best[j:]
    return [(a, b, right - left) for left, right, a, b in found]


def sure_scores(counts: DataFrame) -> DataFrame:
    """``(bucket, score, clean)`` of a table ``(bucket, clean, toxic)`` of token and
    stem buckets: the log-odds ratio under the Dirichlet prior, pulled towards 0
    by ``SURE`` standard errors, less the drift. Buckets that are left with
    nothing are not returned. Each of the two kinds has its own totals."""
    kind = (F.col("bucket") >= N).alias("stem")
    totals = counts.groupBy(kind).agg(F.sum("toxic").alias("all_toxic"), F.sum("clean").alias("all_clean"))  # two rows
    both = counts.withColumn("stem", kind).join(F.broadcast(totals), "stem")
    share = (F.col("toxic") + F.col("clean")) / F.greatest(F.col("all_toxic") + F.col("all_clean"), F.lit(1))
    prior = F.lit(0.5) + F.lit(PRIOR_TOKENS) * share
    rest = 0.5 * N + PRIOR_TOKENS
    y = both.select("bucket", "clean", (F.col("toxic") + prior).alias("y1"), (F.col("clean") + prior).alias("y0"),
                    (F.col("all_toxic") + rest).alias("n1"), (F.col("all_clean") + rest).alias("n0"))
    odds = F.ln(F.col("y1") / (F.col("n1") - F.col("y1"))) - F.ln(F.col("y0") / (F.col("n0") - F.col("y0")))
    y = y.select("bucket", "clean", odds.alias("odds"), (SURE * F.sqrt(1 / F.col("y1") + 1 / F.col("y0"))).alias("margin"))
    score = F.when(F.col("odds") > F.col("margin"), F.col("odds") - F.col("margin")).when(
        F.col("odds") < -F.col("margin"), F.col("odds") + F.col("margin")) - DRIFT
    return y.select("bucket", score.alias("score"), "clean").filter(F.col("score").isNotNull())


def solve_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1 over clean tokens (1 where no
    clean token scores above 0)."""
    def excess(x):
        return float((weights * np.exp(np.minimum(x * scores, 50.0))).sum()) - 1.0

    if not weights.sum() or not (scores[weights > 0] > 0).any():
        return 1.0
    low, high = 1e-4, 4.0
    if excess(low) >= 0 or excess(high) <= 0:
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def fit_k(top: np.ndarray, n: np.ndarray, lam: float) -> float:
    """ln K such that clean texts exceed the 99th percentile of their best
    scores as often as the extreme-value law says (most have no segment at all,
    so the law's mean would not do)."""
    if not len(top):
        return 0.0
    cut = max(float(np.quantile(top, 0.99)), 1.0)
    rate = (float((top >= cut).sum()) + 0.5) / (len(top) + 1.0)
    return math.log(-math.log1p(-min(rate, 0.99))) + lam * cut - math.log(max(float(n.mean()), 1.0))


def evidence(segments, n_tokens: int, model: Model) -> tuple[float, float, list]:
    """Normalised score of the best segment, sum over the significant ones, and
    these with p-values. The extreme-value law: P(best > s) = 1 - exp(-K n e^(-lambda s))."""
    base, best, total, kept = model.log_k + math.log(max(n_tokens, 1)), -20.0, 0.0, []
    for a, b, s in segments:
        x = model.lam * s - base
        best = max(best, x)
        p = -math.expm1(-math.exp(-x)) if x > -3 else 1.0
        if p <= ALPHA:
            total += x
            kept.append((a, b, s, p))
    return max(best, -20.0), math.log1p(total), kept


def probability(best: float, total: float, model: Model) -> float:
    if not model.trained:
        return model.prior
    z = model.weights[0] + model.weights[1] * best + model.weights[2] * total
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(a.shape[1]), np.diag([1e-6, *[1e-2] * x.shape[1]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -35, 35)))
        step = np.linalg.solve((a.T * (w * np.maximum(p * (1 - p), 1e-6))) @ a + ridge, a.T @ (w * (y - p)) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


N = 1 << BUCKETS_LOG2


def _tokens(column):
    """Chunks of ``(bucket of each token, stem bucket, tokens a text, byte
    starts, byte ends, bytes, offsets)``."""
    data, offsets = bytetext.buffers(column)
    for i, j in bytetext.slices(offsets):
        own = offsets[i:j + 1] - offsets[i]
        chunk = data[offsets[i]:offsets[j]]
        hashes, counts, starts, ends = bytetext.words(chunk, own, bytetext.NON_LETTERS)
        stem, long = np.zeros(len(starts), dtype=np.uint64), ends - starts >= STEM + 2
        for k in range(STEM):
            stem = (stem << np.uint64(8)) | bytetext.LOWER[chunk[np.minimum(starts + k, ends - 1)]].astype(np.uint64)
        shift = np.uint64(64 - BUCKETS_LOG2)
        stems = np.where(long, (bytetext.mix(stem) >> shift).astype(np.int64), N)  # N: none
        yield (hashes >> shift).astype(np.int64), stems, counts, starts, ends, chunk, own


def _count(batches):
    """Texts per (bucket, class) of one task; stem buckets follow the tokens'."""
    totals = np.zeros((2, 2 * N), dtype=np.int64)
    for batch in batches:
        labels, at = batch.column("_y").to_numpy(zero_copy_only=False), 0
        for buckets, stems, counts, *_ in _tokens(batch.column("_text")):
            texts = np.repeat(np.arange(len(counts)), counts) * (2 * N + 1)
            for own in (buckets, stems + N):
                once = np.unique(texts + own)  # a text counts once for a token
                y, token = labels[at + once // (2 * N + 1)], once % (2 * N + 1)
                for k in (0, 1):
                    totals[k] += np.bincount(token[y == k], minlength=2 * N + 1)[:2 * N]
            at += len(counts)
    used = np.flatnonzero(totals.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[0, used]), pa.array(totals[1, used])],
                                     names=["bucket", "clean", "toxic"])


def _scan(shared):
    def run(column):
        model = shared.value
        for buckets, stems, counts, starts, ends, data, offsets in _tokens(column):
            scores = model.scores[buckets]
            scores = np.where(np.isnan(scores), model.stems[stems], scores).astype(np.float64)
            first = np.concatenate([[0], np.cumsum(counts)])
            for i, n in enumerate(counts.tolist()):
                a = int(first[i])
                segments = maximal_segments(scores[a:a + n]) if n else []
                best, total, kept = evidence(segments, n, model)

                def character(byte, text=i):  # bytes that start a character
                    return int(((data[offsets[text]:byte] & 0xC0) != 0x80).sum())
                yield n, best, total, max((s for _, _, s in segments), default=0.0), [
                    {"start": character(int(starts[a + x])), "end": character(int(ends[a + y - 1])), "score": s, "p_value": p}
                    for x, y, s, p in kept]
    return run


def _features(shared):
    scan = _scan(shared)

    def run(batches):
        for batch in batches:
            rows = [r[:4] for r in scan(batch.column("_text"))]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("_y"), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[1:])],
                names=["y", "n", "best", "total", "top"])
    return run


def held_out(id_col) -> F.Column:
    """True for ids whose crc32 (of the decimal text) is divisible by 5; a null
    id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from labelled rows outside the held-out fold.

    A repeated label row counts once, contradicting ones as toxic; null labels
    do not count. Two thirds of the sampled texts (by id hash) give the token
    scores, the others the calibration. Without texts of both classes the model
    scores every text with the share of toxic labels (0 without labels).
    """
    spark = docs.sparkSession
    ship_package(spark)
    labelled = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna()
    labelled = labelled.filter(~held_out("_id")).groupBy("_id").agg(F.max(F.when(F.col("_y") > 0, 1).otherwise(0)).alias("_y"))
    share = {r["_y"]: r["n"] for r in labelled.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = share.get(1, 0) / max(sum(share.values()), 1)
    blank = Model(np.full(N, np.nan, dtype=np.float32), np.full(N + 1, -DRIFT, dtype=np.float32), prior=prior)
    if len(share) < 2:
        return blank
    key = F.xxhash64("_id")
    sampled = [labelled.filter(F.col("_y") == k).orderBy(key, "_id").limit(MAX_PER_CLASS) for k in (0, 1)]
    # at most 2 * MAX_PER_CLASS rows of 12 bytes: bounded, so it may be broadcast
    sample = F.broadcast(sampled[0].unionByName(sampled[1]))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(sample, "_id")
    third = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(3))

    counts = texts.filter(third > 0).select("_text", "_y").mapInArrow(_count, "bucket bigint, clean bigint, toxic bigint")
    counts = counts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter("clean + toxic > 1")
    counts = stage(counts, "bucket-counts")
    all_clean, any_toxic = counts.filter(F.col("bucket") < N).agg(F.sum("clean"), F.sum("toxic")).first()
    if not all_clean or not any_toxic:
        return blank
    got = sure_scores(counts).toPandas()  # the sure ones of 2 * 2**BUCKETS_LOG2 buckets
    free(counts)
    token, scores, clean = got["bucket"].to_numpy(), got["score"].to_numpy(), got["clean"].to_numpy(dtype=float)
    model = blank
    model.trained = True
    model.scores[token[token < N]] = scores[token < N]
    model.stems[token[token >= N] - N] = scores[token >= N]
    # tokens that say nothing surely score minus the drift
    weights = clean[token < N] / float(all_clean)
    model.lam = solve_lambda(np.append(scores[token < N], -DRIFT), np.append(weights, max(1.0 - weights.sum(), 0.0)))

    shared = spark.sparkContext.broadcast(model)
    other = texts.filter(third == 0).select("_text", "_y").mapInArrow(
        _features(shared), "y int, n bigint, best double, total double, top double").toPandas()  # at most 2 * MAX_PER_CLASS rows
    shared.destroy()
    if other["y"].nunique() < 2:
        return Model(np.full(N, np.nan, dtype=np.float32), np.full(N + 1, -DRIFT, dtype=np.float32), prior=prior)
    null = other[(other["y"] == 0) & (other["n"] > 0)]
    model.log_k = fit_k(null["top"].to_numpy(), null["n"].to_numpy(), model.lam)
    # with K known, each segment's evidence is too
    shared = spark.sparkContext.broadcast(model)
    final = texts.filter(third == 0).select("_text", "_y").mapInArrow(
        _features(shared), "y int, n bigint, best double, total double, top double").toPandas()
    shared.destroy()
    y = final["y"].to_numpy(dtype=float)
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    model.weights = tuple(_logistic(final[["best", "total"]].to_numpy(), y, weight).tolist())
    return model


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity",
                segments_col: str = "toxic_segments") -> DataFrame:
    """``docs`` with the probability and the significant passages (character
    spans, end exclusive) of each text; every column and row stays. Null texts
    are empty. Columns of these two names are replaced."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    base = docs.drop(score_col, segments_col)
    schema = T.StructType([*base.schema.fields, T.StructField(score_col, T.DoubleType()),
                           T.StructField(segments_col, T.ArrayType(SEGMENT))])
    position = base.columns.index(text_col)
    scan = _scan(shared)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def run(batches):
        for batch in batches:
            rows = list(scan(batch.column(position)))
            p = [probability(r[1], r[2], shared.value) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array([r[4] for r in rows], kind)],
                                             names=schema.fieldNames())
    return base.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; learned from ``labels.toxic``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_texts(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "toxic_segments")
