"""Soft-membership mixing of a corpus to target weights.

A classifier fitted on a labelled table gives each document posteriors p over
domains. Projected-gradient least squares then finds document rates x >= 0 with
expected domain tokens  sum_i n_i p_ik x_i = target_k:  from x = 1,

    x_i <- max(0, x_i - p_i . y),   y = G^-1 (A x - b),   G = sum_i n_i p_i p_i'

which is the projected gradient step in the metric that weights a document by
its tokens n_i (so equal posteriors get equal rates). A x is one distributed sum
of a few numbers per step; rates follow from the list of steps y, so no state
of the documents is kept, joined or collected.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlfold.llm import bytetext
from crawlfold.llm.staging import stage, unused
from crawlfold.session import ship_package

MAX_PER_DOMAIN = 5_000  # labelled documents of each domain that are learned from
STEPS, TOLERANCE = 40, 1e-9
QUALITY_TARGETS = {"1": 0.95, "0": 0.05}  # token shares of the registered query


@dataclass
class Mix:
    """A fitted mixture."""

    domains: list[str]
    weights: np.ndarray  # of the classifier: features x domains
    centre: np.ndarray
    scale: np.ndarray
    targets: dict[str, float] = field(default_factory=dict)
    steps: list[list[float]] = field(default_factory=list)
    max_rate: float = float("inf")
    residual: float = 0.0

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), (x - self.centre) / self.scale]) @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text (square roots of byte shares, length, words, mean
    word length, share of distinct words and lines) and its words."""
    data, offsets = bytetext.buffers(column)
    rows, n_words = [], []
    for i, j in bytetext.slices(offsets):
        own, chunk = offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]]
        hashes, counts, _, _ = bytetext.words(chunk, own)
        first = np.concatenate([[0], np.cumsum(counts)])
        for t, n in enumerate(counts.tolist()):
            text = chunk[own[t]:own[t + 1]]
            size = max(len(text), 1)
            distinct = len(np.unique(hashes[first[t]:first[t + 1]]))
            shares = np.sqrt(np.bincount(text, minlength=256) / size)
            rows.append(np.concatenate([shares, [np.log1p(len(text)), np.log1p(n), (size - n) / max(n, 1), distinct / max(n, 1)]]))
            n_words.append(n)
    return np.array(rows).reshape(-1, 260), np.array(n_words, dtype=np.int64)


def _softmax_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, steps: int = 300) -> np.ndarray:
    """Weighted ridge multinomial regression by accelerated gradient steps, over
    ``x`` in single precision (one copy, as it is the largest thing on the driver)."""
    a = np.empty((len(x), x.shape[1] + 1), dtype=np.float32)
    a[:, 0], a[:, 1:] = 1.0, x
    beta = previous = np.zeros((a.shape[1], k))
    one_hot = np.eye(k)[y]
    gram = np.zeros((a.shape[1], a.shape[1]))
    for i in range(0, len(a), 1024):
        own = a[i:i + 1024].astype(np.float64)
        gram += (own * w[i:i + 1024, None]).T @ own
    rate = 1.0 / (0.5 * np.linalg.eigvalsh(gram / w.sum())[-1] + 1e-3)
    for t in range(steps):
        ahead = beta + (t / (t + 3)) * (beta - previous)
        z = (a @ ahead.astype(np.float32)).astype(np.float64)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        previous, beta = beta, ahead - rate * (a.T @ ((p - one_hot) * w[:, None]).astype(np.float32) / w.sum() + 1e-3 * ahead)
    return beta


def _sampled(batches):
    for batch in batches:
        x, _ = features(batch.column("_text"))
        yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["y", "x"])


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str = "doc_id",
                   label_col: str = "domain", text_col: str = "text") -> Mix:
    """The classifier of ``domains`` from ``labels(id, label)``.

    Null labels and labels of other domains do not count; of contradicting rows
    of an id the greatest label holds. A domain without labelled documents gets
    no probability; without any, all domains are equally probable.
    """
    spark = docs.sparkSession
    ship_package(spark)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("string").alias("_d")).dropna()
    known = known.filter(F.col("_d").isin(domains)).groupBy("_id").agg(F.max("_d").alias("_d"))
    share = {r["_d"]: r["count"] for r in known.groupBy("_d").count().collect()}  # a row per domain
    number = F.element_at(F.create_map(*[F.lit(v) for i, d in enumerate(domains) for v in (d, i)]), F.col("_d"))
    sample = None
    for d in domains:
        own = known.filter(F.col("_d") == d).orderBy(F.xxhash64("_id"), "_id").limit(MAX_PER_DOMAIN)
        sample = own if sample is None else sample.unionByName(own)
    # at most MAX_PER_DOMAIN small rows a domain: bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(sample), "_id")
    rows = texts.select(number.cast("int").alias("_y"), "_text").mapInArrow(_sampled, "y int, x array<float>").toArrow()
    k = len(domains)
    if not rows.num_rows:
        return Mix(domains, np.zeros((261, k)), np.zeros(260), np.ones(260))
    x = pc.list_flatten(rows.column("x").combine_chunks()).to_numpy().reshape(rows.num_rows, 260)
    y = rows.column("y").to_numpy()
    centre = x.mean(axis=0, dtype=np.float64)
    scale = np.maximum(np.sqrt(sum(((x[i:i + 1024] - centre) ** 2).sum(axis=0) for i in range(0, len(x), 1024)) / len(x)), 1e-3)
    counts = np.bincount(y, minlength=k)
    truth = np.array([share.get(d, 0) for d in domains], dtype=float)
    weight = (truth / np.maximum(counts, 1))[y]
    beta = _softmax_fit((x - centre.astype(np.float32)) / scale.astype(np.float32), y, weight, k)
    beta[0, counts == 0] = -1e3
    return Mix(domains, beta, centre, scale)


def _members(shared):
    def run(batches):
        for batch in batches:
            x, n = features(batch.column("_text"))
            p = shared.value.posteriors(x)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], names=["n", "p"])
    return run


def _rate(p: list[Column], mix: Mix) -> Column:
    x = F.lit(1.0)
    for y in mix.steps:
        x = F.greatest(F.lit(0.0), F.least(F.lit(mix.max_rate), x - sum((c * v for c, v in zip(p, y)), F.lit(0.0))))
    return x


def fit_rates(docs: DataFrame, mix: Mix, targets: Mapping[str, float], text_col: str = "text",
              max_rate: float = float("inf")) -> Mix:
    """Steps that bring the expected tokens of each domain to ``targets`` (shares,
    scaled to 1). The total is that of ``docs``, or with a ``max_rate`` at most
    what the scarcest domain yields at that rate. What no rates within bounds
    can reach is met as nearly as least squares allow."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(mix)
    members = docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(_members(shared), "n bigint, p array<double>")
    members = stage(members.filter("n > 0"), "members")
    shared.destroy()
    k = len(mix.domains)
    p = [F.get("p", i) for i in range(k)]
    n = F.col("n").cast("double")
    cells = [F.sum(n * p[i] * p[j]) for i in range(k) for j in range(k)]
    first = members.agg(F.sum(n), *cells).first()
    tokens = float(first[0] or 0.0)
    share = np.array([max(float(targets.get(d, 0.0)), 0.0) for d in mix.domains])
    mix.targets = dict(zip(mix.domains, (share / max(share.sum(), 1e-300)).tolist()))
    mix.steps, mix.residual, mix.max_rate = [], 0.0, max_rate
    if not tokens:
        return mix
    gram = np.array(first[1:], dtype=float).reshape(k, k)
    wanted = np.array(list(mix.targets.values()))
    owned = gram.sum(axis=1)  # the posteriors sum to 1
    bounded = np.isfinite(max_rate)
    scarcest = min((max_rate * o / w if bounded else np.inf for o, w in zip(owned, wanted) if w > 0), default=0.0)
    aim = wanted * min(tokens, scarcest)
    inverse, best = np.linalg.pinv(gram, rcond=1e-12), np.inf
    for _ in range(STEPS):
        x = _rate(p, mix)
        rest = np.array(members.agg(*[F.sum(n * c * x) for c in p]).first(), dtype=float) - aim
        mix.residual, squares = float(np.abs(rest).max() / max(aim.sum(), 1e-300)), float(rest @ inverse @ rest)
        if mix.residual <= TOLERANCE or squares > best * (1 - 1e-4):
            break
        best = squares
        mix.steps.append((inverse @ rest).tolist())
    return mix


def _rated(shared, position, names):
    def run(batches):
        for batch in batches:
            mix = shared.value
            x, n = features(batch.column(position))
            p = mix.posteriors(x) if len(x) else np.zeros((0, len(mix.domains)))
            rate = np.ones(len(p))
            for y in mix.steps:
                rate = np.clip(rate - p @ np.array(y), 0.0, mix.max_rate)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(list(p), pa.list_(pa.float64())), pa.array(rate)], names=names)
    return run


ADDED = ("tokens", "posteriors", "rate")


def rate_documents(docs: DataFrame, mix: Mix, text_col: str = "text", added: tuple[str, str, str] = ADDED) -> DataFrame:
    """``docs`` with tokens (white-space-separated words), posteriors (in the
    order of ``mix.domains``) and the rate, in columns named ``added``; columns
    of these names are replaced. Null texts are empty; rows that repeat a document are rated alike."""
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.drop(*added)
    kinds = (T.LongType(), T.ArrayType(T.DoubleType()), T.DoubleType())
    schema = T.StructType([*base.schema.fields, *(T.StructField(n, k) for n, k in zip(added, kinds))])
    shared = spark.sparkContext.broadcast(mix)
    return base.mapInArrow(_rated(shared, base.columns.index(text_col), schema.fieldNames()), schema)


def apply_rates(rated: DataFrame, id_col: str = "doc_id", text_col: str = "text", added: tuple[str, str, str] = ADDED) -> DataFrame:
    """Each document as often as its rate says: the whole part of rate + u, where
    u in [0, 1) is a hash of the id and the text. The three added columns go."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("mix"), id_col, text_col), 11).cast("double")) * 2.0 ** -53
    copies = F.floor(F.col(added[2]) + u).cast("int")
    times, copy = unused(rated, "copies"), unused(rated, "copy")
    kept = rated.withColumn(times, copies).filter(F.col(times) > 0)
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(times, copy, *added)


def fit(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], id_col: str = "doc_id",
        label_col: str = "domain", text_col: str = "text", max_rate: float = float("inf")) -> Mix:
    """Classifier and rates for ``targets`` (domain -> share of tokens)."""
    mix = fit_classifier(docs, labels, sorted(targets), id_col, label_col, text_col)
    return fit_rates(docs, mix, targets, text_col, max_rate)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all ``documents``; the domains are the quality labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    mix = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), QUALITY_TARGETS, label_col="quality")
    return rate_documents(docs, mix).select("doc_id", "tokens", "posteriors", "rate")
