"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into balanced parts
(equal splits along principal directions, refined by moves towards the parts
of a node's neighbours under a size limit); a small network with one hidden
layer learns the shares of a point's neighbours in each part. Every row is
then stored under its most probable part, and a query goes to its most
probable parts until their mass is ``mass``, a threshold chosen on the sample
for a recall of ``TARGET``. A part that holds over ``SPLIT`` times the rows
aimed at is cut again in the same way, by a router fitted on a bounded sample of
its own rows, so leaves keep their size up to MAX_PARTS ** 2 of them. Candidates
are ranked by exact inner products in double precision.

Rows of a leaf are dealt to blocks of about ``BLOCK`` rows, each sent once; the
queries of the leaf stream past each block, so memory is bounded by a block
however large or popular a leaf is.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlfold.llm.staging import free, stage
from crawlfold.session import ship_package

SAMPLE = 8192  # rows that a router is learned from (of the table, or of a part)
NEIGHBOURS = 10  # of each sample row in the graph
ROWS_PER_PART = 4096  # aimed at
SPLIT = 4  # a part of more than so many times the rows aimed at has parts of its own
MAX_PARTS = 128  # of one router
HIDDEN = 128
TARGET, TARGET_BELOW = 0.95, 0.98  # recall aimed at on the sample, and within a part that is cut again
BLOCK, QUERY_BLOCK = 4096, 128  # rows held by a task, and queries compared with them at a time


@dataclass
class Router:
    """The classifier, and the probability mass that queries are routed to."""

    parts: int
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def route(self, p: np.ndarray) -> np.ndarray:
        """Mask of the parts that each query visits."""
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, axis=1)
        visit = np.cumsum(ranked, axis=1) - ranked < self.mass
        out = np.zeros_like(visit)
        np.put_along_axis(out, order, visit, axis=1)
        return out


@dataclass
class Tree:
    """The router of all rows, and those of its large parts. A leaf is numbered
    ``part << 16 | part of the part``."""

    top: Router
    below: dict[int, Router] = field(default_factory=dict)  # by the number of leaf 0 of the part

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row is stored under."""
        leaf = self.top.probabilities(x).argmax(axis=1) << 16
        for first, router in self.below.items():
            own = np.flatnonzero(leaf == first)
            if len(own):
                leaf[own] += router.probabilities(x[own]).argmax(axis=1)
        return leaf

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and the leaves they visit, by place."""
        visit = self.top.route(self.top.probabilities(x))
        at, leaf = [], []
        for part in np.flatnonzero(visit.any(axis=0)):
            own, first = np.flatnonzero(visit[:, part]), int(part) << 16
            if first in self.below:
                router = self.below[first]
                row, sub = np.nonzero(router.route(router.probabilities(x[own])))
                at.append(own[row])
                leaf.append(first + sub)
            else:
                at.append(own)
                leaf.append(np.full(len(own), first))
        at, leaf = np.concatenate(at), np.concatenate(leaf)
        order = np.argsort(at, kind="stable")
        return at[order], leaf[order]


def nearest(x: np.ndarray, k: int, queries: np.ndarray | None = None) -> np.ndarray:
    """Rows of the ``k`` largest inner products with each query row's vector,
    itself left out."""
    q = np.arange(len(x)) if queries is None else queries
    out = np.empty((len(q), k), dtype=np.int64)
    for i in range(0, len(q), 512):
        s = x[q[i:i + 512]] @ x.T
        s[np.arange(len(s)), q[i:i + 512]] = -np.inf
        out[i:i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Part of each node: sizes within ``slack`` times the mean, few edges cut."""
    n, label = len(x), np.zeros(len(x), dtype=np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:  # equal splits along the main direction of each piece
        rows, first, k = todo.pop()
        if k == 1:
            label[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        _, v = np.linalg.eigh(centred.T @ centred)
        order = np.argsort(centred @ v[:, -1], kind="stable")
        cut = len(rows) * (k // 2) // k
        todo += [(rows[order[:cut]], first, k // 2), (rows[order[cut:]], first + k // 2, k - k // 2)]
    limit = math.ceil(slack * n / parts)
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (source, label[target]), 1)
        np.add.at(votes, (target, label[source]), 1)
        want = votes.argmax(axis=1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), label]
        sizes = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[want[i]] < limit:
                sizes[label[i]] -= 1
                sizes[want[i]] += 1
                label[i] = want[i]
                moved += 1
        if not moved:
            break
    return label


def fit(x: np.ndarray, rows: int, target: float, rows_per_part: int, max_parts: int, seed: int = 7, epochs: int = 40) -> Router:
    """A router for a table (or part) of ``rows`` rows from the sample ``x``."""
    parts = int(min(max(1, math.ceil(rows / rows_per_part)), max_parts, max(1, len(x) // 64)))
    rng = np.random.Generator(np.random.PCG64(seed))
    dim = x.shape[1]
    net = Router(parts, rng.normal(0, (2 / dim) ** 0.5, (dim, HIDDEN)), np.zeros(HIDDEN),
                 rng.normal(0, HIDDEN ** -0.5, (HIDDEN, parts)), np.zeros(parts))
    if parts == 1:
        return net
    k = min(NEIGHBOURS, len(x) - 1)
    graph = nearest(x, k)
    label = balanced_parts(x, graph, parts)
    aim = np.zeros((len(x), parts))
    np.add.at(aim, (np.repeat(np.arange(len(x)), k), label[graph.ravel()]), 1 / (k + 2))
    aim[np.arange(len(x)), label] += 2 / (k + 2)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    weights = [net.w1, net.b1, net.w2, net.b2]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            own = order[i:i + 256]
            hidden = np.maximum(unit[own] @ net.w1 + net.b1, 0)
            d = (net.probabilities(unit[own]) - aim[own]) / len(own)
            dh = (d @ net.w2.T) * (hidden > 0)
            grads = [unit[own].T @ dh + 1e-4 * net.w1, dh.sum(axis=0), hidden.T @ d + 1e-4 * net.w2, d.sum(axis=0)]
            step += 1
            rate = 3e-3 * (1 - epoch / epochs) + 1e-4
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    p = net.probabilities(x)
    stored, asked = p.argmax(axis=1), rng.choice(len(x), min(1000, len(x)), replace=False)
    near = nearest(x, k, asked)
    for net.mass in (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999, 1.0):
        visit = net.route(p[asked])
        if np.take_along_axis(visit, stored[near], axis=1).mean() >= target:
            break
    return net


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vid, vec)`` of rows that take part: an id, and a vector that is not
    null, empty or zero and has neither null nor non-finite components; of
    these, the vectors of the most frequent length (the longer of two)."""
    vec = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vid"), vec.alias("vec")).filter(
        F.col("vid").isNotNull() & (F.size("vec") > 0)
        & F.forall("vec", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(c), F.lit(True)))
        & F.exists("vec", lambda c: c != 0))
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    return rows.filter(F.size("vec") == (sizes[0]["dim"] if sizes else 0))


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _assign(shared):
    def run(batches):
        for batch in batches:
            leaf = shared.value.leaves(_matrix(batch.column("vec"))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("vid"), batch.column("vec"), pa.array(leaf, pa.int32())], names=["vid", "vec", "part"])
    return run


def _routes(shared):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):  # a query may visit many leaves
                own = batch.slice(i, 512)
                at, leaf = shared.value.visits(_matrix(own.column("vec")))
                first = np.searchsorted(at, np.arange(own.num_rows + 1))
                parts = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(leaf, pa.int32()))
                yield pa.RecordBatch.from_arrays([*own.columns, parts], names=["vid", "vec", "parts"])
    return run


def _fit_part(rows_per_part: int, max_parts: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vid", kind="stable")
        router = fit(np.stack(rows["vec"].to_numpy()), int(rows["n"].iloc[0]), TARGET_BELOW, rows_per_part, max_parts)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "router": [pickle.dumps(router)]})
    return run


def _best(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, qx: np.ndarray, k: int) -> list[np.ndarray]:
    """Query ids, ids and scores of the ``k`` best rows of a block for each query."""
    repeated, out = len(ids) > len(np.unique(ids)), ([], [], [])
    for q, v, fast in zip(asked, qx, qx @ x.T):
        fast[ids == q] = -np.inf
        # what may be among the first k but for rounding is ranked exactly, row by row
        # in one order of summation; repeats of an id could fill the first k, so then all are
        least = np.partition(fast, -k)[-k] if len(fast) > k and not repeated else -np.inf
        near = np.flatnonzero((fast >= least - 1e-9 * (abs(least) + 1)) & (fast > -np.inf))
        score = (x[near] * v).sum(axis=1)
        order = np.lexsort((ids[near], -score))
        if repeated:
            order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])]
        order = order[:k]
        out[0].append(np.full(len(order), q))
        out[1].append(ids[near][order])
        out[2].append(score[order])
    return [np.concatenate(o) for o in out]


def _top(k: int, at_once: int):
    """Over rows sorted by (part, b, asked): the rows of a block are held, then
    its queries stream past them."""
    def run(batches):
        key, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, b, asked, vid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "b", "asked", "vid"))
            changes = np.flatnonzero((np.diff(part) != 0) | (np.diff(b) != 0) | (asked[1:] != asked[:-1])) + 1
            for i, j in zip([0, *changes], [*changes, len(vid)]):
                if key != (part[i], b[i]):
                    key, held, block = (part[i], b[i]), [], None
                x = _matrix(batch.column("vec").slice(i, j - i))
                if not asked[i]:
                    held.append((vid[i:j], x))
                    continue
                if held and block is None:
                    block, held = tuple(np.concatenate(c) for c in zip(*held)), []
                for t in range(0, j - i if block else 0, at_once):
                    found = _best(*block, vid[i:j][t:t + at_once], x[t:t + at_once], k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])
    return run


def _below(stored: DataFrame) -> dict[int, Router]:
    """Routers of the parts that hold too many rows. At most MAX_PARTS routers
    of some 200 kB reach the driver, each fitted in a task of its own on at most
    SAMPLE rows of its part."""
    large = stored.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT * ROWS_PER_PART)
    # at most MAX_PARTS rows; about 2 * SAMPLE rows of a part pass the hash, so no window holds more
    mixed = F.xxhash64(F.lit("sample"), "vid", "vec")
    drawn = stored.join(F.broadcast(large), "part").filter(F.shiftrightunsigned(mixed, 11).cast("double") * 2.0 ** -53 < 2.0 * SAMPLE / F.col("n"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(mixed, "vid"))
    drawn = drawn.withColumn("place", place).filter(F.col("place") <= SAMPLE).drop("place")
    fitted = drawn.groupBy("part").applyInPandas(_fit_part(ROWS_PER_PART, MAX_PARTS), "part int, router binary")
    return {r["part"]: pickle.loads(r["router"]) for r in fitted.collect()}


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each query
    among all rows of ``vectors`` with another id, largest inner product first,
    ties to the smaller id; all candidates if fewer.

    Rows of ``usable`` only take part (on both sides). A repeated id is one
    candidate, with the best of its scores; a repeated query id is one query,
    its smallest vector. Empty tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    index = stage(usable(vectors, id_col, vector_col).distinct(), "vectors")
    rows = index.count()
    schema = "query_id bigint, vec_id bigint, score double"
    if not rows:
        return spark.createDataFrame([], schema).selectExpr("query_id", "cast(0 as int) as rank", "vec_id", "score")
    sample = index.orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).toPandas()  # bounded
    tree = Tree(fit(np.stack(sample["vec"].to_numpy()), rows, TARGET, ROWS_PER_PART, MAX_PARTS))
    dim = len(sample["vec"][0])
    shared = spark.sparkContext.broadcast(tree)
    stored = stage(index.mapInArrow(_assign(shared), "vid bigint, vec array<double>, part int"), "parts")
    free(index)
    below = _below(stored)
    if below:
        coarse, shared = stored, spark.sparkContext.broadcast(Tree(tree.top, below))
        stored = stage(coarse.mapInArrow(_assign(shared), coarse.schema), "leaves")
        free(coarse)
    asked = usable(queries, id_col, vector_col).filter(F.size("vec") == dim).groupBy("vid").agg(F.min("vec").alias("vec"))
    routed = asked.mapInArrow(_routes(shared), "vid bigint, vec array<double>, parts array<int>")
    routed = routed.select("vid", "vec", F.explode("parts").alias("part"))

    # a row per leaf, at most MAX_PARTS ** 2 small rows, so it may be broadcast
    sizes = F.broadcast(stored.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    dealt = F.pmod(F.xxhash64("vid", "vec"), "blocks").cast("int")
    left = stored.join(sizes, "part").select("part", dealt.alias("b"), F.lit(False).alias("asked"), "vid", "vec")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    right = routed.join(sizes, "part").select("part", every.alias("b"), F.lit(True).alias("asked"), "vid", "vec")
    met = left.unionByName(right).repartition("part", "b").sortWithinPartitions("part", "b", "asked", "vid")
    found = met.mapInArrow(_top(k, QUERY_BLOCK), schema)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row of ``embeddings`` with an id divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
