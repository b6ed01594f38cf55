"""Embedding whitening by an incremental eigendecomposition.

Vectors become integers (``floor(64 c) + 1000000``), so counts, sums and centred
values ``n x - S`` are exact. Each partition keeps mean and eigenpairs of its
scatter and takes one row after the other: a centred rank-one update, whose new
eigenvalues are the roots of a secular equation, between the old ones; entries
that do not couple and equal eigenvalues are deflated first. Spectra are merged
in a tree, each pair by successive rank-one updates (an eigenpair at a time, and
the difference of the means). At last all rows are projected on the merged basis
and the small projected covariance is diagonalised (Rayleigh-Ritz), which takes
the rounding of the updates out.

Only sums, spectra and matrices of the vectors' dimension reach the driver,
whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlfold.llm.staging import free, stage
from crawlfold.session import ship_package

COMPONENTS = 32
ROWS = 2048  # of a partition that one task updates through
FAN_IN = 8  # spectra merged by one task
STRAIGHTEN = 256  # updates between re-orthonormalisations

_EPS = np.finfo(float).eps


def _secular(poles: np.ndarray, weights: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(weights / (poles - t))`` for ascending distinct
    poles, one above each, as distances ``shift`` from the nearer pole
    (bisection), with the matrix of ``poles - that pole``."""
    r = len(poles)
    upper = np.append(poles[1:], poles[-1] + rho * weights.sum())
    middle = poles / 2 + upper / 2
    value = 1 + rho * (weights / (poles[None, :] - middle[:, None])).sum(axis=1)
    left = value >= 0
    left[-1] = True
    origin = np.where(left, np.arange(r), np.minimum(np.arange(r) + 1, r - 1))
    gaps = poles[None, :] - poles[origin][:, None]
    low = np.where(left, 0.0, middle - poles[origin])
    high = np.where(left, middle - poles, 0.0)
    high[-1] = upper[-1] - poles[-1]
    scaled = rho * weights
    for _ in range(48):
        at = (low + high) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            above = 1 + (1 / (gaps - at[:, None])) @ scaled >= 0
        high = np.where(above, at, high)
        low = np.where(above, low, at)
    return (low + high) / 2, gaps, origin


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``basis diag(values) basis' + rho vector vector'`` (rho > 0);
    ``basis`` has orthonormal columns and grows by the vector's new direction."""
    size = float(np.sqrt(vector @ vector))
    if size == 0 or rho <= 0:
        return values, basis
    z = basis.T @ vector
    rest = vector - basis @ z
    more = basis.T @ rest
    rest, z = rest - basis @ more, z + more
    beta = float(np.sqrt(rest @ rest))
    if beta > 64 * _EPS * size and basis.shape[1] < len(vector):
        basis = np.column_stack([basis, rest / beta])
        values, z = np.append(values, 0.0), np.append(z, beta)
    order = np.argsort(values, kind="stable")
    values, basis, z = values[order], basis[:, order], z[order]
    # deflation: of equal eigenvalues all but one are turned out of the vector's way
    scale = max(abs(values[-1]), rho * size * size)
    tolerance = 8 * _EPS * scale
    if (np.diff(values) <= tolerance).any():
        basis = basis.copy()
        for i in range(len(values) - 1):
            if values[i + 1] - values[i] <= tolerance and z[i] != 0:
                length = float(np.hypot(z[i], z[i + 1]))
                c, s = z[i + 1] / length, z[i] / length
                basis[:, i], basis[:, i + 1] = c * basis[:, i] - s * basis[:, i + 1], s * basis[:, i] + c * basis[:, i + 1]
                z[i], z[i + 1] = 0.0, length
    # and entries too small to move anything are left alone
    live = np.flatnonzero(rho * np.abs(z) * size > tolerance)
    if not len(live):
        return values, basis
    poles, zz = values[live], z[live]
    shift, gaps, origin = _secular(poles, zz * zz, rho)
    # entries that make the computed roots exact keep the new vectors orthogonal
    away = shift[:, None] - gaps  # root i minus pole j
    between = poles[:, None] - poles[None, :]
    np.fill_diagonal(between, 1.0)
    tiny = np.finfo(float).tiny
    logs = np.log(np.maximum(np.abs(away), tiny)).sum(axis=0) - np.log(np.maximum(np.abs(between), tiny)).sum(axis=0)
    exact = np.sign(zz) * np.exp((logs - np.log(rho)) / 2)
    away = np.where(np.abs(away) < tiny, tiny, away)
    turned = exact[None, :] / away
    turned /= np.sqrt((turned * turned).sum(axis=1, keepdims=True))
    values, basis = values.copy(), basis.copy()
    values[live] = poles[origin] + shift
    basis[:, live] = basis[:, live] @ turned.T
    return values, basis


class Spectrum:
    """Number of rows, mean and eigenpairs of the scatter of some rows."""

    def __init__(self, d: int, n: int = 0, mean=None, values=None, basis=None):
        self.n, self.mean = n, np.zeros(d) if mean is None else mean
        self.values = np.zeros(0) if values is None else values
        self.basis = np.zeros((d, 0)) if basis is None else basis
        self._updates = 0

    def _update(self, vector: np.ndarray, rho: float) -> None:
        self.values, self.basis = rank_one(self.values, self.basis, vector, rho)
        self._updates += 1
        if self._updates % STRAIGHTEN == 0 and self.basis.shape[1]:
            q, r = np.linalg.qr(self.basis)
            self.basis = q * np.sign(np.where(np.diag(r) == 0, 1.0, np.diag(r)))

    def add(self, row: np.ndarray) -> None:
        """Take one row: the centred rank-one update."""
        away = row - self.mean
        self._update(away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        """Take all rows of another spectrum, an eigenpair at a time."""
        if not other.n:
            return
        away = other.mean - self.mean
        self._update(away, self.n * other.n / (self.n + other.n))
        for value, vector in zip(other.values, other.basis.T):
            self._update(vector, float(value))
        self.mean = self.mean + away * (other.n / (self.n + other.n))
        self.n += other.n

    def row(self, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([self.n], pa.int64()), pa.array([self.mean.tolist()], pa.list_(pa.float64())),
             pa.array([self.values.tolist()], pa.list_(pa.float64())), pa.array([self.basis.T.ravel().tolist()], pa.list_(pa.float64()))],
            names=["part", "n", "mean", "values", "basis"])

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        mean, values = np.array(row["mean"], float), np.array(row["values"], float)
        return cls(len(mean), row["n"], mean, values, np.array(row["basis"], float).reshape(len(values), len(mean)).T)


_SPECTRUM = "part bigint, n bigint, mean array<double>, values array<double>, basis array<double>"


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _sums(batches):
    for batch in batches:
        x = _matrix(batch.column("x"))
        if len(x):
            big = np.abs(x).max() > (1 << 62) // len(x)
            total = x.astype(object).sum(axis=0) if big else x.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([[str(s) for s in total.tolist()]], pa.list_(pa.string()))],
                                             names=["n", "total"])


def _spectra(offset):
    def run(batches):
        from pyspark import TaskContext

        own = None
        for batch in batches:
            rows = (_matrix(batch.column("x")) - offset).astype(float)
            for row in rows:
                own = own or Spectrum(rows.shape[1])
                own.add(row)
        if own:
            yield own.row(TaskContext.get().partitionId())
    return run


def _merged(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    own = Spectrum.of(rows[0])
    for row in rows[1:]:
        own.merge(Spectrum.of(row))
    return pa.Table.from_batches([own.row(rows[0]["part"] // FAN_IN)])


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """``n x - S``, exact: 64-bit where that cannot overflow, else Python integers."""
    if len(x) and n * max(abs(int(x.min())), abs(int(x.max()))) < 1 << 61:
        return x * n - total.astype(np.int64)
    return x.astype(object) * n - total


def _projected(n, total, basis):
    """Partial sums of the projections, and of their products, a row per task."""
    def run(batches):
        first, second = np.zeros(basis.shape[1]), np.zeros((basis.shape[1],) * 2)
        for batch in batches:
            y = (_centred(_matrix(batch.column("x")), n, total) / n).astype(float) @ basis if batch.num_rows else np.zeros((0, basis.shape[1]))
            first += y.sum(axis=0)
            second += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([first, second.ravel()]).tolist()], pa.list_(pa.float64()))], names=["sums"])
    return run


def _spread(n, total, axes, mean):
    """Partial sums of products of the whitened values, centred before multiplying."""
    def run(batches):
        out = np.zeros((axes.shape[1],) * 2)
        for batch in batches:
            if batch.num_rows:
                w = (_centred(_matrix(batch.column("x")), n, total) / n).astype(float) @ axes - mean
                out += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])
    return run


def _total(rows: DataFrame) -> np.ndarray:
    """Element-wise sum of a column of arrays of one length."""
    parts = rows.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(parts))
    for row in parts:
        out[row["i"]] = row["v"]
    return out


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(_id, x)`` of the rows that take part: the vector is not null, has no null
    or non-finite entry, and as many entries as most vectors (ties: the longer);
    empty vectors never take part. ``x = floor(64 c) + 1000000``, saturated at the
    range of a long."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("_id"), vector.alias("_v")).filter(
        (F.size("_v") > 0) & F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    limit = float(2**63 - 2**20)
    entry = lambda c: (F.floor(F.least(F.greatest(c * 64, F.lit(-limit)), F.lit(limit))) + 1000000).cast("bigint")
    size = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.filter(F.size("_v") == size["d"]) if size else rows
    return rows.select("_id", F.transform("_v", entry).alias("x"))


@dataclass
class Whitening:
    """A fitted whitening of n vectors with sums S: components by falling
    eigenvalue (those of a zero eigenvalue have no whitened value and are left
    out), their shares of the variance, and the largest entry of the whitened
    covariance minus the identity."""

    n: int
    total: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def axes(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of a table ``(_id, x)`` of integer vectors of one length; None if empty."""
    ship_package(rows.sparkSession)
    sums = rows.select("x").mapInArrow(_sums, "n bigint, total array<string>")
    n = sums.agg(F.sum("n")).first()[0]
    if not n:
        return None
    parts = sums.select(F.posexplode("total").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    total = np.zeros(len(parts), dtype=object)
    for row in parts:
        total[row["i"]] = int(row["v"])
    d = len(total)
    offset = np.array([s // n for s in total], dtype=np.int64)
    spread = rows.select("x").repartition(-(-n // ROWS))
    spectra = stage(spread.mapInArrow(_spectra(offset), _SPECTRUM), "spectra")
    while spectra.count() > 1:
        pairs = spectra.groupBy(F.floor(F.col("part") / FAN_IN).alias("_to")).applyInArrow(_merged, _SPECTRUM)
        merged = stage(pairs, "spectra")
        free(spectra)
        spectra = merged
    own = Spectrum.of(spectra.first().asDict())
    free(spectra)
    # a whole orthonormal basis, led by the merged spectrum's vectors
    order = np.argsort(-own.values, kind="stable")
    basis = np.linalg.qr(np.column_stack([own.basis[:, order], np.eye(d)]))[0][:, :d]
    sums = _total(rows.select("x").mapInArrow(_projected(n, total, basis), "sums array<double>"))
    mean, inner = sums[:d] / n, sums[d:].reshape(d, d) / n
    values, turn = np.linalg.eigh(inner)
    values, turn = values[::-1], turn[:, ::-1]
    live = int((values > max(values[0], 0) * d * _EPS).sum())
    k = min(components, live)
    axes, share = basis @ turn[:, :k], values[:k] / values.sum() if k else values[:0]
    model = Whitening(n, total, axes, values[:k], share, 0.0)
    if k:
        centre = (mean @ turn[:, :k]) / np.sqrt(values[:k])
        outer = _total(rows.select("x").mapInArrow(_spread(n, total, model.axes, centre), "sums array<double>"))
        model.identity_error = float(np.abs(outer.reshape(k, k) / n - np.eye(k)).max())
    return model


def _whiten(model: Whitening):
    def run(batches):
        k = len(model.eigenvalues)
        for batch in batches:
            x = _matrix(batch.column("x"))
            for i in range(0, len(x), 4096):
                away = _centred(x[i:i + 4096], model.n, model.total)
                small = away.dtype != object and len(away) and int(np.abs(away).max()) ** 2 * away.shape[1] < 1 << 63
                squares = ((away if small else away.astype(object)) ** 2).sum(axis=1).tolist()
                whitened = (away / model.n).astype(float) @ model.axes
                m = len(away)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(i, m).take(pa.array(np.repeat(np.arange(m), k))),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                     pa.array([s if s < 1 << 63 else None for s in squares], pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                     pa.array(whitened.ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error))],
                    names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` for each
    vector that takes part (see ``integer_vectors``) and component.

    An empty table, or vectors that are all equal, give no rows (there is no
    component of positive variance); repeated rows are rows of their own; equal
    eigenvalues may come in any rotation. A deviation beyond the range of a long
    is null. Other columns are not read. Ids are returned as they are, nulls too.
    """
    rows = stage(integer_vectors(vectors, id_col, vector_col), "integer-vectors")
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit(rows, components)
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    return rows.mapInArrow(_whiten(model), schema).withColumnRenamed("_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened ``embeddings``, up to 32 components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
