"""Whitening against a direct eigendecomposition."""

from __future__ import annotations

import math

import numpy as np

from crawlfold.llm import whitening

SF = "/root/testdata/sf0.001"


def test_rank_one_updates_equal_the_direct_decomposition():
    rng = np.random.default_rng(3)
    for d, rows in ((5, rng.normal(size=(40, 5))), (6, np.repeat(rng.integers(-3, 4, (4, 6)), 9, axis=0).astype(float)),
                    (4, np.eye(4)[[0, 1, 2, 3] * 5]), (8, rng.normal(size=(700, 8)) * 10.0 ** -np.arange(8))):
        own, other = whitening.Spectrum(d), whitening.Spectrum(d)
        for row in rows[:len(rows) // 2]:
            own.add(row)
        for row in rows[len(rows) // 2:]:
            other.add(row)
        own.merge(other)
        away = rows - rows.mean(axis=0)
        assert np.allclose(own.basis.T @ own.basis, np.eye(own.basis.shape[1]), atol=1e-9)
        assert np.allclose(own.basis @ np.diag(own.values) @ own.basis.T, away.T @ away, atol=1e-8 * max(1, np.abs(away.T @ away).max()))


def check(found, vectors):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1000000
    n, total = len(x), x.sum(axis=0)
    away = (n * x - total) / n
    values, axes = np.linalg.eigh(away.T @ away / n)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    k = len(values)
    assert len(found) == n * k
    table = {(r["vec_id"], r["component"]): r for r in found}
    whitened = np.array([[table[i, c + 1]["whitened"] for c in range(k)] for i in range(n)])
    expected = away @ axes / np.sqrt(values)
    signs = np.sign((whitened * expected).sum(axis=0))
    assert np.allclose(whitened, expected * signs, atol=1e-7)
    for i in range(n):
        r = table[i, 1]
        assert (r["n"], r["deviation"]) == (n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], total)))
    share = np.array([table[0, c + 1]["explained"] for c in range(k)])
    assert np.allclose(share, values / np.trace(away.T @ away / n), rtol=1e-9)
    cov = np.cov(whitened.T, bias=True) - np.eye(k)
    assert abs(table[0, 1]["identity_error"] - np.abs(cov).max()) < 1e-9 and table[0, 1]["identity_error"] < 1e-9


def test_query(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)  # many partitions, two levels of merging
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids = {r["vec_id"]: i for i, r in enumerate(rows)}
    found = [r.asDict() | {"vec_id": ids[r["vec_id"]]} for r in whitening.query(spark, SF).collect()]
    check(found, [r["embedding"] for r in rows])


def test_odd_vectors(spark):
    rng = np.random.default_rng(8)
    good = rng.normal(size=(50, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [1.0, math.nan, 2.0], [math.inf, 0.0, 0.0], [1.0, 2.0]]
    schema = "vec_id bigint, embedding array<double>, x string, n string, _id int"
    rows = [(i, v, "x", "n", 1) for i, v in enumerate(good)] + [(100 + i, v, None, None, None) for i, v in enumerate(bad)]
    check([r.asDict() for r in whitening.whiten(spark.createDataFrame(rows, schema)).collect()], good)
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0], "", "", 0), (None, [1.0, 2.0], "", "", 0)], schema)
    assert whitening.whiten(same).collect() == []
    # a flat direction has no component; null ids stay
    line = spark.createDataFrame([(None if i == 0 else i, [float(i), 2.0 * i, 7.0], "", "", 0) for i in range(9)], schema)
    found = whitening.whiten(line).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 9 and sum(r["vec_id"] is None for r in found) == 1


def test_huge_entries(spark):
    rows = [(i, [v, 1.0]) for i, v in enumerate([1e300, -1e300, 0.0, 5.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r["deviation"] for r in found if r["vec_id"] < 2} == {None}  # beyond a long
    assert all(math.isfinite(r["whitened"]) for r in found)
