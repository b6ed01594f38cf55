import math

import numpy as np
import pytest

from crawlfold.llm import mixing as M
from crawlfold.llm import neighbours as N


def exact(x, ids, queries, k=20):
    out = {}
    for q in queries:
        v = x[ids.index(q)]
        s = (x * v).sum(axis=1)
        out[q] = sorted(((-s[i], d) for i, d in enumerate(ids) if d != q))[:k]
    return out


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = N.query(spark, sf).collect()
    data = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in data], dtype=float), [r.vec_id for r in data]
    want, hits = exact(x, ids, [i for i in ids if i % 20 == 0]), 0
    for q, best in want.items():
        own = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 21))
        assert all(s == pytest.approx(float(x[ids.index(q)] @ x[ids.index(d)]), abs=1e-12) for _, d, s in own)
        assert own == sorted(own, key=lambda r: (-r[2], r[1]))
        hits += len({d for _, d, _ in own} & {d for _, d in best})
    assert hits >= 0.9 * 20 * len(want)


def test_recall_over_several_parts(spark, monkeypatch):
    """Many parts, blocks and query blocks, clusters and a vector that a third
    of all rows share."""
    for name, value in (("ROWS_PER_PART", 300), ("BLOCK", 200), ("QUERY_BLOCK", 30), ("SAMPLE", 2000)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    rows = N.search(df, df.filter("vec_id % 20 = 0")).collect()
    want, hits = exact(x, list(range(3000)), range(0, 3000, 20)), 0
    for q, best in want.items():
        own = [r for r in rows if r.query_id == q]
        assert len(own) == 20
        hits += len({r.vec_id for r in own} & {d for _, d in best})
        if q % 3 == 0:
            top = [r.vec_id for r in sorted(own, key=lambda r: r.rank)]
            assert top == [d for _, d in best]
    assert hits >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("spread", [0.4, 3.0])
def test_parts_are_cut_again(spark, monkeypatch, spread):
    """A table with more rows than the parts of one router are meant for: its
    parts get routers of their own, and leaves stay near the size aimed at."""
    for name, value in (("ROWS_PER_PART", 100), ("MAX_PARTS", 6), ("SPLIT", 2), ("BLOCK", 80), ("SAMPLE", 1500)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 12))[rng.integers(0, 60, 4000)] + spread * rng.normal(size=(4000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    trees, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v: trees.append(v) or broadcast(self, v))
    rows = N.search(df, df.filter("vec_id % 20 = 0")).collect()
    tree = [t for t in trees if isinstance(t, N.Tree)][-1]
    leaf, n_leaves = tree.leaves(x), len(np.unique(tree.leaves(x)))
    assert len(tree.below) >= 4 and n_leaves > 2 * tree.top.parts
    assert np.bincount(leaf).max() < 0.5 * np.bincount(leaf >> 16).max()
    want, hits = exact(x, list(range(4000)), range(0, 4000, 20)), 0
    for q, best in want.items():
        own = {r.vec_id for r in rows if r.query_id == q}
        assert len(own) == 20 and q not in own
        hits += len(own & {d for _, d in best})
    assert hits >= 0.9 * 20 * len(want)


def test_a_repeated_id_is_spread(spark, monkeypatch):
    """A third of all rows share an id but not a vector: one candidate, its best score."""
    monkeypatch.setattr(N, "BLOCK", 50)
    rng = np.random.default_rng(5)
    x, ids = rng.normal(size=(600, 6)), [0 if i % 3 == 0 else i for i in range(600)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] * 2, "vec_id bigint, embedding array<double>")
    got = N.search(df, df.filter("vec_id in (20, 40)"), k=500).collect()
    for q in (20, 40):
        score = {}
        for i, v in zip(ids, x):
            if i != q:
                score[i] = max(score.get(i, -np.inf), float((v * x[q]).sum()))
        want = sorted(score, key=lambda i: (-score[i], i))
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want


def test_balanced_parts():
    x = np.random.default_rng(1).normal(size=(900, 8))
    label = N.balanced_parts(x, N.nearest(x, 8), 7)
    sizes = np.bincount(label, minlength=7)
    assert sizes.max() <= math.ceil(1.1 * 900 / 7) and sizes.min() > 0


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 2.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (4, None), (5, []),
            (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [0.1, 0.1]),
            (40, None), (60, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id bigint, embedding array<double>, rank int, score double")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in N.search(df, df.filter("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.5), (0, 4, 20, 0.0),
                   (20, 1, 3, 2.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    empty = df.limit(0)
    assert N.search(empty, empty).collect() == [] and N.search(df, empty).collect() == []


def brute_rates(n, p, target, steps=2000):
    """Projected gradient on explicit arrays."""
    x, gram = np.ones(len(n)), (p * n[:, None]).T @ p
    for _ in range(steps):
        rest = (p * (n * x)[:, None]).sum(axis=0) - target * n.sum()
        x = np.maximum(0, x - p @ (np.linalg.pinv(gram) @ rest))
    return x


SF = "/root/testdata/sf0.01"


def test_mix_reaches_its_targets(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for share in (0.95, 0.5):
        mix = M.fit(docs, labels, {"1": share, "0": 1 - share}, label_col="quality")
        rows = M.rate_documents(docs, mix).collect()
        n, p = np.array([r.tokens for r in rows], dtype=float), np.array([r.posteriors for r in rows])
        x = np.array([r.rate for r in rows])
        assert (x >= 0).all() and np.allclose(p.sum(axis=1), 1)
        got = (p * (n * x)[:, None]).sum(axis=0) / n.sum()
        assert np.allclose(got, [1 - share, share], atol=1e-6) and mix.residual < 1e-6
        assert np.allclose(x, brute_rates(n, p, np.array([1 - share, share])), atol=1e-4)
        assert all(r.tokens == len(r.text.split()) for r in rows[:30])
    # rates of at most 1 keep the shares of the scarce domain
    mix = M.fit(docs, labels, M.QUALITY_TARGETS, label_col="quality", max_rate=1.0)
    rated = M.rate_documents(docs, mix).cache()
    x = np.array([r.rate for r in rated.collect()])
    assert x.max() <= 1.0
    kept = M.apply_rates(rated)
    assert kept.columns == docs.columns
    truth = {r.doc_id: r.quality for r in labels.collect()}
    share = [np.mean([r.doc_id in ids for r in labels.filter(f"quality = {q}").collect()]) for ids in [{r.doc_id for r in kept.collect()}] for q in (0, 1)]
    assert share[0] < 0.7 and share[1] > 0.93 and truth


def test_classifier_on_unseen_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    mix = M.fit_classifier(docs, labels.filter("doc_id % 2 = 0"), ["0", "1"], label_col="quality")
    rows = M.rate_documents(docs.join(labels.filter("doc_id % 2 = 1"), "doc_id"), mix).collect()
    right = np.mean([(r.posteriors[1] >= 0.5) == (r.quality == 1) for r in rows])
    assert right > 0.95


def test_mixing_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b c", 5), (3, "x" * 300_000, 5), (4, "w " * 50_000, 5), (4, "w " * 50_000, 5)],
                                 "doc_id bigint, text string, rate int")
    none = spark.createDataFrame([], "doc_id bigint, domain string")
    mix = M.fit(docs, none, {"a": 1.0, "b": 3.0})
    rows = M.rate_documents(docs, mix).collect()
    assert rows[0].__fields__ == ["doc_id", "text", "tokens", "posteriors", "rate"]
    assert [r.tokens for r in sorted(rows, key=lambda r: r.tokens)] == [0, 0, 1, 3, 50_000, 50_000]
    assert all(r.posteriors == [0.5, 0.5] for r in rows)
    some = spark.createDataFrame([(1, "a"), (1, "b"), (4, None), (3, "c"), (None, "a")], "doc_id bigint, domain string")
    assert M.fit(docs, some, {"a": 1.0, "b": 0.0}).steps is not None
    assert M.rate_documents(docs.limit(0), mix).collect() == []
    assert M.fit(docs.limit(0), some, {"a": 1.0}).steps == []
