import math
import random
import zlib

import numpy as np
import pytest

from crawlfold.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def brute_segments(scores):
    """Maximal segments by definition: best segment, then both sides of it."""
    def go(a, b):
        best = max(((sum(scores[i:j]), -i, -(i - j)) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        best = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (best is None or total > best[0] or (total == best[0] and j + 1 - i < best[2] - best[1])):
                    best = (total, i, j + 1)
        if not best:
            return []
        return go(a, best[1]) + [(best[1], best[2], best[0])] + go(best[2], b)
    return go(0, len(scores))


def test_maximal_segments_match_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.uniform(-2, 1.5) for _ in range(rng.randrange(0, 25))]
        got = X.maximal_segments(np.array(scores))
        want = brute_segments(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_lambda_solves_its_equation():
    s, w = np.array([-1.0, 0.5, 1.0]), np.array([0.8, 0.15, 0.05])
    lam = X.solve_lambda(s, w)
    assert abs((w * np.exp(lam * s)).sum() - 1) < 1e-6
    assert X.solve_lambda(np.array([-1.0, 2.0]), np.array([1.0, 0.0])) == 1.0


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return X.train(docs, labels), docs, labels


def test_held_out_accuracy(spark, trained):
    rows = X.query(spark, SF).join(trained[2], "doc_id").collect()
    for r in rows[:50]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    right = sum(r.predicted == r.toxic for r in held) / len(held)
    found = sum(r.predicted for r in held if r.toxic) / sum(r.toxic for r in held)
    false = sum(r.predicted for r in held if not r.toxic) / sum(1 - r.toxic for r in held)
    assert right > 0.96 and found > 0.8 and false < 0.02, (right, found, false)


def test_passages_in_odd_texts(spark, trained):
    model = trained[0]
    toxic = "idiot moron clown scum loser pathetic stupid trash worthless disgusting"
    neutral = "thand ereon oning reation thertion "
    texts = [None, "", "   ", "é" * 100, "x" * 300_000, neutral * 3000 + toxic + " " + neutral * 3000, toxic, toxic, neutral * 20]
    df = spark.createDataFrame([(i % 8, t, 1.0, [1]) for i, t in enumerate(texts)],
                               "doc_id bigint, text string, toxicity double, toxic_segments array<int>")
    rows = X.score_texts(df, model).collect()
    assert [r.text for r in rows] == texts and rows[0].__fields__ == ["doc_id", "text", "toxicity", "toxic_segments"]
    flags = [r.toxicity >= 0.5 for r in rows]
    assert flags == [False] * 5 + [True] * 3 + [False]
    (s,) = rows[5].toxic_segments
    assert texts[5][s.start:s.end] == toxic and 0 <= s.p_value < 1e-6
    assert rows[6].toxicity == rows[7].toxicity
    assert X.score_texts(df.limit(0), model).collect() == []


def test_without_labels(spark, trained):
    _, docs, labels = trained
    none = X.train(docs, labels.limit(0))
    assert not none.trained and none.prior == 0.0
    one = X.train(docs.limit(50), labels.filter("toxic = 1"))
    assert one.prior == 1.0
    assert X.score_texts(docs.limit(3), one).collect()[0].toxicity == 1.0
    counts = spark.createDataFrame([(0, 0, 50), (1, 500, 0), (2, 3, 3), (X.N + 7, 0, 60)], "bucket bigint, clean bigint, toxic bigint")
    scores = {r.bucket: r.score for r in X.sure_scores(counts).collect()}
    assert scores[0] > 0 > scores[1] and X.N + 7 in scores
    assert X.sure_scores(counts.limit(0)).collect() == []
