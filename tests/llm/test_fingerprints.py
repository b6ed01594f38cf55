import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crawlfold.llm import fingerprints as P

SF = "/root/testdata/sf0.001"


def terms(text):
    return Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w)


def jaccard(a, b):
    a, b = terms(a), terms(b)
    if not a and not b:
        return 1.0
    return sum((a & b).values()) / sum((a | b).values())


def brute(docs):
    """(id, text) in descending id order -> id: (n, sha, text, edited, next)."""
    out = {}
    for i, (d, t) in enumerate(docs):
        t, following = t or "", docs[(i + 1) % len(docs)][1] or ""
        k = len(t) // 2
        edited = t[:len(t) - k] + following[:k]
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, following)
    return out


def test_small_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.desc("doc_id")).collect()]
    want, rows = brute(docs), P.query(spark, SF).collect()
    assert len(rows) == len(docs)
    by_text, errors = {}, []
    for r in rows:
        n, sha, t, edited, following = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint and len(r.fingerprint) == 8 * P.SAMPLES
        for near, other in ((r.near_edited, edited), (r.near_next, following)):
            errors.append(near - jaccard(t, other))
    # the spread of so many samples is sqrt(J (1 - J) / SAMPLES) <= 0.09; the mean has much of it
    # too, as all texts share the samples of common words (the next test has independent words)
    assert abs(sum(errors) / len(errors)) < 0.04 and max(map(abs, errors)) < 0.42
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.09
    prints = [r.fingerprint for r in rows]
    assert len(set(prints)) == len({t for _, t in docs})


def test_collision_rate_of_weights(spark):
    """Counts matter: same words, other weights."""
    a, b = "x " * 30 + "y " * 10 + "z", "x " * 10 + "y " * 30 + "q"
    rows = [(i, " ".join(w + str(i) for w in t.split())) for i in range(300) for t in (a, b)]
    df = spark.createDataFrame([(2 * j + k, rows[2 * j + k][1]) for j in range(300) for k in (0, 1)], "doc_id bigint, text string")
    got = {r.doc_id: r.samples for r in P.fingerprint(df).collect()}
    same = [sum(x == y for x, y in zip(got[2 * j], got[2 * j + 1])) / P.SAMPLES for j in range(300)]
    assert sum(same) / 300 == pytest.approx(jaccard(a, b), abs=0.02)


def test_odd_rows(spark):
    texts = ["", None, " \n", "one", "é\U0001f600 ä " * 5, "x" * 200_001, "w " * 100_000, "same text here", "same text here"]
    docs = [(9 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, 3, "s") for d, t in docs], "doc_id bigint, text string, k1 int, samples string").repartition(4)
    rows = {r.doc_id: r for r in P.edited_fingerprints(df).collect()}
    for d, (n, sha, *_) in brute(docs).items():
        assert (rows[d].n_chars, rows[d].edited_sha256) == (n, sha)
    assert rows[9].fingerprint == "" and rows[9].near_next == 1.0 and rows[7].near_next == 0.0
    assert rows[2].fingerprint == rows[1].fingerprint and rows[2].near_next == 1.0
    assert P.edited_fingerprints(df.limit(0)).collect() == []


def test_repeated_rows_and_null_ids(spark):
    docs = [(5, "a b c d"), (4, "e f g h"), (None, "i j k l")]
    df = spark.createDataFrame(docs + docs[:1], "doc_id bigint, text string")
    rows = P.edited_fingerprints(df).collect()
    assert len(rows) == 4
    want = brute(docs)
    assert all(r.edited_sha256 == want[r.doc_id][1] for r in rows)
    one = P.edited_fingerprints(df.limit(1)).collect()[0]
    assert one.near_next == 1.0
