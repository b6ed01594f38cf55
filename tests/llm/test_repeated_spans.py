"""Substring dedup against brute force over all windows."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from crawlfold.llm import repeated_spans

SF = "/root/testdata/sf0.001"


def brute(docs, window):
    """{(id, text): (words, removed, kept text)}; documents come by id (null first), then text."""
    import numpy as np

    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, d[2]))
    seen, out = set(), {}
    for i, text, _ in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = np.zeros(len(words), bool)
        for s in range(len(words) - window + 1):
            key = tuple(words[s:s + window])
            if key in seen:
                gone[s:s + window] = True
            seen.add(key)
        out[i, text] = (len(words), int(gone.sum()), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def check(spark, texts, window):
    frame = spark.createDataFrame([(i, t) for i, t in texts], "doc_id bigint, text string").repartition(5)
    keyed = [(r["doc_id"], r["text"], r["k"]) for r in frame.withColumn("k", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    expected = brute(keyed, window)
    got = repeated_spans.remove_repeats(frame, window=window)
    by_key = {(i, k): expected[i, t] for i, t, k in keyed}
    found = [((r["doc_id"], r["_key"]), (r["n_words"], r["n_removed"], r["kept_text"])) for r in got.collect()]
    assert len(found) == len(texts)
    for key, value in found:
        assert value == by_key[key], key


def test_random_texts(spark):
    rng = random.Random(2)
    for window, alphabet in ((4, "abc"), (6, "ab"), (20, "abcdefgh")):
        base = [rng.choice(alphabet) for _ in range(400)]
        texts = []
        for i in range(60):
            words = []
            while len(words) < rng.randint(0, 150):
                a = rng.randrange(len(base))
                words += base[a:a + rng.randint(1, 60)] if rng.random() < 0.6 else [rng.choice(alphabet) * rng.randint(1, 3)]
            texts.append((i, rng.choice([" ", "\n", "\t  "]).join(words)))
        check(spark, texts + [(900, texts[4][1]), (901, texts[4][1])], window)


def test_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(50))
    check(spark, [(None, words), (3, words), (3, words), (3, words + " x"), (4, None), (5, ""), (6, "   \x0b"), (7, "a " * 3000),
                  (8, "a " * 19), (9, "a " * 20), (10, "A " * 20), (None, None), (-5, "x " + words)], 20)


def test_query_and_clashes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = brute([(r["doc_id"], r["text"], 0) for r in docs.collect()], 20)
    by_id = {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, g, t) in expected.items()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeated_spans.query(spark, SF).collect()}
    assert got == by_id and sum(v[1] for v in got.values()) > 0
    clash = docs.limit(3).select("doc_id", "text", F.lit(1).alias("_id"), F.lit(1).alias("_key"), F.lit(1).alias("marks"), F.lit(1).alias("n_words"))
    assert repeated_spans.remove_repeats(clash).count() == 3
    assert repeated_spans.remove_repeats(docs.filter("false")).collect() == []
