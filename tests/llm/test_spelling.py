"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from crawlfold.llm import spelling

SF = "/root/testdata/sf0.001"


def edits(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(docs, ratio=5, every=199):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, near = {}, {}
    for w, n in vocab.items():
        others = [x for x in vocab if edits(w, x)]
        near[w] = len(others)
        best = min(others, key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best and vocab[best] >= ratio * n else None
    out = {}
    for w, n in vocab.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, near[w], vocab[form[w]] if form[w] else None)
    return out


def rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_pairs_at_distance_one():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(2, 7))) for _ in range(300)})
    words += ["x" * 70, "x" * 71, "x" * 35 + "y" + "x" * 35, "z" * 5000, "z" * 5001, "q"]
    got = sorted((words[int(a)], words[int(b)]) for q, w in spelling.near_pairs(words, words) for a, b in zip(q, w))
    assert got == sorted((a, b) for a in words for b in words if edits(a, b))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    stems = ["".join(rng.choice("abcdeo") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    def vary(w):
        i, kind = rng.randrange(len(w)), rng.random()
        return w if kind < 0.6 else w[:i] + w[i + 1:] if kind < 0.75 else w[:i] + rng.choice("abcé×") + w[i + (kind < 0.9):]
    docs = []
    for i in range(120):
        picks = [vary(stems[min(int(rng.expovariate(0.15)), 39)]) for _ in range(120)]
        docs.append((i, " ".join(w.upper() if rng.random() < 0.2 else w for w in picks) + " Étés-x 12"))
    docs += [(3, docs[3][1]), (None, docs[5][1]), (200, None), (201, ""), (202, "prefix" * 900)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    expected = brute(docs, every=7)
    assert any(v[0] and v[1] != v[0] for v in expected.values())  # some chains have two steps
    assert rows(spelling.group_variants(frame, every=7)) == expected
    # the same in many small blocks
    monkeypatch.setattr(spelling, "BLOCK", 24)
    assert rows(spelling.group_variants(frame, every=7)) == expected


def test_contract_of_the_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(spelling.query(spark, SF)) == brute(docs)


def test_empty_tables_and_clashing_columns(spark):
    schema = "doc_id bigint, text string, word string, n bigint, _id string, _run string"
    assert spelling.group_variants(spark.createDataFrame([], schema)).collect() == []
    frame = spark.createDataFrame([(1, "Lettera lettera lettera lettera lettera", "w", 1, "i", "r"), (2, None, None, None, None, None)], schema)
    assert rows(spelling.group_variants(frame, every=10**9)) == {"lettera": (None, "lettera", 5, 0, None)}
