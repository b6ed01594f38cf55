import random
import re

from pyspark.sql import functions as F

from crawlfold.llm import near_dedup as N
from crawlfold.llm.components import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, width=5):
    w = words(text)
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows):
    """Component of each row by comparing all pairs of sets."""
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            inner = len(sets[i] & sets[j])
            if inner and 100 * inner >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d, d == (least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for u, v in links:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    want = {x: find(x) for x in parent if any(find(y) == find(x) for y in parent if y != x)}
    df = spark.createDataFrame(links, "u bigint, v bigint")
    assert {r.node: r.root for r in components(df).collect()} == want
    assert components(df.limit(0)).collect() == []


def test_matches_brute_force_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(N.query(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_groups_chains_ties_and_odd_rows(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    base = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(60):  # one large group of near copies
        copy = list(base)
        copy[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    chain = [rng.choice(vocabulary) for _ in range(300)]
    texts += [" ".join(chain[i * 12:i * 12 + 140]) for i in range(12)]  # each like the next one, the ends unlike
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [shared + " " + " ".join(rng.choice(vocabulary) for _ in range(60 + 5 * k)) for k in range(25)]  # a common passage only
    texts += ["a b", "A\tb\n", "a b c", "one two three four five", None, "", " \n\t ", "é " * 30, "x" * 300_000, "y " * 100_000]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, rows[3][1]), (7, "another text under one id"), (None, rows[5][1]), (None, "only null ids have this text here")]
    df = spark.createDataFrame([(d, t, b"x", 1) for d, t in rows], "doc_id bigint, text string, node binary, n int").repartition(5)
    assert got(N.assign(df)) == brute(rows)
    kept = N.keep_one(df).collect()
    assert kept[0].__fields__ == ["doc_id", "text", "node", "n"]
    want = [r for r in brute(rows) if r[3]]
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r[0]) for r in want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert N.assign(df).collect() == [] and N.keep_one(df).collect() == []
    assert N.assign(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).filter(F.col("kept")).count() == 2
