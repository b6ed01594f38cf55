"""The pipeline over a small corpus with planted cases; each stage is judged on
its own input."""

import random
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from crawlfold.llm import line_dedup, near_dedup

EXACT = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
LINE = "this page was printed on day {} by the archive of the town"


def corpus():
    rng = random.Random(21)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(4000)]
    bad = ["vilx" + w for w in ("am", "or", "en", "is", "ut", "al", "op", "ed")]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))
    docs, labels, kind = [], [], {}
    for i in range(700):
        kind[i] = "toxic" if i % 7 == 0 else "junk" if i % 7 == 1 else "clean"
        if kind[i] == "toxic":
            t = prose(40) + " " + " ".join(rng.choice(bad) for _ in range(12)) + " " + prose(60)
        elif kind[i] == "junk":
            t = " | ".join(rng.choice("#*%") * 3 + str(rng.randrange(99)) for _ in range(80))
        else:
            t = prose(60) + "\n" + LINE.format(i) + "\n" + prose(60 + i % 50)
        docs.append([i, t])
        if i % 10:
            labels.append((i, int(kind[i] != "junk"), int(kind[i] == "toxic")))
    base = prose(120).split()
    for i in range(700, 740):  # near copies of one text
        copy = list(base)
        copy[rng.randrange(120)] = "changed"
        docs.append([i, " ".join(copy)])
        kind[i] = "copy"
    docs += [[740, docs[2][1]], [741, ""], [742, None]]
    kind |= {740: "clean", 741: "clean", 742: "clean"}
    return docs, labels, kind


def test_stages_on_planted_cases(spark, tmp_path):
    docs, labels, kind = corpus()
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x") for d, t in docs],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint, rate string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tables = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for name, step in corpus_pipeline.STAGES:
        step(spark, tables[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    rows = [{r.doc_id: r for r in t.collect()} for t in tables[:-1]]

    gone = set(rows[0]) - set(rows[1])
    toxic = {d for d in kind if kind[d] == "toxic"}
    assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 0.01 * len(kind)

    assert set(rows[2]) == set(rows[1])
    lines = [d for d in rows[2] if rows[2][d].text and "was printed on day" in rows[2][d].text]
    assert len(lines) <= 2  # the first document, and perhaps its copy
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows[2].values())
    untouched = [d for d in rows[2] if kind[d] != "clean" and kind[d] != "copy"]
    assert all(rows[2][d].text == rows[1][d].text for d in untouched)
    want = {r.doc_id: r.text for r in line_dedup.dedup_lines(tables[1]).collect()}
    assert {d: r.text for d, r in rows[2].items()} == want

    assert sum(kind[d] == "copy" for d in rows[3]) <= sum(r.component_id == r.doc_id for r in near_dedup.assign(tables[2]).collect() if kind[r.doc_id] == "copy")
    assert sum(kind[d] == "copy" for d in rows[3]) == 1
    singles = {r.doc_id for r in near_dedup.assign(tables[2]).collect() if r.kept}
    assert set(rows[3]) == singles

    share = {k: sum(kind[d] == k for d in rows[4]) / max(1, sum(kind[d] == k for d in rows[3])) for k in ("clean", "junk")}
    assert share["clean"] > 0.93 and share["junk"] < 0.75 and set(rows[4]) <= set(rows[3])

    pieces, seen = tables[5].collect(), {}
    for r in sorted(pieces, key=lambda r: r.start):
        own = np.array([*EXACT.encode(rows[4][r.doc_id].text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert r.start == seen.get(r.doc_id, 0) and r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start:r.start + r.length].tobytes())
        seen[r.doc_id] = r.start + r.length
    assert set(seen) == set(rows[4])


def test_stages_keep_columns_of_their_own_names(spark, tmp_path):
    docs, labels, _ = corpus()
    names = ["_toxicity", "_segments", "toxicity", "k1", "k2", "drops", "lines", "n_lines", "kept_id", "_kept_id", "kept_key", "tokens",
             "posteriors", "rate", "copies", "copy", "_copies", "_k1", "_lines"]
    df = spark.createDataFrame([(d, t, *range(len(names))) for d, t in docs], "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names))
    df = df.withColumn("n_chars", F.length("text"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        step(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns == df.columns, name
        assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}, name
        df = out


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
