import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crawlfold.llm import encoders, packing
from crawlfold.llm.staging import shared_path
from crawlfold.llm.token_counts import read_cache, token_counts

PATH = P.path("byte_bpe_50k.json")
EXACT = Tokenizer.from_file(PATH)
ODD = [None, "", " ", "plain words", "a<|endoftext|>b <|endoftext|>", "é" * 9000, "x " * 20000, "plain words", "\n\n\t ok", "你好 \U0001f600"]


def ids(text):
    return EXACT.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "'s", "1", "é", "word", " "]), max_size=12).map("".join))
def test_fast_encoder_gives_the_librarys_ids(text):
    assert encoders.load(PATH)([text]) == [ids(text)]


def test_byte_level_engine_is_used_only_where_it_fits():
    assert encoders._byte_level(PATH) is not None
    assert encoders._byte_level(P.path("word_bpe_49k.json")) is None
    assert encoders.load(P.path("piece_bpe_32k.model"))(["ab"])[0]


def docs_of(spark, texts, extra=False):
    rows = [(i, t, 7, 9) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, content int, n_tokens int")
    return df if extra else df.select("doc_id", "text")


def test_token_counts_and_cache(spark):
    cache = shared_path(spark, "test-cache")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs_of(spark, ODD, True), PATH, cache).collect()}
    want = {i: (len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for i, t in enumerate(ODD)}
    assert got == want
    assert read_cache(spark, cache).count() == len({t or "" for t in ODD})
    # the second call encodes only what is new
    more = token_counts(docs_of(spark, [*ODD, "new text"]), PATH, cache)
    assert more.count() == len(ODD) + 1
    assert read_cache(spark, cache).count() == len({t or "" for t in ODD}) + 1
    # stored counts are what a hit returns
    assert token_counts(docs_of(spark, ["plain words"] * 3), PATH, cache).select("n_tokens").distinct().collect()[0][0] == len(ids("plain words"))
    # another tokenizer version misses
    token_counts(docs_of(spark, ["plain words"]), P.path("piece_bpe_32k.model"), cache).collect()
    assert read_cache(spark, cache).select("tokenizer").distinct().count() == 2


def test_token_counts_of_an_empty_table_and_null_ids(spark):
    assert token_counts(docs_of(spark, []), PATH, shared_path(spark, "c")).collect() == []
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id bigint, text string")
    assert sorted(r.n_tokens for r in token_counts(df, PATH, shared_path(spark, "c")).collect()) == [0, 2, 2]


def check_pieces(rows, texts, limit=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for d, pieces in by_doc.items():
        own, at = np.array([*ids(texts[d]), 1], dtype="<u4"), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(own[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(own)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit
    return by_seq


def test_packing_covers_each_id_once(spark):
    texts = [*ODD, *[("word %d " % i) * (i % 300) for i in range(200)]]
    rows = packing.pack_documents(docs_of(spark, texts, True), PATH).collect()
    seqs = check_pieces(rows, texts)
    parts = {s >> 32 for s in seqs}
    full = sum(r["length"] for r in rows) / 2048
    assert len(seqs) <= full * 1.02 + 2 * len(parts)


def test_packing_limits_of_segments_and_loss(spark):
    texts = ["a"] * 50
    rows = packing.pack_documents(docs_of(spark, texts).coalesce(1), PATH, length=64, max_segments=5).collect()
    assert max(len(v) for v in check_pieces(rows, texts, 64).values()) <= 5
    assert packing.pack_documents(docs_of(spark, []), PATH).collect() == []
    with pytest.raises(ValueError):
        packing.pack_documents(docs_of(spark, []), PATH, max_loss=3)


def test_vector_packing_holds_all_limits(spark):
    rng = np.random.default_rng(5)
    needs = np.stack([rng.integers(1, 900, 3000), rng.integers(1, 6, 3000), rng.integers(0, 400, 3000)], axis=1)
    needs[7] = (5000, 1, 1)
    df = spark.createDataFrame([(str(i), *map(int, v), "x") for i, v in enumerate(needs)],
                               "example_id string, tokens int, segments int, loss_tokens int, bin_id string").coalesce(1)
    rows = packing.pack_examples(df, 2048, 16, 900).collect()
    assert sorted(int(r.example_id) for r in rows) == list(range(3000))
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        if b[0].oversize:
            assert [r.example_id for r in b] == ["7"]
            continue
        assert sum(r.tokens for r in b) <= 2048 and sum(r.segments for r in b) <= 16 and sum(r.loss_tokens for r in b) <= 900
    lower = max(needs[:, k].sum() / m for k, m in enumerate((2048, 16, 900)))
    assert len(bins) <= lower * 1.06 + 2
    assert len(set(packing.pack_vectors(needs, (2048, 16, 900)))) <= lower * 1.06 + 2


def test_each_limit_binds_on_documents(spark):
    """Tokens and loss on the given table, segments on its shortest kind of text; little padding."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    texts = [*texts, *["ok"] * 2000]
    rows = packing.pack_documents(docs_of(spark, texts).coalesce(1), PATH, max_segments=64, max_loss=2040).collect()
    seqs = check_pieces(rows, texts)
    for pieces in seqs.values():
        assert len(pieces) <= 64 and sum(r["loss_tokens"] for r in pieces) <= 2040
    tokens = [sum(r["length"] for r in v) for v in seqs.values()]
    loss = [sum(r["loss_tokens"] for r in v) for v in seqs.values()]
    assert max(tokens) == 2048 and max(loss) == 2040 and max(map(len, seqs.values())) == 64
    assert all(r["loss_tokens"] == r["length"] - (r["start"] == 0) for r in rows)
    only = {s: v for s, v in seqs.items() if not any(texts[r["doc_id"]] == "ok" for r in v)}
    assert len(only) <= sum(r["length"] for v in only.values() for r in v) / 2048 * 1.02 + 2


@pytest.mark.parametrize("max_loss", [32, 40, 63, 64])
def test_pieces_are_cut_to_the_loss_limit(spark, max_loss):
    texts = [*ODD, *["word %d " % i * (i % 60) for i in range(40)]]
    rows = packing.pack_documents(docs_of(spark, texts), PATH, length=64, max_segments=3, max_loss=max_loss).collect()
    for pieces in check_pieces(rows, texts, 64).values():
        assert len(pieces) <= 3 and sum(r["loss_tokens"] for r in pieces) <= max_loss
