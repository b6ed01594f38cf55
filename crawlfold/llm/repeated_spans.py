"""Substring dedup by a compacted de Bruijn graph of token k-mers.

Edges are windows of ``window`` consecutive words. Writing a row for each would
cost a shuffle of the whole corpus many times over, so paths are compacted from
the start: the windows of a document that share their smallest half-window k-mer
(their *seed*) are one piece of its walk through the graph, about one row for
five words. Equal windows have equal seeds, so a window can only repeat where its
seed does.

1. Seeds are counted together with their context (the piece's words, the seed
   before and the seed after). A join brings the repeated ones back to the walks.
2. Consecutive pieces whose seeds have a single context each are a nonbranching
   path: it always occurs as a whole, and one edge stands for all its windows. A
   piece with several contexts is a branch and is opened into its windows.
3. Edges are grouped by two 64-bit hashes of their first window's words. The
   smallest source coordinate (id, text, start) of an edge is its first
   occurrence and goes back to its document; every other occurrence is removed,
   with all the words its windows cover.

Hot k-mers are one partial aggregate per task in the counts, and the joins that
bring counts back have one small row per key on one side, so Spark splits the
other. Per-document lists never exceed the document's own words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlfold.llm import bytetext
from crawlfold.llm.staging import free, stage
from crawlfold.session import ship_package

WINDOW = 20  # words

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(1311))


def _odd(n: int) -> np.ndarray:
    return _RNG.integers(1, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)


_MOST = 256  # words of a window, at most
_SEED, _EDGE, _CHECK = _odd(_MOST), _odd(_MOST), _odd(_MOST)


def _rolled(hashes: np.ndarray, width: int, steps: np.ndarray) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    out = np.zeros(max(len(hashes) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        out += hashes[k:len(hashes) - width + 1 + k] * steps[k]
    return bytetext.mix(out)


class _Walks:
    """The walks of a few documents, in pieces: ``doc`` (number), ``start`` (its
    first window, as a flat word position), ``length`` (windows) and ``seed``."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, window: int):
        self.hashes, self.window = hashes, window
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        n, half = len(hashes) - window + 1, window // 2
        inside = np.zeros(0, np.int64)
        if n > 0:
            docs = np.repeat(np.arange(len(counts)), counts)[:n]
            inside = np.flatnonzero(np.arange(n) + window <= self.first[docs + 1])
        if not len(inside):
            self.doc = self.start = self.length = np.zeros(0, np.int64)
            self.seed = np.zeros(0, np.uint64)
            return
        seeds = _rolled(hashes, half, _SEED)
        at = np.lib.stride_tricks.sliding_window_view(seeds, window - half + 1).argmin(axis=1)[inside] + inside
        docs = docs[inside]
        new = np.ones(len(inside), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (docs[1:] != docs[:-1])
        heads = np.flatnonzero(new)
        self.doc, self.start = docs[heads], inside[heads]
        self.length = np.diff(np.append(heads, len(inside)))
        self.seed = seeds[at[heads]]

    def contexts(self) -> np.ndarray:
        """Hash of each piece's words and of the seeds before and after it."""
        if not len(self.doc):
            return np.zeros(0, np.uint64)
        edges = _rolled(self.hashes, self.window, _EDGE)
        before, after = np.zeros(len(self.doc), np.uint64), np.zeros(len(self.doc), np.uint64)
        same = self.doc[1:] == self.doc[:-1]
        before[1:][same] = self.seed[:-1][same]
        after[:-1][same] = self.seed[1:][same]
        out = bytetext.mix(edges[self.start] * _EDGE[0] + self.length.astype(np.uint64))
        out = bytetext.mix(out * _EDGE[1] + edges[self.start + self.length - 1])  # both windows cover the piece
        return bytetext.mix(bytetext.mix(out * _EDGE[2] + before) * _EDGE[3] + after)

    def ordinals(self) -> np.ndarray:
        """Number of each piece within its document, from 0."""
        return np.arange(len(self.doc)) - np.searchsorted(self.doc, self.doc)

    def edges(self, marks: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(doc, start, windows)`` of the edges that pieces with repeated seeds
        make; ``marks`` holds ``2 * ordinal + single context`` of those."""
        lists, values = _flat(marks)
        pieces = np.searchsorted(self.doc, lists) + (values >> 1)
        single, branch = np.zeros(len(self.doc), bool), np.zeros(len(self.doc), bool)
        single[pieces[values & 1 == 1]] = True
        branch[pieces[values & 1 == 0]] = True
        head = single.copy()
        head[1:] &= ~(single[:-1] & (self.doc[1:] == self.doc[:-1]))
        heads = np.flatnonzero(head)
        path = np.cumsum(head)[single] - 1
        windows = np.bincount(path, weights=self.length[single], minlength=len(heads)).astype(np.int64)
        split = self.length[branch]
        starts = np.repeat(self.start[branch] - (np.cumsum(split) - split), split) + np.arange(split.sum())
        return (np.concatenate([self.doc[heads], np.repeat(self.doc[branch], split)]),
                np.concatenate([self.start[heads], starts]), np.concatenate([windows, np.ones(len(starts), np.int64)]))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """List number and value of each element; null lists have none."""
    return (pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64),
            pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64))


def _walks(batch: pa.RecordBatch, window: int):
    """``(i, j, walks)`` for slices of a batch's rows."""
    data, offsets = bytetext.buffers(batch.column("_text"))
    for i, j in bytetext.slices(offsets):
        hashes, counts, _, _ = bytetext.words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], lower=False)
        yield i, j, _Walks(hashes, counts, window)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _seeds(window):
    def run(batches):
        for batch in batches:
            for _, _, w in _walks(batch, window):
                yield pa.RecordBatch.from_arrays([_signed(w.seed), _signed(w.contexts())], names=["seed", "context"])
    return run


def _places(window):
    def run(batches):
        for batch in batches:
            for i, _, w in _walks(batch, window):
                rows = pa.array(w.doc + i)
                yield pa.RecordBatch.from_arrays(
                    [_signed(w.seed), batch.column("_id").take(rows), batch.column("_key").take(rows), pa.array(w.ordinals(), pa.int32())],
                    names=["seed", "_id", "_key", "ordinal"])
    return run


def _edges(window):
    def run(batches):
        for batch in batches:
            for i, j, w in _walks(batch, window):
                doc, start, _ = w.edges(batch.column("marks").slice(i, j - i))
                rows = pa.array(doc + i)
                edge, check = (_rolled(w.hashes, window, steps)[start] for steps in (_EDGE, _CHECK))
                yield pa.RecordBatch.from_arrays(
                    [_signed(edge), _signed(check), batch.column("_id").take(rows), batch.column("_key").take(rows),
                     pa.array((start - w.first[doc]).astype(np.int32))], names=["edge", "check", "_id", "_key", "start"])
    return run


def _kept(window):
    def run(batches):
        for batch in batches:
            texts, sizes, removed = [], [], []
            for i, j, w in _walks(batch, window):
                doc, start, windows = w.edges(batch.column("marks").slice(i, j - i))
                lists, values = _flat(batch.column("firsts").slice(i, j - i))
                later = ~np.isin(start, w.first[lists] + values)
                cover = np.zeros(len(w.hashes) + 1, dtype=np.int64)
                np.add.at(cover, start[later], 1)
                np.add.at(cover, start[later] + windows[later] - 1 + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                for k, text in enumerate(batch.column("_text").slice(i, j - i).cast(pa.large_binary()).to_pylist()):
                    parts, own = (text or b"").split(), gone[w.first[k]:w.first[k + 1]]
                    sizes.append(len(parts))
                    removed.append(int(own.sum()))
                    texts.append(b" ".join([p for p, g in zip(parts, own.tolist()) if not g] if removed[-1] else parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_key"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(texts, pa.binary()).cast(pa.string())], names=["_id", "_key", "n_words", "n_removed", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(id, _key, n_words, n_removed, kept_text)`` per row: every word covered by
    a window of ``window`` words that also starts earlier (smaller id, or same
    document, earlier start) is removed, windows being judged on the input; kept
    words are joined by one space. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.
    ``_key`` is the text's xxhash64, which with the id finds the row again.

    Null texts are empty; a null id comes before all others; of different texts
    under one id the one of smaller ``_key`` is earlier; rows that repeat both id
    and text are one document and keep the same words. An empty table gives an
    empty result. Other columns are not read, so their names cannot clash.
    ``window`` is 2 to 256 words.
    """
    if not 2 <= window <= _MOST:
        raise ValueError(f"window must be 2 to {_MOST} words")
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text"))

    # 1. repeated seeds, and whether their context is always the same
    seeds = rows.select("_text").mapInArrow(_seeds(window), "seed bigint, context bigint")
    seeds = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("c"), F.min("context").alias("a"), F.max("context").alias("b"))
    seeds = stage(seeds.filter("c > 1").select("seed", (F.col("a") == F.col("b")).cast("int").alias("single")), "repeated-seeds")
    # 2. back to the walks: a list of marked pieces for each document
    places = rows.mapInArrow(_places(window), "seed bigint, _id bigint, _key bigint, ordinal int").join(seeds, "seed")
    places = places.select("_id", "_key", (F.col("ordinal") * 2 + F.col("single")).alias("mark")).repartition("_id", "_key")
    marks = stage(places.groupBy("_id", "_key").agg(F.collect_set("mark").alias("marks")), "marked-pieces")
    free(seeds)
    # 3. edges of marked pieces, and the first source of each
    edges = _with_lists(rows, marks).mapInArrow(_edges(window), "edge bigint, check bigint, _id bigint, _key bigint, start int")
    firsts = edges.groupBy("edge", "check").agg(F.min(F.struct("_id", "_key", "start")).alias("at")).select("at.*")
    firsts = firsts.repartition("_id", "_key").groupBy("_id", "_key").agg(F.collect_list("start").alias("firsts"))
    lists = stage(_with_lists(marks, firsts, "left"), "first-edges")
    free(marks)
    return _with_lists(rows, lists, "left").mapInArrow(
        _kept(window), "_id bigint, _key bigint, n_words bigint, n_removed bigint, kept_text string").withColumnRenamed("_id", id_col)


def _with_lists(rows: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the columns that a table of ``(_id, _key)`` has for them."""
    own = lists.withColumnsRenamed({"_id": "_list_id", "_key": "_list_key"})
    on = rows["_id"].eqNullSafe(own["_list_id"]) & (rows["_key"] == own["_list_key"])
    return rows.join(own, on, how).drop("_list_id", "_list_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stay of all ``documents`` without repeated passages."""
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
