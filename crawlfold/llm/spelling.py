"""Spelling variants by a bit-sliced position index.

The vocabulary is counted with built-in functions (one partial aggregate a task
and word). Words one edit apart share their first or their last half key, so each
word is indexed under both, and buckets of such keys are cut into blocks of
bounded size. A block holds, for each (position, letter), the bitset of its words
with that letter there. A query word is read once, letter by letter, and four
bitsets follow it over the whole block: no error so far (aligned), one
replacement (aligned), one letter inserted (shifted up) and one deleted (shifted
down). Each query block meets each index block of its bucket, so a hot key is many
tasks and none holds more than a block of either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlfold.llm.staging import free, stage
from crawlfold.session import ship_package

MIN_LENGTH = 6  # code points
MIN_COUNT = 5
RATIO = 5  # a form is at least so many times as frequent
EVERY = 199  # runs of this crc32 divisor lose a code point
BLOCK = 4096  # words
BLOCK_LETTERS = 1 << 18
LONG = 64  # letters beyond which words get blocks of their own
CHUNK = 512  # queries at once

_RUN = "([A-Za-z\\u00C0-\\u00FF]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """``(word, n)`` of the letter runs of whole texts, lower-cased in A-Z, of at
    least ``min_length`` code points and ``min_count`` occurrences. Where
    ``every`` divides h, the unsigned crc32 of ``<id>:<run>``, the run's code
    point h % length is left out first. A null text has no runs, a null id is
    written as the empty string."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(name.alias("_id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(_RUN), F.lit(1))).alias("_run"))
    runs = runs.filter(F.length("_run") >= min_length).select("_id", F.translate("_run", _UPPER, _LOWER).alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    cut = F.overlay("_run", F.lit(""), (F.col("_h") % F.length("_run") + 1).cast("int"), F.lit(1))
    words = runs.select("_run", h.alias("_h")).select(F.when(F.col("_h") % every == 0, cut).otherwise(F.col("_run")).alias("word"))
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and each word's first place (and the end)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


class PositionIndex:
    """Bitsets over some words, one for each (position, letter) and length."""

    _SPAN = 0x110000

    def __init__(self, words: list[str]):
        codes, first = _letters(words)
        lengths = np.diff(first)
        owner = np.repeat(np.arange(len(words)), lengths)
        self.keys, rows = np.unique((np.arange(len(codes)) - first[owner]) * self._SPAN + codes, return_inverse=True)
        self.width = (len(words) + 63) // 64
        self.bits = self._sets(rows, owner, len(self.keys))
        self.lengths, rows = np.unique(lengths, return_inverse=True)
        self.of_length = self._sets(rows, np.arange(len(words)), len(self.lengths))

    def _sets(self, rows, owner, n):
        out = np.zeros((n + 1, self.width), dtype=np.uint64)  # the last is the empty set
        np.bitwise_or.at(out, (rows, owner >> 6), np.uint64(1) << (owner & 63).astype(np.uint64))
        return out

    def _at(self, position: int, codes: np.ndarray) -> np.ndarray:
        key = position * self._SPAN + codes
        rows = np.searchsorted(self.keys, key)
        rows[rows == len(self.keys)] = 0
        return self.bits[np.where(self.keys[rows] == key, rows, len(self.keys))]

    def _long(self, length: int) -> np.ndarray:
        row = int(np.searchsorted(self.lengths, length))
        return self.of_length[row if row < len(self.lengths) and self.lengths[row] == length else -1]

    def one_edit(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, word)`` numbers at distance one; ``queries`` holds code points
        of words of one length, a row each."""
        n, m = queries.shape
        same = np.full((n, self.width), ~np.uint64(0))
        replaced, deleted = np.zeros_like(same), np.zeros_like(same)
        inserted = same.copy()
        for i in range(m):
            here, up = self._at(i, queries[:, i]), self._at(i + 1, queries[:, i])
            deleted &= self._at(i - 1, queries[:, i]) if i else np.uint64(0)
            deleted |= same
            replaced &= here
            replaced |= same & ~here
            same &= here
            inserted &= up
            inserted |= same
            if i % 32 == 31 and not (same.any() or replaced.any() or inserted.any() or deleted.any()):
                break
        found = (replaced & self._long(m)) | (inserted & self._long(m + 1)) | (deleted & self._long(m - 1))
        some = np.flatnonzero(found.any(axis=1))
        bits = np.unpackbits(found[some].view(np.uint8), axis=1, bitorder="little")
        q, w = np.nonzero(bits)
        return some[q], w


def _blocks(words: list[str]) -> list[np.ndarray]:
    """Word numbers in blocks whose bitsets stay small: a few very long words
    must not widen the position range of all."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = [np.flatnonzero(lengths <= LONG)]
    block, letters = [], 0
    for i in np.flatnonzero(lengths > LONG)[np.argsort(lengths[lengths > LONG], kind="stable")].tolist():
        if len(block) == 64 or (block and letters + lengths[i] > 16 * BLOCK_LETTERS):
            out.append(np.array(block))
            block, letters = [], 0
        block.append(i)
        letters += int(lengths[i])
    return [b for b in [*out, np.array(block, dtype=np.int64)] if len(b)]


def near_pairs(words: list[str], queries: list[str]):
    """Arrays of (query number, word number) pairs at an edit distance of one."""
    codes, first = _letters(queries)
    lengths = np.diff(first)
    order = np.argsort(lengths, kind="stable")
    for block in _blocks(words):
        index = PositionIndex([words[i] for i in block.tolist()])
        for m in np.unique(lengths).tolist():
            if not index.lengths[0] - 1 <= m <= index.lengths[-1] + 1:
                continue
            own = order[np.searchsorted(lengths[order], m):np.searchsorted(lengths[order], m, side="right")]
            for i in range(0, len(own), CHUNK):
                part = own[i:i + CHUNK]
                q, w = index.one_edit(codes[first[part][:, None] + np.arange(m)])
                yield part[q], block[w]


def _meet(half):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        words, counts = index.column("word").to_pylist(), index.column("n").to_numpy()
        asked, side = queries.column("word").to_pylist(), queries.column("side").to_pylist()
        by_side = {}
        for i, s in enumerate(index.column("side").to_pylist()):
            by_side.setdefault(s, []).append(i)
        left, right, n = [], [], []
        for s, own in by_side.items():
            mine = [i for i, x in enumerate(side) if x == s]
            for q, w in near_pairs([words[i] for i in own], [asked[i] for i in mine]):
                for a, b in zip(q.tolist(), w.tolist()):
                    a, b = mine[a], own[b]
                    # each pair once: where the first letters agree by those, else by the last
                    if (asked[a][:half] == words[b][:half]) if s == 0 else (asked[a][:half] != words[b][:half] and asked[a][-half:] == words[b][-half:]):
                        left.append(asked[a])
                        right.append(words[b])
                        n.append(counts[b])
        return pa.table({"word": pa.array(left, pa.string()), "other": pa.array(right, pa.string()), "other_n": pa.array(n, pa.int64())})
    return run


def near_words(vocab: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``(word, other, other_n)``: all ordered pairs of words of a table of
    distinct ``(word, n)`` that differ by one inserted, deleted or replaced code
    point. Words have at least ``min_length`` (2 or more) code points: an edit
    leaves the first or the last ``min_length // 2`` letters of both alone."""
    ship_package(vocab.sparkSession)
    half = min_length // 2
    buckets = max(1, vocab.count() // BLOCK)
    keys = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, half).alias("key")),
                   F.struct(F.lit(1).alias("side"), F.substring("word", -half, half).alias("key")))
    sides = vocab.select("word", "n", F.explode(keys).alias("_k")).select(
        "word", "n", "_k.side", F.pmod(F.xxhash64("_k.side", "_k.key"), F.lit(buckets)).alias("bucket"), F.xxhash64("word").alias("_h"))
    sizes = sides.groupBy("bucket").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / BLOCK, F.sum(F.length("word")) / BLOCK_LETTERS)).alias("blocks"))
    cut = sides.join(sizes, "bucket").withColumn("own", F.pmod(F.col("_h"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    index = cut.select("word", "n", "side", "bucket", F.col("own").alias("block"), every.alias("asking"))
    asking = cut.select(F.col("word").alias("word"), F.col("side").alias("side"), F.col("bucket").alias("in_bucket"),
                        every.alias("to_block"), F.col("own").alias("from_block"))
    groups = index.groupBy("bucket", "block", "asking").cogroup(asking.groupBy("in_bucket", "to_block", "from_block"))
    return groups.applyInArrow(_meet(half), "word string, other string, other_n bigint")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                   min_count: int = MIN_COUNT, ratio: int = RATIO, every: int = EVERY) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of each vocabulary word: its near
    word of largest n (ties: smallest in code-point order) is its form if that n
    is at least ``ratio`` times its own; root is the end of the chain of forms.

    Empty tables and tables of null texts give no rows; repeated rows count as
    often as they stand there; other columns are not read.
    """
    vocab = stage(vocabulary(docs, id_col, text_col, min_length, min_count, every), "vocabulary")
    best = near_words(vocab, min_length).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("top"))
    named = vocab.join(best, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("bigint")))
    follows = -F.col("top.less") >= ratio * F.col("n")
    named = stage(named.select("word", "n", "n_near", F.when(follows, F.col("top.other")).alias("form"),
                               F.when(follows, -F.col("top.less")).alias("form_n")), "forms")
    free(vocab)
    # counts grow along a chain by the ratio, so it ends; each round doubles the step
    roots = stage(named.select("word", F.coalesce("form", "word").alias("root"), F.col("form").isNotNull().alias("moved")), "roots")
    while roots.filter("moved").limit(1).count():
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        nxt = stage(roots.join(ahead, "root").select("word", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("moved")), "roots")
        free(roots)
        roots = nxt
    return named.join(roots.drop("moved"), "word").select("word", "form", "root", "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of ``documents``."""
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
