"""Vector bin packing of training examples.

Every example needs an amount of three resources: tokens, segments and
loss-bearing tokens. A sequence (bin) has a limit for each. The open bin takes,
again and again, the fitting example whose need has the largest dot product
with what is left of the bin (both relative to the limits). Each task packs its
own partition as a stream: a pool of at most ``POOL`` examples, so memory is
bounded, nothing is shuffled, and no key can become hot. Bins that the pool
cannot fill well wait for more examples; only a partition's last ones stay open
to padding. A lost task packs the same partition again: same rows, same ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlfold.llm import encoders
from crawlfold.session import ship_package

POOL = 4096  # examples a task holds at once
KEEP = 512  # examples that wait for later ones
MIN_CUT = 32  # shortest piece that a cut makes
# limits of the query and the pipeline beside 2048 tokens: segments for the attention mask
# of a sequence, loss tokens so that no sequence is one document's middle alone
MAX_SEGMENTS, MAX_LOSS = 64, 2040

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "`offset` bigint, loss_tokens bigint")
BINS = "example_id string, tokens bigint, segments bigint, loss_tokens bigint, bin_id bigint, slot bigint, oversize boolean"


def fill_bin(needs: np.ndarray, free: np.ndarray, limits: np.ndarray) -> tuple[list[int], np.ndarray]:
    """One bin by the dot-product heuristic: indices of the chosen rows of
    ``needs``, in order, and what is left. ``free`` marks rows not yet placed
    and is updated. Ties go to the first row."""
    left, share, chosen = limits.astype(np.float64), needs / limits, []
    fits = free & (needs <= left).all(axis=1)
    while fits.any():
        score = np.where(fits, share @ (left / limits), -1.0)
        i = int(score.argmax())
        chosen.append(i)
        free[i] = False
        left = left - needs[i]
        fits &= free & (needs <= left).all(axis=1)
    return chosen, left


def pack_vectors(needs: np.ndarray, limits) -> np.ndarray:
    """Bin number of each row of ``needs`` (n x resources). A row above a limit
    has a bin of its own. Reference form, without pool or cuts."""
    needs, limits = np.asarray(needs, dtype=np.float64).reshape(-1, len(limits)), np.asarray(limits, dtype=np.float64)
    bins, free, n = np.full(len(needs), -1), np.ones(len(needs), dtype=bool), 0
    for i in np.flatnonzero((needs > limits).any(axis=1)):
        bins[i], free[i], n = n, False, n + 1
    while free.any():
        chosen, _ = fill_bin(needs, free, limits)
        bins[chosen], n = n, n + 1
    return bins


class _Pool:
    """Pending examples of one task. ``emit(items, bin_number)`` gets each
    finished bin; ``cut(item, left)`` gives a head of an item that fits what is
    left of a bin, the tail and the tail's need (or None where it may not be cut so),
    or is None itself."""

    def __init__(self, limits, emit, cut=None):
        self.limits, self.emit, self.cut = np.asarray(limits, dtype=np.float64), emit, cut
        self.items, self.needs, self.bins = [], [], 0

    def close(self, items) -> None:
        self.emit(items, self.bins)
        self.bins += 1

    def add(self, item, need) -> None:
        self.items.append(item)
        self.needs.append(need)
        if len(self.items) >= POOL:
            self.pack(KEEP)

    def pack(self, keep: int = 0) -> None:
        """Fill bins until no more than ``keep`` examples are left."""
        needs, items = np.array(self.needs, dtype=np.float64).reshape(-1, len(self.limits)), list(self.items)
        free = np.ones(len(items), dtype=bool)
        while int(free.sum()) > keep:
            chosen, left = fill_bin(needs, free, self.limits)
            out = [items[i] for i in chosen]
            if self.cut and left[0] >= MIN_CUT and left[1] >= 1 and free.any():
                # nothing fits whole: the longest example that still leaves a fair rest gives its head
                k = int(np.where(free, needs[:, 0], -1).argmax())
                if parts := self.cut(items[k], left):
                    head, items[k], needs[k] = parts
                    out.append(head)
            self.close(out)
        self.items = [items[i] for i in np.flatnonzero(free)]
        self.needs = [tuple(needs[i]) for i in np.flatnonzero(free)]


def _sequence_base() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 32


class _Piece:
    """Part of one document's ids."""

    __slots__ = ("doc_id", "ids", "start", "total")

    def __init__(self, doc_id, ids, start, total):
        self.doc_id, self.ids, self.start, self.total = doc_id, ids, start, total

    def need(self) -> tuple[int, int, int]:
        # no id predicts a document's first one, so that bears no loss
        return len(self.ids), 1, len(self.ids) - (self.start == 0)

    def room(self, tokens: int, loss: int) -> int:
        """Ids of this piece, from its start, that ``tokens`` and ``loss`` have room for."""
        return min(tokens, loss + (self.start == 0))

    def cut(self, left):
        n = self.room(int(left[0]), int(left[2]))
        return self.split(n) if n >= MIN_CUT and len(self.ids) >= n + MIN_CUT else None

    def split(self, n: int):
        head = _Piece(self.doc_id, self.ids[:n], self.start, self.total)
        tail = _Piece(self.doc_id, self.ids[n:], self.start + n, self.total)
        return head, tail, tail.need()


def _pack_texts(tokenizer_path: str, end_id: int, limits):
    length, _, max_loss = limits

    def run(batches):
        encode, base, rows = encoders.load(tokenizer_path), _sequence_base(), []

        def emit(pieces, number):
            offset = 0
            for p in pieces:
                n, _, loss = p.need()
                rows.append((p.doc_id, p.start, n, zlib.crc32(p.ids.tobytes()), p.total, base + number, offset, loss))
                offset += n

        def flush():
            table = pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 8)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"])
            rows.clear()
            return table

        pool = _Pool(limits, emit, cut=lambda piece, left: piece.cut(left))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(0, len(texts), 64):
                for doc_id, own in zip(ids.slice(i, 64).to_pylist(), encode([t or "" for t in texts.slice(i, 64).to_pylist()])):
                    own = np.array([*own, end_id], dtype="<u4")
                    rest = _Piece(doc_id, own, 0, len(own))
                    while len(rest.ids) >= (room := rest.room(length, max_loss)):  # whole sequences of one long document
                        head, rest, _ = rest.split(room)
                        pool.close([head])
                    if len(rest.ids):
                        rest.ids = rest.ids.copy()
                        pool.add(rest, rest.need())
                if len(rows) >= 8192:
                    yield flush()
        pool.pack()
        yield flush()
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, max_segments: int = 2048,
                   max_loss: int | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut all documents into pieces and pack these into sequences of at most
    ``length`` tokens, ``max_segments`` pieces and ``max_loss`` loss-bearing
    tokens (default: ``length``): a row per piece. All ids of a document but its
    first bear loss, so a lower ``max_loss`` cuts long documents earlier and the
    first ids of others, if any, fill the rest.

    A document's ids are its text's (null: none) and ``end_id``, so every row
    of ``docs`` has at least one id; repeated rows and ids are packed each on
    their own; an empty table gives no rows; other columns are not read.
    ``sequence_id`` holds the task's partition in its upper 32 bits.
    """
    max_loss = length if max_loss is None else max_loss
    if max_loss < min(length, MIN_CUT):
        raise ValueError(f"a loss limit under {MIN_CUT} leaves no piece worth a cut")
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_pack_texts(tokenizer_path, end_id, (length, max_segments, max_loss)), PIECES)


def _pack_rows(limits):
    def run(batches):
        base, out = _sequence_base(), []
        pool = _Pool(limits, lambda items, number: out.extend((*x, base + number, slot, False) for slot, x in enumerate(items)))

        def flush():
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            table = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[
                "example_id", "tokens", "segments", "loss_tokens", "bin_id", "slot", "oversize"])
            out.clear()
            return table

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if any(x > y for x, y in zip(row[1:], limits)):
                    out.append((*row, base + pool.bins, 0, True))
                    pool.bins += 1
                else:
                    pool.add(row, row[1:])
            yield flush()
        pool.pack()
        yield flush()
    return run


def pack_examples(examples: DataFrame, max_tokens: int, max_segments: int, max_loss: int, id_col: str = "example_id",
                  tokens_col: str = "tokens", segments_col: str = "segments", loss_col: str = "loss_tokens") -> DataFrame:
    """Pack whole instruction examples (never cut) under all three limits: each
    row's ``bin_id`` and ``slot``. An example above a limit gets a bin of its
    own, marked ``oversize``; null needs count as 0; ids may repeat."""
    ship_package(examples.sparkSession)
    need = [F.greatest(F.coalesce(F.col(c).cast("bigint"), F.lit(0)), F.lit(0)).alias(n) for c, n in (
        (tokens_col, "tokens"), (segments_col, "segments"), (loss_col, "loss_tokens"))]
    narrow = examples.select(F.col(id_col).cast("string").alias("example_id"), *need)
    return narrow.mapInArrow(_pack_rows((max_tokens, max_segments, max_loss)), BINS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens, 64 segments and 2040
    loss-bearing tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), max_segments=MAX_SEGMENTS, max_loss=MAX_LOSS)
