"""MinHash near-dedup with tensored banding.

Two collections of ``KEYS`` keys, each made of ``ROWS`` minhashes, stand for
``KEYS`` x ``KEYS`` tables: table (i, j) is keyed by key i of the first and key j
of the second collection. 2 * KEYS * ROWS minhashes so do the work of
2 * KEYS**2 * ROWS; two texts of similarity s share a table with probability
(1 - (1 - s**ROWS)**KEYS)**2, which is 0.999 at 0.75 and 0.9999 at 0.8.

Texts of equal shingle sets are one node first. A table key that only one node
has is never formed: a pair key needs both its halves to be shared. Entries of
the tables are two numbers, the slot and the node. Then

1. every node is verified against one pivot, the node of its tables' slots that
   meets most others (the original of a family of copies, as a rule), and the links
   give components;
2. what still lies in different components is compared. Two nodes share a table
   if they share a key of both collections, so they meet by the first (at most
   ``KEYS`` rows a node, not ``KEYS``**2) and the second is looked at there. Of
   two components that share a key one at least is not the largest that has it,
   so only nodes outside their key's largest component look for partners: each
   visits the blocks of bounded size that hold the others. A block's sets travel
   once for ``BLOCK`` visitors, not once for each pair, and only links return,
   one for each node and component at most.

Every link is confirmed on the full shingle sets, nothing is capped, and no slot
is collected: a key of very many nodes is many blocks and groups of visitors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlfold.llm import bytetext
from crawlfold.llm.components import components
from crawlfold.llm.staging import free, stage, unused
from crawlfold.session import ship_package

WIDTH = 5  # words of a shingle
SIMILARITY = 75  # percent
KEYS, ROWS = 20, 4

_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 2 * KEYS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The 2 * KEYS keys of a non-empty shingle set, as signed 64-bit numbers."""
    least = np.empty(len(_SEEDS), dtype=np.uint64)
    for i in range(0, len(_SEEDS), 8):  # few permutations at once stay in cache
        least[i:i + 8] = (shingles[None, :] * _SEEDS[i:i + 8, None]).min(axis=1)
    rows = bytetext.mix(least).reshape(2 * KEYS, ROWS)
    keys = np.zeros(2 * KEYS, dtype=np.uint64)
    for k in range(ROWS):
        keys = bytetext.mix(keys * np.uint64(31) + rows[:, k])
    return bytetext.mix(keys + np.arange(2 * KEYS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)).view(np.int64)


def _sets(column, width):
    """Shingle set of each text of a column, in order."""
    data, offsets = bytetext.buffers(column)
    for i, j in bytetext.slices(offsets):
        own = offsets[i:j + 1] - offsets[i]
        hashes, counts, _, _ = bytetext.words(data[offsets[i]:offsets[j]], own)
        yield from bytetext.shingles(hashes, counts, width)


def _sign(width):
    def run(batches):
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for s in _sets(batch.column("_text"), width):
                sizes.append(len(s))
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["_id", "_key", "n", "node", "keys"])
    return run


def _full_sets(width):
    def run(batches):
        for batch in batches:
            sets = [s.view(np.int64) for s in _sets(batch.column("_text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("nid"), pa.array(sets, pa.list_(pa.int64()))], names=["nid", "items"])
    return run


def _alive(nodes: DataFrame) -> DataFrame:
    """``(nid, a, b, met)``: the keys of the first and of the second collection that
    other nodes have too, of nodes with some of both (others share no table),
    and how many nodes they meet by them in all."""
    halves = nodes.select("nid", F.posexplode("keys").alias("i", "k"))
    common = stage(halves.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared-halves")
    alive = halves.join(common, "k").select("nid", (F.col("i") < KEYS).alias("first"), "k", "c").repartition("nid")
    alive = alive.groupBy("nid").agg(F.collect_list(F.when(F.col("first"), F.col("k"))).alias("a"),
                                     F.collect_list(F.when(~F.col("first"), F.col("k"))).alias("b"), F.sum(F.col("c") - 1).alias("met"))
    out = stage(alive.filter((F.size("a") > 0) & (F.size("b") > 0)), "alive-halves")
    free(common)
    return out


def _pivots(alive: DataFrame) -> DataFrame:
    """``(x, y)``: each node with the other node of its tables that meets most. A
    table's slot is keyed by a first and a second key together; keys that no
    other node has form none."""
    pairs = alive.select("nid", "met", F.explode("a").alias("k"), "b").select("nid", "met", "k", F.explode("b").alias("k2"))
    entries = pairs.select(F.xxhash64("k", "k2").alias("slot"), "nid", "met")
    tops = entries.groupBy("slot").agg(F.max(F.struct("met", "nid")).alias("top"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    best = entries.select("slot", "nid").join(stage(tops.select("slot", "top"), "tops"), "slot").filter("nid <> top.nid")
    best = best.groupBy("nid").agg(F.max("top").alias("top"))
    return stage(best.select(F.col("nid").alias("x"), F.col("top.nid").alias("y")), "pivots")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """``(u, v)`` of the pairs that are linked, on their full sets."""
    a = sets.select(F.col("nid").alias("x"), F.col("items").alias("_a"))
    b = sets.select(F.col("nid").alias("y"), F.col("items").alias("_b"))
    both = pairs.join(a, "x").join(b, "y")
    inner = F.size(F.array_intersect("_a", "_b"))
    both = both.select("x", "y", inner.alias("inner"), (F.size("_a") + F.size("_b")).alias("total"))
    return both.filter(100 * F.col("inner") >= similarity * (F.col("total") - F.col("inner"))).select(
        F.col("x").alias("u"), F.col("y").alias("v"))


BLOCK, BLOCK_ITEMS = 256, 1 << 20  # nodes and shingles of a block


def _blocks(firsts: DataFrame, roots: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of the nodes whose first keys lie in several components, ``(nid,
    root, block, groups)``, and their visitors, ``(nid, root, block, part)``: the
    nodes outside a key's largest component visit each block that has the key,
    in ``groups`` parts of bounded size."""
    named = firsts.join(roots, "nid", "left").select("k", "nid", F.coalesce("root", "nid").alias("root"))
    sizes = named.groupBy("k", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("k").agg(F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    found = stage(named.join(largest.select("k", F.col("top.root").alias("main")), "k"), "open-keys")
    # nodes of a component share blocks, and apart from these the outside nodes around it
    per = found.groupBy("nid", "root").agg(F.min("main").alias("main"), F.max(F.col("root") != F.col("main")).alias("outside"))
    per = per.join(nodes.select("nid", "n"), "nid").withColumn("around", F.when(F.col("outside"), F.col("main")).otherwise(F.col("root")))
    sizes = per.groupBy("around", "outside").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_ITEMS)).alias("cut"))
    block = F.xxhash64("around", "outside", F.pmod(F.xxhash64("nid"), F.col("cut")))
    placed = stage(per.join(sizes, ["around", "outside"]).select("nid", "root", block.alias("block")), "blocks")
    there = found.select("k", "nid").join(placed.select("nid", "block"), "nid").select("k", "block").distinct()
    visits = found.filter("root <> main").select("k", "nid", "root").join(there, "k").select("nid", "root", "block").distinct()
    visits = stage(visits, "visits")
    sizes = visits.join(nodes.select("nid", "n"), "nid").groupBy("block").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_ITEMS)).alias("groups"))
    sizes = stage(sizes, "visited")
    visitors = visits.join(sizes, "block").select("nid", "root", "block", F.pmod(F.xxhash64("nid"), F.col("groups")).alias("part"))
    free(found)
    return placed.join(sizes, "block"), visitors


def _compare(similarity: int):
    def keys(table: pa.Table) -> np.ndarray:
        return np.array(table.column("keys").combine_chunks().flatten()).reshape(table.num_rows, 2 * KEYS)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_u, out_v = [], []
        if left.num_rows and right.num_rows:
            ids, roots, items = right.column("nid").to_numpy(), right.column("root").to_numpy(), right.column("items").combine_chunks()
            flat, sizes = np.array(items.flatten()), np.array(items.value_lengths()).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            right_keys = keys(right)
            for i, (x, root, own, own_keys) in enumerate(zip(left.column("nid").to_numpy(), left.column("root").to_numpy(),
                                                             left.column("items").combine_chunks(), keys(left))):
                own = np.array(own.values)
                small, large = np.minimum(sizes, len(own)), np.maximum(sizes, len(own))
                equal = right_keys == own_keys
                may = (roots != root) & (100 * small >= similarity * large) & equal[:, :KEYS].any(axis=1) & equal[:, KEYS:].any(axis=1)
                if not may.any():
                    continue
                a, b = np.searchsorted(flat, own), np.searchsorted(flat, own, side="right")
                hits = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
                inner = np.bincount(owner[hits], minlength=len(sizes))
                linked = np.flatnonzero(may & (100 * inner >= similarity * (sizes + len(own) - inner)))
                for k in np.unique(roots[linked], return_index=True)[1].tolist():  # one link to a component is enough
                    out_u.append(x)
                    out_v.append(ids[linked[k]])
        return pa.table({"u": pa.array(out_u, pa.int64()), "v": pa.array(out_v, pa.int64())})
    return run


def _block_links(blocks: DataFrame, visitors: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """``(u, v)``: links between components, of each block's visitors with its nodes."""
    full = nodes.select("nid", "keys").join(sets, "nid")
    left = visitors.join(full, "nid")
    right = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1))).join(full, "nid")
    right = right.select(F.col("block").alias("b"), F.col("part").alias("p"), *[F.col(c).alias(c) for c in ("nid", "root", "keys", "items")])
    return left.groupBy("block", "part").cogroup(right.groupBy("b", "p")).applyInArrow(_compare(similarity), "u bigint, v bigint")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
           similarity: int = SIMILARITY) -> DataFrame:
    """``(id, _key, n_shingles, component_id, kept)`` per row; ``_key`` is the
    text's xxhash64, which with the id finds the row again.

    Null texts and texts without words have no shingles and are alone; rows of
    equal texts are linked (also rows that repeat an id; two texts under one id
    each have their own component). A null id is never a component's smallest
    unless all are null; ``kept`` compares null-safely. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text"))
    signed = stage(rows.mapInArrow(_sign(width), "_id bigint, _key bigint, n bigint, node binary, keys array<bigint>"), "signatures")

    nodes = signed.filter("n > 0").groupBy("node").agg(
        F.min("_id").alias("least"), F.min(F.struct("_id", "_key")).alias("at"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = stage(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    alive = _alive(nodes)
    # full sets of the nodes that may share a table, each from one of its rows
    wanted = nodes.join(alive.select("nid"), "nid", "left_semi").select("nid", "at._id", "at._key")
    texts = rows.join(wanted, rows["_id"].eqNullSafe(wanted["_id"]) & (rows["_key"] == wanted["_key"]))
    sets = texts.select("nid", "_text").mapInArrow(_full_sets(width), "nid bigint, items array<bigint>")
    sets = stage(sets.dropDuplicates(["nid"]), "sets")  # a row that repeats id and text is there twice

    star = _pivots(alive)
    links = stage(_verified(star, sets, similarity), "star-links")
    roots = stage(components(links), "roots").withColumnRenamed("node", "nid")
    free(star)
    blocks, visitors = _blocks(alive.select("nid", F.explode("a").alias("k")), roots, nodes)
    more = stage(_block_links(blocks, visitors, nodes, sets, similarity), "block-links")
    if not more.isEmpty():
        roots = stage(components(links.unionByName(more)), "roots").withColumnRenamed("node", "nid")
    free(alive, sets)

    named = nodes.join(roots, "nid", "left").select("node", "least", F.coalesce("root", "nid").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = stage(named.join(smallest, "root").select("node", "component_id"), "components")
    free(nodes)
    out = signed.select("_id", "_key", "n", "node").join(final, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), "_key", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that their component keeps, with all columns, whatever
    their names. Rows that repeat both id and text stand or fall together."""
    own_id, own_key = unused(docs, "kept_id"), unused(docs, "kept_key")
    kept = assign(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias(own_id), F.col("_key").alias(own_key)).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_key)), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign(docs).drop("_key")
