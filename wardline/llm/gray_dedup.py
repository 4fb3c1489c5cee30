"""Near-duplicate groups by SimHash with a hierarchical index in Gray order.

Fingerprints are sorted by Gray rank, so neighbours share long bit patterns. Runs of the order become leaf blocks; a block
keeps the bits on which all its members agree (mask and pattern), blocks of one leading pattern form a cell, and inside a
block small nodes factor further bits. Differences are accumulated from the top: cells that differ too much are never
paired, block and node pairs are dropped as soon as the bits fixed so far differ in more than the radius.

One order finds near pairs cheaply only if their leading bits are close. With three orders, each with another third of the
64 bits in front, two fingerprints within 4 bits differ in at most one bit of some leading third; so in each order a cell
meets itself and the cells one leading bit away, and no link is lost.

Copies collapse to one row per fingerprint before anything is compared. A cell with many fingerprints is many blocks, and a
block pair, not a cell, is the unit of work. Each block pair reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from wardline.llm import common

SEED = 42
ORDERS = 3
LEADING = 21
BLOCK = 256
NODE = 16
TOP = np.uint64(1 << 63)


# --- fingerprints ------------------------------------------------------------------------


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; a shorter text is one shingle, a text without words none."""
    words = text.lower().split()  # bytes: A-Z only, and blanks are 20 and 09-0D
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    starts = [0, *ends[: len(words) - shingle]]
    return np.fromiter((xxh64_intdigest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :])), np.uint64, len(starts))


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8", copy=False)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) of every row; null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            fps = np.array([majority_bits(shingle_hashes(t, shingle)) for t in common.as_bytes(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# --- Gray order and blocks -----------------------------------------------------------------


def rotated(fps: np.ndarray, order: int) -> np.ndarray:
    """The bits turned so that the order's third leads."""
    left = np.uint64(order * LEADING)
    return fps if not order else (fps << left) | (fps >> (np.uint64(64) - left))


def restored(bits: np.ndarray, order: int) -> np.ndarray:
    left = np.uint64(order * LEADING)
    return bits if not order else (bits >> left) | (bits << (np.uint64(64) - left))


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Position of a bit string in the reflected Gray sequence."""
    rank = bits.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


def gray_bits(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


def shared_bits(bits: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, pattern) of the runs that begin at cuts: the bits on which all members agree."""
    ones = np.bitwise_and.reduceat(bits, cuts)
    return ones | ~np.bitwise_or.reduceat(bits, cuts), ones


def ranked(distinct: DataFrame) -> DataFrame:
    """Each fingerprint in every order: (ord, rank), the rank shifted so that signed longs sort like unsigned ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for order in range(ORDERS):
                rank = gray_rank(rotated(fps, order)) ^ TOP
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), order, np.int32)), pa.array(rank.view(np.int64))], ["ord", "rank"])

    return distinct.select("fp").mapInArrow(run, "ord int, rank long")


def leaf_blocks(ordered: DataFrame, depth: int, size: int) -> DataFrame:
    """Sorted rows cut into blocks of one cell (equal first `depth` bits) and at most `size` members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = b.column(0).to_numpy(zero_copy_only=False)
            rank = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64) ^ TOP
            if not len(order):
                continue
            bits = gray_bits(rank)
            cell = (bits >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(bits), np.int64)
            fresh = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (order[1:] != order[:-1])])
            inside = np.arange(len(bits)) - np.repeat(fresh, np.diff(np.r_[fresh, len(bits)]))
            cuts = np.flatnonzero(inside % size == 0)
            mask, pattern = shared_bits(bits, cuts)
            members = [p.tobytes() for p in np.split(bits.astype("<u8"), cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(order[cuts].astype(np.int32)), pa.array(cell[cuts]), pa.array((rank[cuts] ^ TOP).view(np.int64)), pa.array(mask.view(np.int64)),
                 pa.array(pattern.view(np.int64)), pa.array(members, pa.binary())],
                ["ord", "cell", "block", "mask", "pattern", "members"],
            )

    return ordered.mapInArrow(run, "ord int, cell long, block long, mask long, pattern long, members binary")


def block_pairs(blocks: DataFrame, depth: int, radius: int) -> DataFrame:
    """Block pairs of one cell or of cells one leading bit apart whose fixed bits differ in at most `radius` places."""
    flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max(depth - 1, 0))), lambda j: F.col("cell").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), j))), lambda c: c != F.col("cell"))
    to = F.concat(F.array("cell"), flips) if depth else F.array("cell")
    left = blocks.select("ord", F.col("block").alias("a"), F.col("mask").alias("ma"), F.col("pattern").alias("pa"), F.col("members").alias("left"), F.col("cell").alias("own"), F.explode(to).alias("cell"))
    right = blocks.select("ord", "cell", F.col("block").alias("b"), "mask", "pattern", F.col("members").alias("right"))
    fixed = F.bit_count(F.col("pa").bitwiseXOR(F.col("pattern")).bitwiseAND(F.col("ma")).bitwiseAND(F.col("mask")))
    on = (left.ord == right.ord) & (left.cell == right.cell) & ((F.col("own") != right.cell) | (F.col("a") <= F.col("b"))) & (fixed <= radius)
    return left.join(right, on).select(left.ord, "left", "right")


# --- links -----------------------------------------------------------------------------------


def near_positions(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with at most `radius` differing bits, descending from nodes to members."""
    cut_a, cut_b = np.arange(0, len(a), NODE), np.arange(0, len(b), NODE)
    mask_a, pattern_a = shared_bits(a, cut_a)
    mask_b, pattern_b = shared_bits(b, cut_b)
    apart = np.bitwise_count((pattern_a[:, None] ^ pattern_b[None]) & mask_a[:, None] & mask_b[None])
    node_a, node_b = np.nonzero(apart <= radius)
    step = np.arange(NODE)
    i, j = cut_a[node_a][:, None] + step, cut_b[node_b][:, None] + step
    close = np.bitwise_count(a[np.minimum(i, len(a) - 1)][:, :, None] ^ b[np.minimum(j, len(b) - 1)][:, None, :]) <= radius
    close &= (i < len(a))[:, :, None] & (j < len(b))[:, None, :]
    pair, x, y = np.nonzero(close)
    return i[pair, x], j[pair, y]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes, the smallest node reachable over the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def links(pairs: DataFrame, radius: int) -> DataFrame:
    """(a, b) links that span every linked set of a block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 64):
            found: dict[int, list[np.ndarray]] = {}
            for order, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                i, j = near_positions(a, b, radius)
                if x == y:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                both = restored(np.r_[a, b] if x != y else a, order)
                root = forest(len(both), i, j + (len(a) if x != y else 0))
                member = np.flatnonzero(root != np.arange(len(both)))
                found.setdefault(0, []).append(both[member])
                found.setdefault(1, []).append(both[root[member]])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found[k]).view(np.int64)) for k in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_links(distinct: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Links that connect exactly the fingerprints connected at `radius` or fewer differing bits.

    `distinct` has one row per fingerprint and is read more than once. Three leading thirds allow a radius of up to 5.
    """
    if radius > 2 * ORDERS - 1:
        raise ValueError("three orders find pairs of up to 5 differing bits")
    n = distinct.count()
    depth = min(LEADING, max(0, math.ceil(math.log2(max(1, 2 * n / block)))))
    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ranked(distinct).repartitionByRange(parts, "ord", "rank").sortWithinPartitions("ord", "rank")
    blocks = common.checkpointed(leaf_blocks(ordered, depth, block))
    return links(block_pairs(blocks, depth, radius), radius)


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links, root being the smallest node reachable; large and small stars in turn.

    Every round is checkpointed, so a lost executor costs one round. Stops when a round changes nothing.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()

    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = common.checkpointed(pairs)
    seen = state(pairs)
    while seen[0]:
        both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        # Checkpointed sides are plain shuffles, whose hot keys Spark splits in the joins.
        low = common.checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = common.checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = common.checkpointed(small.select("e.*").where("u <> v").distinct())
        now = state(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its linked documents).

    Null, empty and blank texts share fingerprint 0 and are linked like any other. Equal rows are all returned. Rows without
    an id take part and never become a component_id (null if no member has one). Other columns are ignored; an empty table
    gives an empty table. Ties do not arise: components do not depend on any order.
    """
    of = common.checkpointed(fingerprints(docs, id_col, text_col, shingle))
    distinct = common.checkpointed(of.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = roots(near_links(distinct, radius)).select(F.col("node").alias("fp"), "root")
    known = distinct.join(label, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(least, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return of.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """The documents without near copies, with all their columns: of each group the one with the smallest id stays.

    A null id is larger than any other; of rows that agree in the id the first stays. `docs` is read more than once and must
    number its rows alike, as a written table does.
    """
    row = F.monotonically_increasing_id().alias("row")
    groups = near_groups(docs.select(row, F.col(text_col).alias("text")), "row", "text", radius, shingle).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row"))
    stay = groups.join(docs.select(row, F.col(id_col).alias("id")), "row").groupBy("component_id").agg(first.alias("f")).select(F.col("f.row").alias("row"))
    return docs.select(row, F.struct("*").alias("doc")).join(stay, "row", "left_semi").select("doc.*")
