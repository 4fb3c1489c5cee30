"""One document of each group of near copies, by wide SimHash fingerprints in several Gray orders.

64 bits cannot tell a word-shingle similarity of 0.8: there pairs differ in 9 or 10 bits, give or take 3, and no exact index
reaches so far. Here a fingerprint has 512 bits over the distinct shingles. At a Jaccard similarity s a bit differs with
probability p = acos(2s / (1 + s)) / pi, so the radius follows from s: mean 78, deviation 8 for 0.8. It is set so wide that one
pair in a thousand there lies outside; pairs of a similarity of 0.65 to 0.8 lie inside in part.

Orders put different bits in front. Rows that share the leading bits of an order form a cell, the upper node of the index;
other pairs are pruned as whole groups. Inside a cell rows are in Gray rank and differences are accumulated word by word, a
pair is dropped once they exceed the radius. Two rows at p meet in a cell with probability (1 - p) ** depth per order. The
depth grows with the logarithm of the table, so that cells keep their size, and the number of orders with the depth, so that
the share of pairs that never meet stays at `MISSED`. With no more rows than a cell holds every pair is compared.

A cell of more than `BLOCK` rows is salted. First its parts are compared in themselves; then, with the components found in
all orders, blocks of the whole cell meet each other, but blocks of one and the same component never do. So a large group of
near copies costs its blocks, not their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import common
from wardline.llm.gray_dedup import TOP, forest, gray_rank, roots, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
BITS = 512
WORDS = BITS // 64
#: Share of the pairs at exactly the asked similarity that share no leading bits in any order.
MISSED = 0.001
#: Deviations that the radius lies above the mean distance at the asked similarity: one pair in a thousand there is outside.
DEVIATIONS = 3.09
CELL = 2048
BLOCK = 4096
TILE = 128
#: More large cells than this are joined without a broadcast (each is a pair of numbers and stands for more than BLOCK rows).
HANDED = 100_000


# --- fingerprints ------------------------------------------------------------------------


def widened(hashes: np.ndarray) -> np.ndarray:
    """512 bits for each 64-bit hash: one splitmix64 step per word."""
    z = hashes[:, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def wide_fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """Majority bits over the distinct shingles; ties go with the smallest hash; zero without words."""
    hashes = np.unique(shingle_hashes(text, shingle))
    counts = np.zeros(BITS, np.int64)
    if not len(hashes):
        return bytes(BITS // 8)
    for at in range(0, len(hashes), 255):
        part = widened(hashes[at : at + 255])
        counts += np.unpackbits(part.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    first = np.unpackbits(widened(hashes[:1]).view(np.uint8))
    return np.packbits(2 * counts + first > len(hashes)).tobytes()


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(row, id, fp binary) of every row; row numbers the rows of `docs`."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            fps = [wide_fingerprint(t, shingle) for t in common.as_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.binary())], ["row", "id", "fp"])

    return rows.mapInArrow(run, f"row long, id {kind}, fp binary")


def flip_rate(similarity: float) -> float:
    """Probability that a bit differs at this Jaccard similarity of two sets of one size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_of(similarity: float) -> int:
    p = flip_rate(similarity)
    return round(BITS * p + DEVIATIONS * math.sqrt(BITS * p * (1 - p)))


def orders_of(depth: int, similarity: float) -> int:
    """Orders after which at most MISSED of the pairs at this similarity have never shared `depth` leading bits."""
    met = (1 - flip_rate(similarity)) ** depth
    return 1 if met >= 1 else math.ceil(math.log(MISSED) / math.log(1 - met))


# --- orders and cells ----------------------------------------------------------------------


def order_bits(order: int, depth: int) -> np.ndarray:
    """The 64 positions that an order has in front; leads are disjoint until all bits were used, then the stride changes."""
    at = order * max(depth, 1)
    return ((at + np.arange(64)) * (2 * (at // BITS) + 1)) % BITS


def words_of(column: pa.Array) -> np.ndarray:
    """(rows, WORDS) of a column of fingerprints."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def ranked(distinct: DataFrame, depth: int, orders: int) -> DataFrame:
    """Each fingerprint in every order: its cell (the leading bits) and its Gray rank, shifted so that it sorts as a long."""
    fronts = [order_bits(o, depth) for o in range(orders)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 4096):
            bits = np.unpackbits(words_of(b.column(1)).view(np.uint8), axis=1)
            for order, front in enumerate(fronts):
                lead = np.ascontiguousarray(np.packbits(bits[:, front], axis=1)).view(">u8")[:, 0].astype(np.uint64)
                cell = (lead >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(lead), np.int64)
                rank = (gray_rank(lead) ^ TOP).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lead), order, np.int32)), pa.array(cell), pa.array(rank), b.column(0), b.column(1)], ["ord", "cell", "rank", "node", "fp"])

    return distinct.select("node", "fp").mapInArrow(run, "ord int, cell long, rank long, node long, fp binary")


# --- links ---------------------------------------------------------------------------------


def linked(a: np.ndarray, root: np.ndarray, radius: int, b_from: int = 0) -> np.ndarray:
    """The smallest row of each component, for rows `a` whose known components are in `root`.

    Differences are accumulated: half of the words for all pairs of a tile, the rest only for pairs still inside the radius.
    Pairs of one component are not compared again. Rows from `b_from` on are only compared with rows before it, if given.
    """
    n, half = len(a), WORDS // 2
    columns = np.ascontiguousarray(a.T)
    own = np.arange(n)
    for at in range(0, b_from or n, TILE):
        end, other = min(at + TILE, b_from or n), b_from or at
        apart = np.zeros((end - at, n - other), np.uint16)
        for w in range(half):
            apart += np.bitwise_count(columns[w, at:end, None] ^ columns[w, None, other:])
        i, j = np.nonzero((apart <= radius) & (root[at:end, None] != root[None, other:]))
        rest = np.bitwise_count(a[i + at, half:] ^ a[j + other, half:]).sum(axis=1)
        near = apart[i, j] + rest <= radius
        if near.any():
            root = forest(n, np.r_[own, i[near] + at], np.r_[root, j[near] + other])
    return root


def cell_links(placed: DataFrame, radius: int, block: int) -> DataFrame:
    """(a, b) links that span the components of every run of equal (ord, cell, salt), at most two blocks at a time."""

    def spanning(node: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root = linked(fps, np.arange(len(fps)), radius)
        member = np.flatnonzero(root != np.arange(len(fps)))
        return node[member], node[root[member]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, fps = np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty((0, WORDS), np.uint64)

        def flushed(last: bool) -> pa.RecordBatch:
            nonlocal key, node, fps
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist(), len(key)]
            found, done = [], 0
            for s, e in zip(edges, edges[1:]):
                while e - s >= 2 * block or (s < e and (last or e < len(key))):
                    stop = min(e, s + 2 * block)
                    found.append(spanning(node[s:stop], fps[s:stop]))
                    s = done = stop
            key, node, fps = key[done:], node[done:], fps[done:]
            both = [np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in both], ["a", "b"])

        for b in batches:
            key = np.r_[key, np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)]
            node, fps = np.r_[node, b.column(3).to_numpy(zero_copy_only=False)], np.r_[fps, words_of(b.column(4))]
            yield flushed(False)
        yield flushed(True)

    sorted_rows = placed.select("ord", "cell", "salt", "node", "fp")
    return sorted_rows.mapInArrow(run, "a long, b long")


def component_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows sorted by (ord, cell, part) cut into blocks of one cell: (id, ord, cell, lo, hi, parts, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order, cell, part = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            if not len(order):
                continue
            fresh = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (order[1:] != order[:-1])])
            inside = np.arange(len(order)) - np.repeat(fresh, np.diff(np.r_[fresh, len(order)]))
            cuts = np.flatnonzero(inside % block == 0)
            fps = words_of(b.column(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(order[cuts].astype(np.int32)), pa.array(cell[cuts]), pa.array(np.minimum.reduceat(part, cuts)), pa.array(np.maximum.reduceat(part, cuts)),
                 pa.array([p.tobytes() for p in np.split(part, cuts[1:])], pa.binary()), pa.array([p.tobytes() for p in np.split(fps, cuts[1:])], pa.binary())],
                ["ord", "cell", "lo", "hi", "parts", "members"],
            )

    blocks = rows.select("ord", "cell", "part", "fp").mapInArrow(run, "ord int, cell long, lo long, hi long, parts binary, members binary")
    return blocks.withColumn("id", F.monotonically_increasing_id())


def block_links(pairs: DataFrame, radius: int) -> DataFrame:
    """(a, b) links between components of two blocks (or inside one block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 16):
            for same, pa_, ma, pb, mb in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(pa_ if same else pa_ + pb, np.int64)
                fps = np.frombuffer(ma if same else ma + mb, np.uint64).reshape(-1, WORDS)
                _, first, group = np.unique(part, return_index=True, return_inverse=True)
                known = first[group]
                root = linked(fps, known, radius, 0 if same else len(pa_) // 8)
                moved = np.flatnonzero(part[root] != part)
                edges = np.unique(np.stack([part[moved], part[root[moved]]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def components(distinct: DataFrame, similarity: float = SIMILARITY, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(node, root) of every linked row of `distinct` (node long, fp binary), root being the smallest node of its component.

    `distinct` has one row per fingerprint and is read several times: store it before.
    """
    n = distinct.count()
    depth, radius = max(0, math.ceil(math.log2(max(n, 1) / cell))), radius_of(similarity)
    placed = ranked(distinct, depth, orders_of(depth, similarity))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = common.checkpointed(placed.groupBy("ord", "cell").agg(F.count("*").alias("rows")).where(F.col("rows") > block))
    hot = large.count()
    handed = F.broadcast(large) if hot <= HANDED else large
    salts = F.ceil(F.col("rows") / block)
    salted = placed.join(handed, ["ord", "cell"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("node", "ord"), salts), F.lit(0)))
    dealt = salted.repartition(parts, "ord", "cell", "salt").sortWithinPartitions("ord", "cell", "salt", "rank")
    label = roots(common.checkpointed(cell_links(dealt, radius, block)))
    if not hot:
        return label
    rows = placed.join(handed, ["ord", "cell"]).join(label, "node", "left").withColumn("part", F.coalesce("root", "node"))
    by_part = rows.repartitionByRange(parts, "ord", "cell", "part", "node").sortWithinPartitions("ord", "cell", "part", "rank")
    blocks = common.checkpointed(component_blocks(by_part, max(1, block // 4)))
    a, b = (blocks.select(*(F.col(c).alias(c + s) for c in ("ord", "cell", "id", "lo", "hi"))) for s in "ab")
    settled = (F.col("loa") == F.col("hia")) & (F.col("lob") == F.col("hib")) & (F.col("loa") == F.col("lob"))
    meet = a.join(b, (a.orda == b.ordb) & (a.cella == b.cellb) & (a.ida <= b.idb) & ~settled).select("ida", "idb")
    left = blocks.select(F.col("id").alias("ida"), F.col("parts").alias("pa"), F.col("members").alias("ma"))
    right = blocks.select(F.col("id").alias("idb"), F.col("parts").alias("pb"), F.col("members").alias("mb"))
    pairs = meet.join(left, "ida").join(right, "idb").select((F.col("ida") == F.col("idb")).alias("same"), "pa", "ma", "pb", "mb")
    return roots(label.toDF("a", "b").union(block_links(pairs, radius)))


def representatives(docs: DataFrame, id_col: str, text_col: str, similarity: float, shingle: int, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprint rows, and (fp, best) of every distinct one: the id and row that its component keeps."""
    of = common.stored(wide_fingerprints(docs, id_col, text_col, shingle), "wide-fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row"))
    distinct = common.stored(of.groupBy("fp").agg(first.alias("best")).withColumn("node", F.col("best.row")), "wide-distinct")
    known = distinct.join(components(distinct, similarity, **sizes), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return of, known


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, **sizes: int) -> DataFrame:
    """One row per document: doc_id and component_id, the smallest doc_id among the documents linked to it.

    Two documents are linked if their wide fingerprints differ in no more bits than `radius_of(similarity)` and they share
    the leading bits of an order (all do in a table of at most CELL rows). Null, empty and blank texts are copies of each
    other. Equal rows are all returned. Rows without an id take part; component_id is null if no member has an id. Other
    columns are ignored; an empty table gives an empty table. Ties do not arise. `docs` is read once.
    """
    of, known = representatives(docs, id_col, text_col, similarity, shingle, **sizes)
    least = known.groupBy("root").agg(F.min("best.id").alias("component_id"))
    named = known.join(least, "root").select("fp", "component_id")
    return of.join(named, "fp").select(F.col("id").alias("doc_id"), "component_id")


def one_per_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE,
    also: Callable[[DataFrame, str, str], DataFrame] | None = None, **sizes: int,
) -> DataFrame:
    """The documents without near copies, with all their columns: of each group of `similar_groups` the smallest id stays.

    With `also`, a function of (table, id, text) that returns doc_id and component_id, its groups and these are one group
    where they share a document. A null id is larger than any other; of rows that agree in the id the first stays. `docs` is
    read more than once and must number its rows alike, as a written table does.
    """
    row = F.monotonically_increasing_id().alias("row")
    of, known = representatives(docs, id_col, text_col, similarity, shingle, **sizes)
    if also is not None:
        known = common.checkpointed(known)
        of_row = of.join(known.select("fp", "root"), "fp").select("row", "root")
        named = also(docs.select(row, F.col(text_col).alias("text")), "row", "text").where("doc_id <> component_id")
        # Copies are one root by now, so that a large group is few links.
        links = named.join(of_row.toDF("doc_id", "a"), "doc_id").select("a", "component_id").distinct()
        links = links.join(of_row.toDF("component_id", "b"), "component_id").select("a", "b")
        met = roots(links).toDF("root", "first")
        known = known.join(met, "root", "left").withColumn("root", F.coalesce("first", "root"))
    stay = known.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    return docs.select(row, F.struct("*").alias("doc")).join(stay, "row", "left_semi").select("doc.*")
