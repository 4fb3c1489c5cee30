"""Exact nearest vectors.

A corpus whose packed vectors have at most HANDED bytes is handed to every task as `Blocks`: neighbouring vectors lie in
blocks, and the largest and smallest component of a block's unit vectors bound what its members can reach, so only blocks that
can still change a result are opened. Queries then need no shuffle.

A larger corpus is searched by cells, as Spark joins. It is divided among centers, which are corpus vectors themselves. A cell knows its center and the largest angle of
a member to it. A query compares itself with the centers: the k-th best of them is a bound that its k best cannot fall below,
and a cell whose angle keeps all its members under that bound is left out. Queries meet the slices of the remaining cells in a
join of packed rows; each pair of a pack and a slice is one matrix product. The number of cells grows with the root of the
corpus, and both packs and slices are bounded, so a crowded cell is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import checkpointed

#: Bytes of vectors that may be handed to every task whole.
HANDED = 1 << 26
#: Vectors up to which all cosines cost less than choosing blocks, and queries that meet them at once.
PLAIN, TOGETHER = 512, 2048
#: Vectors of a block, and bounds (queries x blocks) held at once.
LEAF, BOUNDS = 16, 1 << 21
#: Cells per root of the corpus, corpus vectors per slice, queries per pack, vectors of a query scored at once.
CELLS, SLICE, PACK, STEP = 4, 2048, 256, 2048
#: Vectors of a block and queries of a pack where packs meet blocks.
BLOCK, QUERIES = 32_768, 1024
#: Rounding that a bound must leave room for.
SLACK = 1e-6

Unpack = Callable[[bytes], np.ndarray]


def one_vector(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, np.float64)[None]


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1))[:, None]
    return np.divide(m, norm, out=np.zeros_like(m, np.float64), where=norm > 0)


def handed(rows: DataFrame, dims: int, limit: int = HANDED) -> list | None:
    """All rows if their vectors have at most `limit` bytes, else None; the driver never gets more than one row beyond."""
    most = max(1, limit // (8 * dims))
    found = rows.limit(most + 1).collect()
    return found if len(found) <= most else None


def leaf_order(vectors: np.ndarray) -> np.ndarray:
    """Order in which runs of LEAF vectors are alike: halves by the component that varies most, again and again."""
    order = np.arange(len(vectors))
    todo = [(0, len(vectors))]
    while todo:
        a, z = todo.pop()
        if z - a > LEAF:
            part = vectors[order[a:z]]
            by = part[:, part.var(axis=0).argmax()]
            order[a:z] = order[a:z][np.argsort(by, kind="stable")]
            middle = a + LEAF * max(1, -(-(z - a) // LEAF) // 2)
            todo += [(a, middle), (middle, z)]
    return order


class Blocks:
    """Vectors in blocks with bounds on their cosines. `opened` counts the pairs of a query and a vector that were compared."""

    def __init__(self, vectors: np.ndarray, ids: list):
        alike = unit(vectors)
        order = leaf_order(alike)
        self.vectors, self.ids = np.ascontiguousarray(vectors[order]), np.array(ids)[order]
        self.named = np.argsort(self.ids, kind="stable")
        self.rank = np.argsort(self.named, kind="stable")
        self.own = (self.vectors * self.vectors).sum(axis=1)
        starts = np.arange(0, len(order), LEAF)
        self.high, self.low = np.maximum.reduceat(alike[order], starts), np.minimum.reduceat(alike[order], starts)
        self.counts = bool((vectors >= 0).all())
        self.opened = 0

    def steps(self, asked: np.ndarray) -> Iterator[slice]:
        step = max(16, BOUNDS // max(1, len(self.high)))
        return (slice(at, at + step) for at in range(0, len(asked), step))

    def bounds(self, asked: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest and smallest cosine that each block may hold."""
        more, less = np.maximum(asked, 0.0), np.minimum(asked, 0.0)
        over = np.divide(1.0, norm, out=np.zeros_like(norm), where=norm > 0)[:, None]
        return (more @ self.high.T + less @ self.low.T) * over, (more @ self.low.T + less @ self.high.T) * over

    def cosines(self, asked: np.ndarray, square: np.ndarray, block: int) -> np.ndarray:
        """Whole numbers stay whole up to the one square root, so equal cosines are equal."""
        part = slice(block * LEAF, (block + 1) * LEAF)
        norm = np.sqrt(square[:, None] * self.own[None, part])
        shared = asked @ self.vectors[part].T
        self.opened += shared.size
        return np.divide(shared, norm, out=np.zeros_like(shared), where=norm > 0)

    def all_cosines(self, asked: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Cosines with all vectors, in the order of their ids, for steps of the queries."""
        by_name, own = self.vectors[self.named].T, self.own[self.named]
        for at in range(0, len(asked), TOGETHER):
            part = slice(at, at + TOGETHER)
            norm = np.sqrt((asked[part] * asked[part]).sum(axis=1)[:, None] * own[None])
            shared = asked[part] @ by_name
            self.opened += shared.size
            yield part, np.divide(shared, norm, out=np.zeros_like(shared), where=norm > 0)

    def extremes(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest and smallest cosine of each query with all vectors."""
        hi, lo = np.full(len(asked), -np.inf), np.full(len(asked), np.inf)
        if len(self.ids) <= PLAIN:
            for part, c in self.all_cosines(asked):
                hi[part], lo[part] = c.max(axis=1), c.min(axis=1)
            return hi, lo
        for part in self.steps(asked):
            self._extremes(asked[part], hi[part], lo[part])
        return hi, lo

    def _extremes(self, asked: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> None:
        square = (asked * asked).sum(axis=1)
        upper, lower = self.bounds(asked, np.sqrt(square))
        fresh = np.ones(upper.shape, bool)

        def score(rows: np.ndarray, block: int) -> None:
            c = self.cosines(asked[rows], square[rows], block)
            hi[rows], lo[rows] = np.maximum(hi[rows], c.max(axis=1)), np.minimum(lo[rows], c.min(axis=1))
            fresh[rows, block] = False

        for best in (upper.argmax(axis=1), lower.argmin(axis=1)):
            for block in np.unique(best).tolist():
                score(np.flatnonzero((best == block) & fresh[:, block]), block)
        while True:
            # No cosine of counts is below 0, so one vector without a shared component settles the smallest.
            low = fresh & (lower <= lo[:, None] + SLACK) & ~(self.counts & (lo <= 0))[:, None]
            need = fresh & (upper >= hi[:, None] - SLACK) | low
            left = np.flatnonzero(need.any(axis=0))
            if not len(left):
                return
            # The blocks that most queries need first; bounds are looked at again after a few of them.
            for block in left[np.argsort(-need[:, left].sum(axis=0), kind="stable")][: max(4, len(left) // 8)].tolist():
                rows = need[:, block] & ((upper[:, block] >= hi - SLACK) | low[:, block] & ~(self.counts & (lo <= 0)))
                fresh[need[:, block] & ~rows, block] = False
                if rows.any():
                    score(np.flatnonzero(rows), block)

    def best(self, asked: np.ndarray, k: int, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the k best of each query, ties by id; `digits` rounds before comparing."""
        places, found = self.best_places(asked, k, digits)
        return self.ids[places], found

    def best_places(self, asked: np.ndarray, k: int, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """`best` with places in `ids` instead of ids."""
        k = min(k, len(self.ids))
        places, found = np.zeros((len(asked), k), np.int64), np.zeros((len(asked), k))
        if len(self.ids) <= PLAIN and k <= LEAF:
            for part, c in self.all_cosines(asked):
                c = c if digits is None else np.round(c, digits)
                rows = np.arange(len(c))
                for n in range(k):  # of equal cosines the first, which is that of the smallest id
                    top = c.argmax(axis=1)
                    places[part, n], found[part, n] = self.named[top], c[rows, top]
                    c[rows, top] = -np.inf
            return places, found
        for part in self.steps(asked):
            places[part], found[part] = self._best(asked[part], k, digits)
        return places, found

    def _best(self, asked: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
        square = (asked * asked).sum(axis=1)
        upper, _ = self.bounds(asked, np.sqrt(square))
        places, found = np.full((len(asked), k), -1), np.full((len(asked), k), -np.inf)
        rank = np.append(self.rank, len(self.rank))  # of no vector: behind all
        slack = SLACK if digits is None else max(SLACK, 2 * 10.0**-digits)

        def score(rows: np.ndarray, block: int) -> None:
            c = self.cosines(asked[rows], square[rows], block)
            c = c if digits is None else np.round(c, digits)
            at = np.arange(block * LEAF, block * LEAF + c.shape[1])
            at = np.concatenate([places[rows], np.broadcast_to(at, c.shape)], axis=1)
            c = np.concatenate([found[rows], c], axis=1)
            by_id = np.argsort(rank[at], axis=1, kind="stable")
            c, at = np.take_along_axis(c, by_id, 1), np.take_along_axis(at, by_id, 1)
            top = np.argsort(-c, axis=1, kind="stable")[:, :k]
            found[rows], places[rows] = np.take_along_axis(c, top, 1), np.take_along_axis(at, top, 1)
            upper[rows, block] = -np.inf

        for n in range(min(upper.shape[1], -(-k // LEAF) + 1)):
            best = upper.argmax(axis=1)
            for block in np.unique(best).tolist():
                score(np.flatnonzero(best == block), block)
        while True:
            need = upper >= np.maximum(found[:, -1:] - slack, -2.0)
            left = np.flatnonzero(need.any(axis=0))
            if not len(left):
                return places, found
            for block in left[np.argsort(-need[:, left].sum(axis=0), kind="stable")][: max(4, len(left) // 8)].tolist():
                rows = need[:, block] & (upper[:, block] >= found[:, -1] - slack)
                upper[need[:, block] & ~rows, block] = -np.inf
                if rows.any():
                    score(np.flatnonzero(rows), block)


@dataclass
class Index:
    """Unit centers and angles of the cells, and the slices (cell, ids, vectors)."""

    centers: np.ndarray
    angles: np.ndarray
    slices: DataFrame


def packed(vec) -> F.Column:
    """A vector column as the bytes of its doubles."""

    @F.pandas_udf("binary")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda v: np.asarray(v, np.float64).tobytes())

    return run(vec)


def packed_counts(span, dims: int) -> F.Column:
    """A span of bucket numbers as the bytes of its dense counts."""

    @F.pandas_udf("binary")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda s: np.bincount(np.asarray(s, np.int64), minlength=dims).astype(np.float64).tobytes())

    return run(span)


def build_index(corpus: DataFrame, id_col: str, payload: str, cells: int | None = None, slice_rows: int = SLICE) -> Index:
    """Index of vectors packed by `packed`; ids must differ and `corpus` is read more than once. Centers are the vectors with
    the smallest hashes of their ids.

    Without `cells` there is one per slice of the corpus, at most CELLS times the root of its size (the centers are collected).
    """
    rows = corpus.select(F.col(id_col).alias("id"), F.col(payload).alias("v"))
    n = rows.count()
    wanted = cells or max(1, min(-(-n // slice_rows), int(CELLS * n**0.5)))
    picked = rows.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(wanted).collect()
    centers = unit(np.stack([one_vector(bytes(r.v))[0] for r in picked])) if picked else np.zeros((0, 1))
    if not picked:
        empty = rows.select(F.lit(0).alias("cell"), F.array("id").alias("ids"), F.array("v").alias("vectors"))
        return Index(centers, np.zeros(0), empty)

    @F.pandas_udf("struct<cell:int,angle:double>")
    def place(batch: pd.Series) -> pd.DataFrame:
        near = unit(np.stack([one_vector(v)[0] for v in batch])) @ centers.T
        best = near.argmax(axis=1)
        return pd.DataFrame({"cell": best.astype(np.int32), "angle": np.arccos(np.clip(near[np.arange(len(near)), best], -1, 1))})

    placed = rows.withColumn("p", place("v")).select("id", "v", "p.*")
    sizes = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()}
    angles = np.array([sizes[c].angle if c in sizes else 0.0 for c in range(len(centers))])
    counts = [-(-sizes[c].n // slice_rows) if c in sizes else 1 for c in range(len(centers))]
    part = F.pmod(F.xxhash64(F.col("id").cast("string")), F.element_at(F.array(*map(F.lit, counts)), F.col("cell") + 1))
    slices = placed.groupBy("cell", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("m"))
    return Index(centers, angles, checkpointed(slices.select("cell", F.col("m.id").alias("ids"), F.col("m.v").alias("vectors"))))


def open_cells(vectors: np.ndarray, centers: np.ndarray, angles: np.ndarray, k: int, threshold: float, signs: tuple[int, ...]) -> np.ndarray:
    """Cells that may hold one of the k best of any of the vectors (or of the negated ones)."""
    cosines = unit(vectors) @ centers.T
    need = np.zeros(len(centers), bool)
    for sign in signs:
        c = np.clip(sign * cosines, -1, 1)
        known = np.sort(c, axis=1)[:, -k] if len(centers) >= k else np.full(len(c), -1.0)
        most = np.cos(np.maximum(np.arccos(c) - angles, 0.0))
        need |= (most >= np.maximum(known, threshold)[:, None] - SLACK).any(axis=0)
    return np.flatnonzero(need).astype(np.int32)


def meetings(index: Index, queries: DataFrame, unpack: Unpack, k: int = 1, threshold: float = -2.0, signs: tuple[int, ...] = (1,), pack: int = PACK, probes: int | None = None) -> DataFrame:
    """(q: array<struct<row, payload>>, ids, vectors): every query next to every slice it has to see.

    `queries` has (row, payload); `unpack` turns a payload into one or more vectors. They are packed by a hash of the row, so a
    pack of a cell holds about `pack` of them at most. With `probes`, a query sees only that many cells, those of the nearest
    centers.
    """
    centers, angles = index.centers, index.angles

    @F.pandas_udf("array<int>")
    def cells(batch: pd.Series) -> pd.Series:
        if probes:
            return pd.Series([np.argsort(-(unit(unpack(p)) @ centers.T).max(axis=0), kind="stable")[:probes].astype(np.int32) for p in batch])
        return pd.Series([open_cells(unpack(p), centers, angles, k, threshold, signs) for p in batch])

    opened = queries.select("row", "payload", F.explode_outer(cells("payload")).alias("cell")).where("cell is not null")
    parts = max(1, -(-queries.count() // pack))
    packs = opened.groupBy("cell", F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("row", "payload")).alias("q"))
    return packs.join(index.slices, "cell").select("q", "ids", "vectors")


def scores(batch: pd.DataFrame, unpack: Unpack, shrink: Callable[[np.ndarray], np.ndarray] = lambda c: c) -> Iterator[tuple[object, np.ndarray, list]]:
    """(row, cosines of its vectors with the slice, ids of the slice) for the rows of `meetings` in a pandas batch.

    The vectors of a row are worked on in steps, and `shrink` keeps of each step's matrix what the caller needs. Whole numbers stay whole up to the one square root, so equal cosines are equal.
    """
    for q, ids, vectors in zip(batch["q"], batch["ids"], batch["vectors"]):
        corpus = np.stack([one_vector(bytes(v))[0] for v in vectors])
        own = (corpus * corpus).sum(axis=1)
        for item in q:
            windows = unpack(bytes(item["payload"]))
            if len(windows) == 0:
                yield item["row"], np.zeros((0, len(corpus))), list(ids)
                continue
            parts = []
            for at in range(0, len(windows), STEP):
                asked = windows[at : at + STEP].astype(np.float64)
                norm = np.sqrt((asked * asked).sum(axis=1)[:, None] * own[None])
                shared = asked @ corpus.T
                parts.append(shrink(np.divide(shared, norm, out=np.zeros_like(shared), where=norm > 0)))
            yield item["row"], np.concatenate(parts), list(ids)


# --- packs of queries meet blocks of vectors ------------------------------------------------


def blocks_of(rows: DataFrame, n: int, columns: list[str], size: int = BLOCK) -> tuple[DataFrame, int]:
    """(block, m), number of blocks: the rows, about n of them, dealt by a hash of `id` into blocks of about `size`, sorted by
    `columns`."""
    many = max(1, -(-n // size))
    return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(many)).alias("block")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("m")), many


def packs_of(queries: DataFrame, order: list[str], size: int = QUERIES) -> DataFrame:
    """(ids, q): the queries (query_id, v) as packs of at most `size` neighbours of the order, vectors as bytes of doubles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, held = [], []
        for f in frames:
            for who, v in zip(f["query_id"], f["v"]):
                ids.append(who), held.append(np.asarray(v, np.float64))
                if len(ids) == size:
                    yield pd.DataFrame({"ids": [ids], "q": [np.stack(held).tobytes()]})
                    ids, held = [], []
        if ids:
            yield pd.DataFrame({"ids": [ids], "q": [np.stack(held).tobytes()]})

    parts = max(1, -(-queries.count() // size))
    dealt = queries.repartitionByRange(parts, *order).select("query_id", "v")
    return checkpointed(dealt.mapInPandas(run, f"ids array<{queries.schema['query_id'].dataType.simpleString()}>, q binary"))


def meet(packs: DataFrame, blocks: DataFrame, many: int, use: Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray]], Iterator[pd.DataFrame]], schema: str, groups: int = 1) -> DataFrame:
    """What `use` makes of (ids, queries, columns of the block) for every pack and every block. Packs are dealt into `groups`,
    and a group and a block are one key of the join."""
    fields = blocks.schema["m"].dataType.elementType.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                ids = b.column("ids")[at].values.to_numpy(zero_copy_only=False)
                q = np.frombuffer(b.column("q")[at].as_py(), np.float64).reshape(len(ids), -1)
                m = b.column("m")[at].values
                block = {n: m.field(n).to_numpy(zero_copy_only=False) for n in fields}
                for found in use(ids, q, block):
                    yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    everywhere = packs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))))
    if groups == 1:
        return everywhere.join(blocks, "block").select("ids", "q", "m").mapInArrow(run, schema)
    dealt = everywhere.withColumn("dealt", F.pmod(F.spark_partition_id(), F.lit(groups)))
    copies = blocks.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return dealt.join(copies, ["block", "dealt"]).select("ids", "q", "m").mapInArrow(run, schema)
