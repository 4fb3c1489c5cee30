"""Inverted-file index of unit vectors with product codes, stored as tables.

Centers are trained by mini-batch k-means in Spark and their number grows with the root of the corpus. A vector belongs to its
nearest center; what remains of it is cut into parts, and each part is named by the nearest of CODES vectors of its codebook.
A query looks into the cells of its nearest centers, ranks their members by codes alone (a few bytes each), and only the best
`rerank` of every BLOCK vectors are compared with their full vectors. The table is partitioned by cell, so probes prune files.
Every row is indexed; codebooks are fitted on at most TRAIN rows, those with the smallest hashes of their ids.

A search deals the index by id into blocks of about BLOCK vectors and the queries, by nearest cell, into packs. Each pack meets
each block once and leaves its k best there, so what is shuffled is the index once and the packs and k hits once per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.nearest import blocks_of, meet, packs_of, unit
from wardline.session import checkpointed

TRAIN, CODES = 16_384, 256
#: Cells per folder of the table.
TOGETHER = 16
#: Queries whose codes are looked at together.
STEP = 128


@dataclass
class VectorIndex:
    path: str
    centers: np.ndarray
    books: np.ndarray  # parts x CODES x dims / parts
    rows: int

    def codes(self, spark: SparkSession) -> DataFrame:
        """(part, cell, ids, codes): the codes of a cell."""
        members = self.vectors(spark).groupBy("part", "cell").agg(F.sort_array(F.collect_list(F.struct("id", "code"))).alias("m"))
        return members.select("part", "cell", F.col("m.id").alias("ids"), F.col("m.code").alias("codes"))

    def vectors(self, spark: SparkSession) -> DataFrame:
        """(id, cell, code, v, part), as stored."""
        return spark.read.parquet(f"{self.path}/vectors")


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def trained_centers(rows: DataFrame, cells: int, batch: int, rounds: int) -> np.ndarray:
    """Mini-batch k-means: every round a part of the rows, by hash, moves the centers towards the means of what is near them."""
    first = rows.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(cells).select("v").toPandas()
    centers, seen = unit(stacked(first["v"])), np.zeros(len(first))
    total = rows.count()
    parts = max(1, round(total / batch))
    for k in range(rounds):
        now = centers

        def run(frames: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            sums, n = np.zeros_like(now), np.zeros(len(now))
            for f in frames:
                v = unit(stacked(f["v"]))
                if len(f):
                    near = (v @ now.T).argmax(axis=1)
                    np.add.at(sums, near, v)
                    n += np.bincount(near, minlength=len(now))
            used = np.flatnonzero(n)
            yield pd.DataFrame({"cell": used, "n": n[used], "s": pd.Series(list(sums[used]), dtype=object)})

        mine = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(k)), F.lit(parts)) == 0).select("v")
        found = mine.mapInPandas(run, "cell long, n double, s array<double>").select("cell", "n", F.posexplode("s").alias("d", "x"))
        found = found.groupBy("cell", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).groupBy("cell").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("s"))
        for r in found.toLocalIterator():  # one vector per cell
            seen[r.cell] += r.n
            centers = centers.copy() if centers is now else centers
            centers[r.cell] += (np.array(r.s) / r.n - centers[r.cell]) * r.n / seen[r.cell]
        centers = unit(centers)
    return centers


def codebook(part: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """k-means of a few thousand short vectors, from rows spread over their order."""
    book = part[np.linspace(0, len(part) - 1, codes).astype(int)].copy()
    for _ in range(rounds):
        near = ((book * book).sum(axis=1) - 2 * part @ book.T).argmin(axis=1)
        n = np.bincount(near, minlength=codes)
        sums = np.zeros_like(book)
        np.add.at(sums, near, part)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


def build(corpus: DataFrame, id_col: str, vec: str, path: str, cells: int | None = None, parts: int = 16, rounds: int = 6) -> VectorIndex:
    """Write the index of all rows with a vector under `path`; ids are whole numbers that differ, the dimension a multiple of
    `parts`."""
    rows = checkpointed(corpus.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v")))
    n = rows.count()
    if n == 0:
        raise ValueError("an index needs vectors")
    cells = cells or max(1, int(n**0.5))
    centers = trained_centers(rows, cells, 64 * cells, rounds)
    sample = stacked(rows.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(TRAIN).select("v").toPandas()["v"])
    u = unit(sample)
    rest = u - centers[(u @ centers.T).argmax(axis=1)]
    books = np.stack([codebook(p, min(CODES, len(p))) for p in np.split(rest, parts, axis=1)])

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                v = unit(stacked(f["v"]))
                cell = (v @ centers.T).argmax(axis=1)
                names = [((b * b).sum(axis=1) - 2 * p @ b.T).argmin(axis=1) for p, b in zip(np.split(v - centers[cell], parts, axis=1), books)]
                yield pd.DataFrame({"id": f["id"], "cell": cell, "part": cell // TOGETHER, "code": [c.tobytes() for c in np.stack(names, axis=1).astype(np.uint8)], "v": f["v"]})

    # Vectors stay in their own type: floats take half the room of doubles and are the same numbers.
    coded = rows.mapInPandas(encode, f"id long, cell int, part int, code binary, v {rows.schema['v'].dataType.simpleString()}")
    coded.repartition("part", F.pmod(F.xxhash64("id"), F.lit(64))).sortWithinPartitions("cell").write.partitionBy("part").parquet(f"{path}/vectors")
    return VectorIndex(path, centers, books, n)


def search(index: VectorIndex, queries: DataFrame, id_col: str, vec: str, k: int = 5, probes: int = 8, rerank: int = 100, threshold: float = -1.0) -> DataFrame:
    """(query_id, corpus_id, similarity, rank, n_read): the best k by exact cosine of the members of the probed cells that rank
    first by their codes, `rerank` of every block (one block up to nearest.BLOCK vectors); n_read is the number of full vectors
    a query read."""
    spark, centers, books = queries.sparkSession, index.centers, index.books
    asked = queries.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vec).cast("array<double>").alias("v"))

    def probed(q: np.ndarray) -> np.ndarray:
        """Queries x cells: the cells of the nearest centers."""
        near = np.argsort(-(unit(q) @ centers.T), axis=1, kind="stable")[:, :probes]
        out = np.zeros((len(q), len(centers)), bool)
        out[np.arange(len(q))[:, None], near] = True
        return out

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                q = stacked(f["v"])
                yield pd.DataFrame({"query_id": f["query_id"], "near": (unit(q) @ centers.T).argmax(axis=1), "parts": [np.unique(np.flatnonzero(o) // TOGETHER) for o in probed(q)], "v": f["v"]})

    placed = checkpointed(asked.mapInPandas(nearest, "query_id long, near int, parts array<int>, v array<double>"))
    parts = [r.part for r in placed.select(F.explode("parts").alias("part")).distinct().collect()]  # folders, of which there are few
    blocks, many = blocks_of(index.vectors(spark).where(F.col("part").isin(parts)), index.rows, ["cell", "id", "code", "v"])

    def scan(ids: np.ndarray, q: np.ndarray, block: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        names = np.stack([np.frombuffer(c, np.uint8) for c in block["code"]])
        cell, vectors = block["cell"], stacked(block["v"])
        told = centers[cell] + np.concatenate([book[column] for book, column in zip(books, names.T)], axis=1)
        told, own = told.astype(np.float32), (vectors * vectors).sum(axis=1)
        for at in range(0, len(q), STEP):
            mine = q[at : at + STEP]
            opened = probed(mine)
            some = np.flatnonzero(opened.any(axis=0)[cell])  # members of a cell that one of these queries opens
            if not len(some):
                continue
            allowed = opened[:, cell[some]]
            score = np.where(allowed, unit(mine).astype(np.float32) @ told[some].T, -np.inf)
            most = min(rerank, len(some))
            top = np.argpartition(-score, most - 1, axis=1)[:, :most]
            good, top = np.take_along_axis(allowed, top, 1), some[top]
            norm = np.sqrt((mine * mine).sum(axis=1)[:, None] * own[top])
            shared = np.matmul(vectors[top], mine[:, :, None])[:, :, 0]
            sim = np.round(np.divide(shared, norm, out=np.zeros_like(shared), where=norm > 0), 9)
            sim[~good] = -np.inf
            best = np.lexsort((block["id"][top], -sim), axis=1)[:, :k]
            sim, hit = np.take_along_axis(sim, best, 1), block["id"][np.take_along_axis(top, best, 1)]
            kept = (sim >= threshold) & np.isfinite(sim)
            who = np.broadcast_to(ids[at : at + STEP, None], sim.shape)
            yield pd.DataFrame({"query_id": ids[at : at + STEP], "corpus_id": -1, "similarity": -np.inf, "n_read": good.sum(axis=1)})
            yield pd.DataFrame({"query_id": who[kept], "corpus_id": hit[kept], "similarity": sim[kept], "n_read": 0})

    met = meet(packs_of(placed.select("query_id", "near", "v"), ["near", "query_id"]), blocks, many, scan, "query_id long, corpus_id long, similarity double, n_read long")
    # A query has k hits and one count a block.
    hits = F.filter(F.collect_list(F.struct((-F.col("similarity")).alias("less"), "corpus_id")), lambda h: F.isnotnull(h["less"]) & (h["less"] < F.lit(float("inf"))))
    ranked = met.groupBy("query_id").agg(F.slice(F.sort_array(hits), 1, k).alias("hits"), F.sum("n_read").alias("n_read"))
    rows = ranked.select("query_id", "n_read", F.posexplode("hits").alias("at", "hit"))
    return rows.select("query_id", F.col("hit.corpus_id").alias("corpus_id"), (-F.col("hit.less")).alias("similarity"), "n_read", (F.col("at") + 1).cast("long").alias("rank"))
