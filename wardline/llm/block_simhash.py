"""Document fingerprints by SimHash and search by permuted block tables.

Terms are pairs of neighbouring words. A term's 64-bit hash votes on every bit with the sign of that bit, weighted by how
often the term occurs (1 + floor(log2 n), whole numbers, so sums do not depend on their order).

For a radius r the 64 bits are cut into blocks, r + EXTRA of them. Two fingerprints within the radius agree in at least
EXTRA blocks, so they meet in the table keyed by those blocks; there is one table for every choice of EXTRA blocks, each with
those blocks in front. A table's cell is cut into runs of bounded size; run pairs, not cells, are the unit of work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from wardline.llm import common

#: Blocks that near fingerprints share at least; more make smaller cells and more tables.
EXTRA = 2
RUN = 256
REMEMBERED = 100_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


HASHES = WordHashes()


def term_hashes(text: str) -> np.ndarray:
    """Hashes of the pairs of neighbouring words; of the word itself if there is only one."""
    words = text.encode().split()
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    if len(h) < 2:
        return h
    x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ ((h[1:] << np.uint64(31)) | (h[1:] >> np.uint64(33)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: str) -> int:
    """64 bits; a bit is 1 if the weighted votes for it are more than those against it. 0 for a text without words."""
    terms, counts = np.unique(term_hashes(text), return_counts=True)
    weights = 1 + np.floor(np.log2(counts)).astype(np.float64) if len(counts) else np.empty(0)
    votes = np.zeros(64)
    for at in range(0, len(terms), 1 << 15):
        bits = np.unpackbits(terms[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += weights[at : at + (1 << 15)] @ bits
    return int.from_bytes(np.packbits(2 * votes > weights.sum(), bitorder="little").tobytes(), "little")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


# --- fingerprints of a table and of its edited texts ---------------------------------------------

_ROW = "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def compared(doc_id: int | None, text: str, fp: int, after: str, fp_after: int) -> tuple:
    """The result row of a text whose latter half gives way to the beginning of the text after it."""
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    fp_edited = fingerprint(edited) if edited != text else fp
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, signed(fp), signed(fp_edited), likeness(fp, fp_edited), likeness(fp, fp_after)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) per row; the next row is by (doc_id, text).

    One shuffle by ranges of the id: each task reads its range in order, so the next text is at hand. Only the last text of
    a range waits for the first of the following one. Null ids come first, null texts are empty, repeated rows and ids
    follow each other, a single row follows itself; other columns are ignored; an empty table gives an empty table.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [f.split()[0] for f in _ROW.split(", ")]

    def record(rows_: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
        """Result rows, then edges (0 first or 1 last of a range, part, doc_id, text)."""
        columns = [list(c) for c in zip(*rows_)] if rows_ else [[] for _ in names]
        out = {n: c + [e[2] if n == "doc_id" else None for e in edges] for n, c in zip(names, columns)}
        blank = [None] * len(rows_)
        out |= {"edge": blank + [e[0] for e in edges], "part": blank + [e[1] for e in edges], "text": blank + [e[3] for e in edges]}
        return pa.RecordBatch.from_pydict(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for b in common.slices(batches, 256):
            done, edges = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fp = fingerprint(text)
                if before:
                    done.append(compared(*before, text, fp))
                else:
                    edges.append((0, part, doc_id, text))
                before = doc_id, text, fp
            yield record(done, edges)
        if before:
            yield record([], [(1, part, *before[:2])])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 64):
            done = [compared(i, t, fingerprint(t), after, fingerprint(after)) for i, t, after in zip(*(c.to_pylist() for c in b.columns))]
            yield record(done, []).select(names)

    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (f.split() for f in _ROW.split(", "))])
    for field in (("edge", pa.int32()), ("part", pa.int32()), ("text", pa.string())):
        schema = schema.append(pa.field(*field))
    ranged = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    made = common.stored(ranged.mapInArrow(run, f"{_ROW}, edge int, part int, text string"), "edited-fingerprints")
    first, last = made.where("edge = 0").select(F.col("part").alias("next"), F.col("text").alias("after")), made.where("edge = 1")
    follow = last.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))
    pairs = last.select("part", "doc_id", "text").join(follow, "part").join(first, "next").select("doc_id", "text", "after")
    return made.where("edge is null").select(names).unionByName(pairs.mapInArrow(across, _ROW))


# --- block tables ----------------------------------------------------------------------------


def block_masks(radius: int, extra: int = EXTRA) -> list[int]:
    """One mask per table: the bits of the chosen blocks."""
    n = radius + extra
    edge = [64 * k // n for k in range(n + 1)]
    block = [(1 << edge[k + 1]) - (1 << edge[k]) for k in range(n)]
    return [sum(block[k] for k in chosen) for chosen in combinations(range(n), extra)]


def near_links(distinct: DataFrame, radius: int = 3, extra: int = EXTRA, pairs: bool = False) -> DataFrame:
    """Neighbours of distinct fingerprints (fp long): (fp, n_near) for those that have any, or every pair (a, b) with a < b.

    A pair counts in the first table in which it meets. All neighbours within the radius are found.
    """
    masks = np.array(block_masks(radius, extra), np.uint64)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array((fp & mask).view(np.int64)), pa.array(fp.view(np.int64))], ["t", "cell", "fp"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, cell, fp = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(t):
                continue
            fresh = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (cell[1:] != cell[:-1])])
            inside = np.arange(len(t)) - np.repeat(fresh, np.diff(np.r_[fresh, len(t)]))
            cuts = np.flatnonzero(inside % RUN == 0)
            members = [p.tobytes() for p in np.split(fp.astype("<i8"), cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(t[cuts]), pa.array(cell[cuts]), pa.array(fp[cuts]), pa.array(members, pa.binary())], ["t", "cell", "run", "members"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 64):
            left, right = [], []
            for t, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                apart = a[:, None] ^ b[None]
                near = np.bitwise_count(apart) <= radius
                for mask in masks[:t]:
                    near &= (apart & mask) != 0
                i, j = np.nonzero(np.triu(near, 1) if x == y else near)
                left.append(a[i].view(np.int64))
                right.append(b[j].view(np.int64))
            a, b = np.concatenate(left), np.concatenate(right)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            else:
                fp, n = np.unique(np.r_[a, b], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(n.astype(np.int64))], ["fp", "n"])

    spread = distinct.select("fp").mapInArrow(tables, "t int, cell long, fp long").repartitionByRange(parts, "t", "cell", "fp").sortWithinPartitions("t", "cell", "fp")
    cut = common.checkpointed(spread.mapInArrow(runs, "t int, cell long, run long, members binary"))
    other = cut.select("t", "cell", F.col("run").alias("run2"), F.col("members").alias("right"))
    # A run of one has no neighbour in its own cell; runs of one cell meet once.
    both = cut.join(other, ["t", "cell"]).where("run < run2 or (run = run2 and length(members) > 8)").select("t", F.col("members").alias("left"), "right")
    if pairs:
        return both.mapInArrow(compare, "a long, b long")
    return both.mapInArrow(compare, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n_near"))


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """`edited_fingerprints` with fingerprints in hex and n_near, the number of other fingerprints within the radius."""
    made = common.checkpointed(edited_fingerprints(docs, id_col, text_col))
    near = near_links(made.select("fp").distinct(), radius)
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return made.join(near, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", digits("fp").alias("fingerprint"), digits("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
