"""Byte-level BPE over overlapping chunks.

A long text becomes chunks that overlap, one row each, pre-tokenised in parallel. Each chunk reports the ends of its
pre-tokens, but only those that no text beyond the chunk can move, and none behind a blank (a run of blanks is split
differently where a text ends). Two neighbours that both end a pre-token at the same place of their overlap read on alike
from there, since the pattern looks only ahead: that place is the stitch. The piece of a chunk between its two stitches is
then encoded on its own, and a document's ids are its pieces' ids in order. A text of one chunk is one piece and is encoded
where it is read. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm import common

CHUNK = 1 << 15
OVERLAP = 512
#: Characters after a pre-token that can still change it: a contraction has three, a run of blanks looks one ahead.
AHEAD = 3


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder:
    """Splits texts by the pattern and encodes pieces by the ranks."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        self.split = regex.compile(pattern).findall
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=vocabulary(path), special_tokens={})

    def ids(self, piece: str) -> np.ndarray:
        return self.library.encode_to_numpy(piece, disallowed_special=()).astype(np.int32)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def lists(arrays: list[np.ndarray], kind=np.int32) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, kind)]).astype(kind)))


def certain_ends(text: str, pieces: list[str], base: int, last: bool) -> list[int]:
    """Ends of the pre-tokens of a chunk that begins at `base`: no text after the chunk can move them, no blank is before."""
    sure = len(text) if last else len(text) - AHEAD
    return [base + e for e in accumulate(map(len, pieces)) if e <= sure and not text[e - 1].isspace()]


def chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, doc_id, i, last, text) with `overlap` characters of the next chunk at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 16):
            for row, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                n = -(-len(text) // chunk)
                for at in range(0, n, 256):
                    i = range(at, min(n, at + 256))
                    yield pa.RecordBatch.from_pylist(
                        [{"row": row, "doc_id": doc_id, "i": k, "last": k == n - 1, "text": text[k * chunk : (k + 1) * chunk + overlap]} for k in i], schema
                    )

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("i", pa.int32()), ("last", pa.bool_()), ("text", pa.string())])
    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return long.mapInArrow(run, "row long, doc_id long, i int, last boolean, text string").repartition(parts, "row", "i")


def pretokenised(pieces: DataFrame, path: str, pattern: str, chunk: int) -> DataFrame:
    """The chunks with the certain ends of their pre-tokens, as positions in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = encoder(path, pattern).split
        for b in common.slices(batches, 16):
            found = [
                np.array(certain_ends(t, split(t), i * chunk, last), np.int64)
                for i, last, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, lists(found, np.int64)], [*b.schema.names, "ends"])

    return pieces.mapInArrow(run, "row long, doc_id long, i int, last boolean, text string, ends array<long>")


def stitches(cut: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, i, from, to, group): what each chunk encodes.

    If two neighbours share no end in their overlap (one pre-token is longer than it), everything from there on is one
    group, which is split again from its last certain start.
    """
    begin = F.col("i").cast("long") * chunk
    zone = lambda lo: F.filter("ends", lambda e: (e >= lo) & (e < lo + overlap))
    small = cut.select("row", "i", "last", zone(begin).alias("head"), zone(begin + chunk).alias("tail"))
    order = Window.partitionBy("row").orderBy("i")
    small = small.withColumn("to", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
    small = small.withColumn("broken", F.min(F.when(F.col("to").isNull() & ~F.col("last"), F.col("i"))).over(Window.partitionBy("row")))
    small = small.withColumn("from", F.coalesce(F.lag("to").over(order), F.lit(0)))
    return small.select("row", "i", "from", "to", F.least("i", "broken").alias("group"), (F.col("i") >= F.col("broken")).alias("again"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of every row, as the library encodes the whole text without special tokens.

    Null texts are empty and have no ids. Repeated rows and ids are rows of their own; other columns are ignored; an empty
    table gives an empty table. `path` names a rank file that every executor has.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in common.slices(batches, 32):
            yield pa.RecordBatch.from_arrays([b.column(0), lists([e.ids(t) for t in b.column(1).to_pylist()])], ["doc_id", "ids"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in common.slices(batches, 16):
            parts = zip(*(b.column(n).to_pylist() for n in ("i", "text", "from", "to")))
            out = [e.ids(text[lo - i * chunk : None if hi is None else hi - i * chunk]) for i, text, lo, hi in parts]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("group"), lists(out)], ["row", "doc_id", "group", "ids"])

    def rejoined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in common.slices(batches, 1):
            for row, doc_id, group, lo, texts in zip(*(b.column(n).to_pylist() for n in ("row", "doc_id", "group", "from", "texts"))):
                text = "".join(t[:chunk] for t in texts[:-1]) + texts[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row]), pa.array([doc_id], pa.int64()), pa.array([group], pa.int32()), lists([e.ids(text[lo - group * chunk :])])],
                    ["row", "doc_id", "group", "ids"],
                )

    short = rows.where(F.length("text") <= chunk).mapInArrow(whole, "doc_id long, ids array<int>")
    long = rows.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cut = common.stored(pretokenised(chunks(long, chunk, overlap), path, pattern, chunk), "bpe-chunks")
    joined = cut.join(stitches(cut, chunk, overlap), ["row", "i"])
    kind = "row long, doc_id long, group int, ids array<int>"
    ids = joined.where("again is null or not again").select("row", "doc_id", "group", "i", "text", "from", "to").mapInArrow(between, kind)
    runs = joined.where("again").groupBy("row", "doc_id", "group").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("p"), F.min_by("from", "i").alias("from"))
    again = runs.select("row", "doc_id", "group", "from", F.col("p.text").alias("texts")).mapInArrow(rejoined, kind)
    stitched = ids.unionByName(again).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("group", "ids"))).alias("p"))
    return short.unionByName(stitched.select("doc_id", F.flatten("p.ids").alias("ids")))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of `encode` with `decoded`, the concatenated bytes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        raw = np.empty(max(known.values(), default=0) + 1, object)
        for token, i in known.items():
            raw[i] = token
        for b in common.slices(batches, 32):
            column = b.column(1)
            tokens, cuts = raw[column.flatten().to_numpy(zero_copy_only=False)].tolist(), column.offsets.to_numpy()
            texts = [b"".join(tokens[x - cuts[0] : y - cuts[0]]) for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256, and `more` columns."""
    listed = F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)
