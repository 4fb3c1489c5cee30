"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

1. Every window of `length` bytes selects its smallest 64-byte gram (the anchor). Equal windows select equal anchors at the
   same place, so only windows whose anchor occurs again can be repeated. A piece is the bytes of all neighbouring windows
   that selected one anchor. Copies of a piece collapse to a class; in a class of two or more every window is repeated.
2. Pieces that share an anchor but not all bytes (the ends of passages, edited copies) are told apart by suffix order. Pieces
   are dealt by anchor into shards. Symbols are the names of the 100-byte blocks at every byte, a suffix goes on
   100 bytes later, so the first `length` bytes are `length / 100` symbols. Each shard gets its transform; two transforms are
   merged by refining their interleave: each round sorts the merged order stably by preceding symbols, which lengthens the
   sorted prefixes by one symbol, without sorting suffixes again. The round that first parts two neighbours gives their
   common prefix; runs never parted are the repeated intervals.
3. The pieces of an anchor with too many different ones for one task are cut into stripes of few windows, at the same places
   before the anchor for all. A stripe is named by the bytes that all windows of that stripe share, whether a piece has them
   all or not, and goes through 1 and 2 again; stripes of one window are decided by their class alone. Nothing is capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from wardline.llm import common

LENGTH = 400
#: For passages: the strings looked for, and the words that a passage has more than.
PASSAGE, PASSAGE_WORDS = 200, 50
BLOCK = 100
GRAM = 64
#: Bytes worked on at once, bytes of the pieces merged together and of a shard of them, and different pieces of one key that
#: may meet.
SLAB = 1 << 19
BUCKET = 1 << 20
SHARD = 1 << 19
MANY = 2000
#: Windows per piece when an anchor has too many pieces.
NARROWER = (16, 1)
PLACE = np.uint64((1 << 24) - 1)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at every place, by doubling; GRAM is a power of two."""
    h, width, base = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while width < GRAM:
        h = h[:-width] * np.uint64(base) + h[width:]
        base = base * base % (1 << 64)
        width *= 2
    return mixed(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(-1, width)
    right = np.minimum.accumulate(grid, axis=1).ravel()
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - width + 1], right[width - 1 : n])


def pieces_of(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(key, class, from, windows, bytes before the anchor, copies) of the pieces of several texts laid end to end; no window
    crosses an end. Equal pieces one after the other (periodic text) are one row with their number."""
    if len(data) < length:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(4)))
    h = gram_hashes(np.frombuffer(data, np.uint8))
    anchor = (sliding_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1) & PLACE).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(ends, start, side="right").clip(max=len(ends) - 1)
    start = start[start + length <= ends[text]]
    fresh = np.r_[True, (anchor[start][1:] != anchor[start][:-1]) | (text[start][1:] != text[start][:-1])] if len(start) else np.empty(0, bool)
    cuts = np.flatnonzero(fresh)
    begin, windows = start[cuts], np.diff(np.r_[cuts, len(start)])
    same = np.fromiter((xxh64_intdigest(data[b : b + n + length - 1], n) for b, n in zip(begin.tolist(), windows.tolist())), np.uint64, len(begin))
    key, of = h[anchor[begin]], text[begin]
    again = (key[1:] == key[:-1]) & (same[1:] == same[:-1]) & (of[1:] == of[:-1])
    runs = np.flatnonzero(np.r_[np.ones(min(1, len(key)), bool), ~again])
    copies = np.diff(np.r_[runs, len(key)])
    return key[runs], same[runs], begin[runs], windows[runs], (anchor[begin] - begin)[runs], copies


def anchored(rows: DataFrame, length: int) -> DataFrame:
    """(key, same, row, from, n, lead, copies): the pieces of every text; `from` counts bytes from the start of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 256):
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), common.as_bytes(b.column(1))
            for who, base, part in slabs(texts, length):
                size = np.array([len(p) for p in part])
                ends = np.cumsum(size)
                key, same, begin, n, lead, copies = pieces_of(b"".join(part), ends, length)
                text = np.searchsorted(ends, begin, side="right")
                at = begin - (ends - size)[text] + np.array(base, np.int64)[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(same.view(np.int64)), pa.array(ids[np.array(who, np.int64)[text]]), pa.array(at), pa.array(n), pa.array(lead), pa.array(copies)],
                    ["key", "same", "row", "from", "n", "lead", "copies"],
                )

    return rows.mapInArrow(run, "key long, same long, row long, from long, n long, lead long, copies long")


def slabs(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(text numbers, offsets, parts) of about SLAB bytes; a longer text is cut where windows of both parts overlap."""
    who, base, part, size = [], [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), SLAB):
            if size and size + min(len(t) - at, SLAB) > SLAB:
                yield who, base, part
                who, base, part, size = [], [], [], 0
            cut = t[at : at + SLAB + length - 1]
            who.append(k), base.append(at), part.append(cut)
            size += len(cut)
    if part:
        yield who, base, part


# --- transforms ------------------------------------------------------------------------------


def stable_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, numbers in order) of small whole numbers, ties as they stand: number and place sorted as one number, which is
    the faster sort."""
    bits = np.uint64(len(symbols).bit_length())
    both = (symbols.astype(np.uint64) << bits) | np.arange(len(symbols), dtype=np.uint64)
    both.sort()
    return (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int32), (both >> bits).astype(np.uint32)


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 0 of 64-bit numbers, equal ones alike, by a sort of their upper bits and places as one number."""
    bits = np.uint64(len(x).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    both = (x & ~low) | np.arange(len(x), dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int32)
    both >>= bits
    sorted_ = x[order]
    parted = sorted_[1:] != sorted_[:-1]
    if (parted & (both[1:] == both[:-1])).any():  # different numbers with the same upper bits
        return np.unique(x, return_inverse=True)[1].astype(np.uint32)
    out = np.empty(len(x), np.uint32)
    out[order] = np.cumsum(np.r_[np.zeros(min(1, len(x)), bool), parted], dtype=np.uint32)
    return out


class Suffixes:
    """The suffixes of pieces laid end to end: at each place the symbol before it and the place it steps back to.

    A suffix is the sequence of block names at place, place + BLOCK, ...; each piece ends BLOCK such sequences, with symbol
    0. Places are numbered over the whole bucket, so shards and merges share them.
    """

    def __init__(self, pieces: list[bytes], length: int):
        size = np.array([len(p) for p in pieces])
        self.length, self.size = length, size
        self.start = np.cumsum(size + 1) - (size + 1)
        self.total = int((size + 1).sum())
        h = gram_hashes(np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8))
        name = mixed(h[: self.total - BLOCK] * np.uint64(0x9E3779B97F4A7C15) + h[BLOCK - GRAM : self.total - GRAM])
        name = ranks(name) + np.uint32(1)
        place = np.arange(self.total, dtype=np.int32)
        self.piece = np.repeat(np.arange(len(pieces), dtype=np.int32), size + 1)
        self.inside = place - self.start.astype(np.int32)[self.piece]
        self.back = place - BLOCK
        first = self.inside < BLOCK
        self.before = np.zeros(self.total, np.uint32)
        self.before[BLOCK:] = name
        self.before[first] = 0
        whole = size[self.piece[first]]
        # A sequence's first suffix steps back to its own end: the last place of the same phase.
        self.back[first] = self.start[self.piece[first]] + self.inside[first] + (whole - self.inside[first]) // BLOCK * BLOCK

    def transform(self, lo: int, hi: int) -> np.ndarray:
        """Places [lo, hi) in the order of their first length / BLOCK symbols."""
        order = np.arange(lo, hi, dtype=np.int32)
        for _ in range(self.length // BLOCK):
            order = self.back[order[stable_order(self.before[order])[0]]]
        return order

    def merge(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(merged order, common prefix with the one before, in symbols, at most length / BLOCK) of two transforms."""
        take = np.r_[np.zeros(len(a), bool), np.ones(len(b), bool)]
        symbols, of_a, of_b = np.empty(len(take), np.uint32), self.before[a], self.before[b]
        group = np.zeros(len(take), np.int32)
        rounds = self.length // BLOCK
        prefix = np.full(len(take), rounds, np.int8)
        prefix[:1] = 0
        for round_ in range(rounds):
            symbols[~take], symbols[take] = of_a, of_b
            order, next_ = stable_order(symbols)
            group = group[order]
            parted = np.r_[False, (next_[1:] != next_[:-1]) | (group[1:] != group[:-1])]
            prefix[parted & (prefix == rounds)] = round_
            take, group = take[order], np.cumsum(parted, dtype=np.int32)
        merged = np.empty(len(take), np.int32)
        merged[~take], merged[take] = a, b
        return merged, prefix

    def repeated(self, shard: int = SHARD) -> np.ndarray:
        """Places whose `length` bytes occur at another place too."""
        # Shards of about one size: a small last one would be merged at the cost of all others.
        cuts, each = [0], -(-self.total // max(1, self.total // shard))
        for end in (self.start + self.size + 1).tolist():
            if end >= len(cuts) * each or end == self.total:
                cuts.append(end)
        parts = [self.transform(lo, hi) for lo, hi in zip(cuts, cuts[1:])]
        if len(parts) == 1:
            parts.append(np.empty(0, np.int32))
        prefix = np.zeros(0, np.int8)
        while len(parts) > 1:
            halves = [self.merge(*parts[k : k + 2]) if k + 1 < len(parts) else (parts[k], prefix) for k in range(0, len(parts), 2)]
            parts, prefix = [m for m, _ in halves], halves[0][1]
        order, alike = parts[0], prefix >= self.length // BLOCK
        alike |= np.r_[alike[1:], False]
        found = order[alike]
        return found[self.inside[found] + self.length <= self.size[self.piece[found]]]


def spans_of(rows: np.ndarray, begin: np.ndarray, pieces: list[bytes], length: int) -> pa.RecordBatch | None:
    """Byte spans (row, from, to) of the repeated windows of some pieces; None if there are none."""
    s = Suffixes(pieces, length)
    place = s.repeated()
    if not len(place):
        return None
    row, at = rows[s.piece[place]], begin[s.piece[place]] + s.inside[place]
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    cuts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] > at[:-1] + 1)])
    last = np.r_[cuts[1:], len(row)] - 1
    return pa.RecordBatch.from_arrays([pa.array(row[cuts]), pa.array(at[cuts]), pa.array(at[last] + length)], ["row", "from", "to"])


def merged_repeats(pieces: DataFrame, length: int) -> DataFrame:
    """(row, from, to) byte spans of the repeated windows of pieces (key, row, from, piece).

    Pieces of one key come one after the other; whenever BUCKET bytes are together and a key ends, their transforms are
    built and merged. Memory follows BUCKET and the pieces of one key, not the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None
        for b in common.slices(batches):
            for key, row, begin, piece in zip(*(c.to_pylist() for c in b.columns)):
                if size >= BUCKET and key != last:
                    if (found := merge(held)) is not None:
                        yield found
                    held, size = [], 0
                held.append((row, begin, piece))
                size, last = size + len(piece), key
        if held and (found := merge(held)) is not None:
            yield found

    def merge(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch | None:
        rows, begin, parts = zip(*held)
        return spans_of(np.array(rows, np.int64), np.array(begin, np.int64), list(parts), length)

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.select("key", "row", "from", "piece").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "row long, from long, to long")


# --- classes -----------------------------------------------------------------------------------


def settle(found: DataFrame, length: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Spans of the classes that occur again, and the pieces left to tell apart (one for each class of a shared key).

    Keys are summed map-side; a key's rows never meet in one task.
    """
    # Checkpointed sides are plain shuffles, whose hot keys Spark splits in the joins.
    keys = common.checkpointed(found.groupBy("key").agg(F.sum("copies").alias("all"), F.min("same").alias("low"), F.max("same").alias("high")).where("all > 1"))
    again = common.stored(found.join(keys, "key").select("key", "same", "row", "from", "n", "lead", "copies", *[c for c in found.columns if c == "piece"], (F.col("low") != F.col("high")).alias("differ")), name)
    classes = common.checkpointed(again.where("differ").groupBy("key", "same").agg(F.sum("copies").alias("times"), F.min(F.struct("row", "from")).alias("one")))
    told = again.where("differ").join(classes, ["key", "same"])
    span = lambda d: d.select("row", "from", (F.col("from") + F.col("n") * F.col("copies") + (length - 1)).alias("to"))
    spans = span(again.where("not differ")).unionByName(span(told.where("times > 1")))
    return spans, told.where((F.col("one.row") == F.col("row")) & (F.col("one.from") == F.col("from"))).drop("one", "times", "copies", "differ", "same")


def cut_out(left: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """The pieces with their bytes, taken from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 64):
            out: dict[str, list] = {n: [] for n in schema.names}
            for row, text, parts in zip(b.column("row").to_pylist(), common.as_bytes(b.column("text")), b.column("p").to_pylist()):
                for p in parts:
                    for n, v in zip(out, (p["key"], row, p["from"], p["n"], p["lead"], text[p["from"] : p["from"] + p["n"] + length - 1])):
                        out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([*((c, pa.int64()) for c in ("key", "row", "from", "n", "lead")), ("piece", pa.binary())])
    wanted = left.groupBy("row").agg(F.collect_list(F.struct("key", "from", "n", "lead")).alias("p"))
    return rows.join(wanted, "row").select("row", "text", "p").mapInArrow(run, "key long, row long, from long, n long, lead long, piece binary")


def stripes(n: int, lead: int, windows: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window, number, begin and end of the bytes that all windows of the stripe share, from the piece's start)."""
    at = 0
    while at < n:
        stripe = (at - lead) // windows * windows + lead  # window at which the whole stripe begins, maybe before the piece
        end = min(n, stripe + windows)
        yield at, end - at, stripe + windows - 1, stripe
        at = end


def narrower(pieces: DataFrame, windows: int, length: int) -> DataFrame:
    """Pieces cut into stripes of `windows` windows, counted from the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 256):
            out: dict[str, list] = {n: [] for n in schema.names}
            for row, begin, n, lead, piece in zip(*(b.column(c).to_pylist() for c in ("row", "from", "n", "lead", "piece"))):
                for at, m, lo, first in stripes(n, lead, windows):
                    part = piece[at : at + m + length - 1]
                    key, same = xxh64_intdigest(piece[lo : first + length], windows), xxh64_intdigest(part, at - first)
                    for c, v in zip(schema.names, (key - (1 << 63), same - (1 << 63), row, begin + at, m, lead - at, 1, part)):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([*((c, pa.int64()) for c in ("key", "same", "row", "from", "n", "lead", "copies")), ("piece", pa.binary())])
    return pieces.mapInArrow(run, "key long, same long, row long, from long, n long, lead long, copies long, piece binary")


def repeated_spans(rows: DataFrame, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """(row, from, to): byte spans that cover exactly the bytes of repeated `length`-byte strings; spans may overlap.

    `rows` has (row long, text), is read more than once and must number its rows alike each time.
    """
    if length % BLOCK or length <= 2 * GRAM:
        raise ValueError(f"the length must be a multiple of {BLOCK} over {2 * GRAM}")
    found, spans = common.stored(anchored(rows, length), "bwt-anchors"), []
    for level in (None, *NARROWER):
        settled, left = settle(found, length, "bwt-pieces")
        spans.append(settled)
        if level == NARROWER[-1]:
            break
        pieces = common.stored(cut_out(left, rows, length) if level is None else left, "bwt-left")
        crowded = common.checkpointed(pieces.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > many).select("key"))
        spans.append(merged_repeats(pieces.join(crowded, "key", "left_anti"), length))
        if crowded.isEmpty():
            break
        found = narrower(pieces.join(crowded, "key", "left_semi"), NARROWER[0] if level is None else NARROWER[NARROWER.index(level) + 1], length)
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def whole_words(text: bytes, runs: list[list[int]], words: int) -> list[list[int]]:
    """The runs cut back to the whole words in them, without those of `words` words or fewer."""
    out = []
    for a, z in runs:
        inner = [m.span() for m in WORD.finditer(text, a, z)]
        if inner and inner[0][0] == a and a and WORD.match(text, a - 1):
            inner = inner[1:]
        if inner and inner[-1][1] == z < len(text) and WORD.match(text, z):
            inner = inner[:-1]
        if len(inner) > words:
            out.append([inner[0][0], inner[-1][1]])
    return out


def runs_of(spans: list[dict] | None) -> list[list[int]]:
    """Maximal runs [from, to) of spans that come in order."""
    out: list[list[int]] = []
    for s in spans or []:
        if out and s["from"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["to"])
        else:
            out.append([s["from"], s["to"]])
    return out


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows with their spans in order; null for a row without any."""
    fields = [c for c in spans.columns if c != "row"]
    return rows.join(spans.distinct().groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("spans")), "row", "left")


def nested_spans(rows: DataFrame, length: int, short: int, words: int) -> DataFrame:
    """(passage, row, from, to): the spans of repeated strings of `length` bytes, and as passages the runs of more than `words`
    whole words in repeated strings of `short` bytes.

    All occurrences of a repeated string lie in runs of the shorter repeated ones, each in one, so `length` bytes are looked
    for in those runs only, each being a text of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 128):
            out: dict[str, list] = {n: [] for n in schema.names}
            for row, text, spans in zip(b.column("row").to_pylist(), common.as_bytes(b.column("text")), b.column("spans").to_pylist()):
                whole = runs_of(spans)
                found = [(False, row, a, z, text[a:z]) for a, z in whole if z - a >= length]
                for r in found + [(True, row, a, z, None) for a, z in whole_words(text, whole, words)]:
                    for n, v in zip(out, r):
                        out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("passage", pa.bool_()), ("row", pa.int64()), ("from", pa.int64()), ("to", pa.int64()), ("text", pa.binary())])
    found = with_spans(rows, repeated_spans(rows, short)).where("spans is not null").select("row", "text", "spans")
    found = found.mapInArrow(run, "passage boolean, row long, from long, to long, text binary")
    found = common.stored(found.withColumn("run", F.monotonically_increasing_id()), "bwt-runs")
    runs = found.where("not passage")
    inside = repeated_spans(runs.select(F.col("run").alias("row"), "text"), length).withColumnRenamed("row", "run")
    start = runs.select("run", "passage", "row", F.col("from").alias("at"))
    spans = inside.join(start, "run").select("passage", "row", (F.col("at") + F.col("from")).alias("from"), (F.col("at") + F.col("to")).alias("to"))
    return spans.unionByName(found.where("passage").select("passage", "row", "from", "to"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: list[str] | None = None, words: int | None = None, short: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (removed byte runs [from, to), maximal and in order), kept (the other bytes), and `keep`.

    With `words`, runs end at whole words and those of so many words or fewer stay. With `short` too, `words` leaves the
    removed runs as they are, and `passages` follows: the runs of more than `words` whole words in repeated strings of
    `short` bytes, which stay in `kept` where no repeated string of `length` bytes covers them.

    Null texts are empty; texts shorter than `length` lose nothing; repeated rows are texts of their own, so they remove each
    other's strings; other columns than those in `keep` are ignored; an empty table gives an empty table. Ties do not
    arise: all occurrences of a repeated string go.
    """
    extra = [c for c in keep or [] if c not in (id_col, text_col)]
    more = [] if short is None else ["passages"]
    return _split(docs, id_col, text_col, length, extra, words, short).select("doc_id", "n_bytes", "spans", "kept", *more, *[F.col("extra")[c].alias(c) for c in extra])


def _split(docs: DataFrame, id_col: str, text_col: str, length: int, extra: list[str], words: int | None = None, short: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, passages, extra), extra being a struct of the columns named."""
    if short is not None and (words is None or short > length):
        raise ValueError("passages need a number of words and strings no longer than the others")
    row = F.monotonically_increasing_id().alias("row")
    rows = docs.select(row, F.col(text_col).alias("text"))
    spans = repeated_spans(rows, length).withColumn("passage", F.lit(False)) if short is None else nested_spans(rows, length, short, words)
    own = docs.select(row, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *extra).alias("extra"))
    joined = with_spans(own, spans.select("row", "from", "to", "passage")).select("doc_id", "text", "spans", "extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 128):
            size, runs, kept, passages = [], [], [], []
            for t, found in zip(common.as_bytes(b.column("text")), b.column("spans").to_pylist()):
                whole = runs_of([s for s in found or [] if not s["passage"]])
                whole = whole if words is None or short is not None else whole_words(t, whole, words)
                size.append(len(t))
                runs.append([{"from": a, "to": z} for a, z in whole])
                passages.append([{"from": s["from"], "to": s["to"]} for s in found or [] if s["passage"]])
                cuts = [0, *(x for r in whole for x in r), len(t)]
                kept.append(b"".join(t[a:z] for a, z in zip(cuts[::2], cuts[1::2])) if whole else t)
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()), pa.array(passages, kind), b.column("extra")],
                ["doc_id", "n_bytes", "spans", "kept", "passages", "extra"],
            )

    fields = joined.schema
    runs = "array<struct<from:bigint,to:bigint>>"
    kind = f"doc_id {fields['doc_id'].dataType.simpleString()}, n_bytes long, spans {runs}, kept binary, passages {runs}, extra {fields['extra'].dataType.simpleString()}"
    return joined.mapInArrow(run, kind)


def digests(cleaned: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and text, the kept bytes with U+FFFD for broken characters.

    Where passages were looked for, n_passages and passage_bytes, their bytes, follow.
    """
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    count = [F.size("passages").cast("long").alias("n_passages"), F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["to"] - p["from"]).alias("passage_bytes")]
    more = count if "passages" in cleaned.columns else []
    return cleaned.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), text, *more)


def cleaned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", length: int = LENGTH, words: int | None = None) -> DataFrame:
    """The documents without repeated strings (see `without_repeats`), with all their columns.

    Bytes of a character that was cut in two go with it; `length_col` is counted anew; null texts become empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            texts = [t.decode("utf-8", "ignore") for t in b.column("kept").to_pylist()]
            new = {text_col: pa.array(texts, pa.string()), length_col: pa.array([len(t) for t in texts], pa.int64()), id_col: b.column("doc_id")}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column("extra").field(c) for c in names], names)

    names = docs.columns
    others = [c for c in names if c not in (id_col, text_col, length_col)]
    return _split(docs, id_col, text_col, length, others, words).mapInArrow(run, docs.schema)
