"""Arrow-batched numpy helpers for what needs a vector per token.

A text crosses into Python as its token vectors (or bucket numbers); long texts are worked on in slices of tokens, and a few
numbers per token or per text come back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.vectors import DIMS, Embedder, buckets

#: Tokens worked on at once: of one text, and of several short ones.
STEP, PACK = 8192, 2048


@dataclass(frozen=True)
class TokenSpace:
    """How token vectors of an embedder look in Python: bucket numbers, or dense rows."""

    dims: int = DIMS
    dense: bool = False

    def rows(self, cell: np.ndarray, lo: int, hi: int) -> np.ndarray:
        part = cell[lo:hi]
        if self.dense:
            return np.asarray(part, np.float64).reshape(-1, self.dims)
        out = np.zeros((len(part), self.dims))
        out[np.arange(len(part)), part] = 1
        return out

    def cell(self, value) -> np.ndarray:
        """An array column's value as numpy: one number or one row per token."""
        if self.dense:
            return np.array([np.asarray(v, np.float64) for v in value]).reshape(-1, self.dims)
        return np.asarray(value, np.int64)

    def around(self, cell: np.ndarray, lo: int, hi: int, left: int, right: int) -> np.ndarray:
        """Sums of the token vectors i - left .. i + right, cut at the ends, for i in lo .. hi - 1."""
        n = len(cell)
        a, b = max(0, lo - left), min(n, hi + right)
        running = np.zeros((b - a + 1, self.dims))
        np.cumsum(self.rows(cell, a, b), axis=0, out=running[1:])
        at = np.arange(lo, hi)
        return running[np.minimum(at + right + 1, n) - a] - running[np.maximum(at - left, 0) - a]

    def around_each(self, flat: np.ndarray, sizes: np.ndarray, left: int, right: int) -> np.ndarray:
        """`around` for the tokens of several texts end to end; windows end with their text. For bucket numbers, whose sums are exact."""
        at, ends = np.arange(len(flat)), np.cumsum(sizes)
        start, end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        if left + right < self.dims // 4:
            out = np.zeros(len(flat) * self.dims)
            row = at * self.dims
            for k in range(-left, right + 1):
                inside = at[(at + k >= start) & (at + k < end)] if k else at
                out[row[inside] + flat[inside + k]] += 1
            return out.reshape(-1, self.dims)
        running = np.zeros((len(flat) + 1, self.dims))
        running[at + 1, flat] = 1
        np.cumsum(running, axis=0, out=running)
        return running[np.minimum(at + right + 1, end)] - running[np.maximum(at - left, start)]

    def pack(self, units: Column | str) -> Column:
        """The token vectors of a text as bytes."""
        kind = np.float32 if self.dense else np.int32

        @F.pandas_udf("binary")
        def run(batch: pd.Series) -> pd.Series:
            return batch.map(lambda v: self.cell(v).astype(kind).tobytes())

        return run(units)

    def unpack(self, radius: int):
        """Bytes of `pack` to the sums of the window around every token."""
        kind = np.float32 if self.dense else np.int32

        def run(payload: bytes) -> np.ndarray:
            cell = np.frombuffer(payload, kind)
            cell = cell.reshape(-1, self.dims).astype(np.float64) if self.dense else cell.astype(np.int64)
            return self.around(cell, 0, len(cell), radius, radius)

        return run


def space_of(embedder: Embedder) -> TokenSpace:
    return TokenSpace(embedder.dims, embedder.dense)


def word_buckets(words: pa.Array, dims: int = DIMS) -> pa.Array:
    """`vectors.buckets` of lists of lower-case words; a word that occurs again in the batch is hashed once."""
    named = words.flatten().dictionary_encode()
    kinds = [None if w is None else hashlib.md5(w.encode()).digest()[3] % dims for w in named.dictionary.to_numpy(zero_copy_only=False)]
    ends = np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    units = pa.array(kinds, pa.int32()).take(named.indices)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), units, mask=words.is_null() if words.null_count else None)


def lowered(words: Column) -> Column:
    return F.transform(words, lambda w: F.lower(w))


def embedded(embedder: Embedder, tokens: Column) -> Column:
    """`embedder.embed` of a column of tokens (not in a lambda); hashed buckets come from a batch of texts at once."""
    if not is_hashed(embedder):
        return embedder.embed(tokens)

    @F.arrow_udf("array<int>")
    def run(words: pa.Array) -> pa.Array:
        return word_buckets(words, embedder.dims)

    return run(lowered(tokens))


def is_hashed(embedder: Embedder) -> bool:
    """Whether tokens may be handed over as lower-case words, to be hashed in Python."""
    return embedder.embed is buckets


def cells_of(space: TokenSpace, column: pa.Array) -> list[np.ndarray]:
    """The token vectors of every text of an Arrow column; bucket numbers are not copied, lower-case words become them."""
    if space.dense:
        return [space.cell(v) for v in column.to_pylist()]
    if not pa.types.is_integer(column.type.value_type):
        column = word_buckets(column, space.dims)
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return [flat[a:z] for a, z in zip([0, *ends], ends)]


def lists(cells: list[np.ndarray]) -> pa.Array:
    """One list of numbers per text as an Arrow column."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cells)]), pa.int32()), pa.array(np.concatenate([np.zeros(0), *cells])))


def bucket_rows(space: TokenSpace, cells: list[np.ndarray]) -> np.ndarray:
    """Bucket counts of whole texts, a row each."""
    flat, sizes, _ = ends_of(cells)
    at = np.repeat(np.arange(len(cells)), sizes) * space.dims + flat
    return np.bincount(at, minlength=len(cells) * space.dims).reshape(-1, space.dims).astype(np.float64)


def text_packs(space: TokenSpace, cells: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Neighbouring texts of at most PACK tokens together, to be worked on at once; a longer or a dense text is alone."""
    held, n = [], 0
    for cell in cells:
        if held and (space.dense or n + len(cell) > PACK):
            yield held
            held, n = [], 0
        held.append(cell)
        n += len(cell)
    if held:
        yield held


def ends_of(cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of texts end to end, the size of each text and its first place."""
    sizes = np.array([len(c) for c in cells], np.int64)
    return np.concatenate(cells), sizes, np.cumsum(sizes) - sizes


def unit_rows(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return rows / norm if (norm > 0).all() else np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def neighbour_cosines(rows: np.ndarray, gap: int) -> np.ndarray:
    """Cosine of every row with the one `gap` places on."""
    if len(rows) <= gap:
        return np.zeros(0)
    own = (rows * rows).sum(axis=1)
    shared = (rows[:-gap] * rows[gap:]).sum(axis=1)
    norm = np.sqrt(own[:-gap] * own[gap:])
    return np.divide(shared, norm, out=np.zeros_like(shared), where=norm > 0)


def shift_cosines(space: TokenSpace, cell: np.ndarray, radius: int, window: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of neighbouring token windows, and of runs of `window` tokens `stride` apart (none below two runs)."""
    n = len(cell)
    near = [neighbour_cosines(space.around(cell, lo, min(n, lo + STEP + 1), radius, radius), 1) for lo in range(0, n, STEP)]
    runs = n - window + 1
    far = []
    if n >= max(2 * window, window + stride):
        far = [neighbour_cosines(space.around(cell, lo, min(runs, lo + STEP + stride), 0, window - 1), stride) for lo in range(0, runs, STEP)]
    return np.concatenate([*near, np.zeros(0)]), np.concatenate([*far, np.zeros(0)])


def neighbour_cosines_each(rows: np.ndarray, gap: int) -> np.ndarray:
    """`neighbour_cosines` of exact sums, with what crosses two texts still among them."""
    if len(rows) <= gap:
        return np.zeros(0)
    own = np.einsum("ij,ij->i", rows, rows)
    shared = np.einsum("ij,ij->i", rows[:-gap], rows[gap:])
    norm = np.sqrt(own[:-gap] * own[gap:])
    return np.divide(shared, norm, out=np.zeros_like(shared), where=norm > 0)


def shift_cosines_each(space: TokenSpace, cells: list[np.ndarray], radius: int, window: int, stride: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """`shift_cosines` of several texts."""
    if len(cells) == 1:
        return [shift_cosines(space, cells[0], radius, window, stride)]
    flat, sizes, starts = ends_of(cells)
    near = neighbour_cosines_each(space.around_each(flat, sizes, radius, radius), 1)
    far = neighbour_cosines_each(space.around_each(flat, sizes, 0, window - 1), stride)
    least = max(2 * window, window + stride)
    runs = np.where(sizes >= least, sizes - window + 1 - stride, 0)
    return [(near[a : a + max(n - 1, 0)], far[a : a + r]) for a, n, r in zip(starts.tolist(), sizes.tolist(), runs.tolist())]


def token_numbers_udf(space: TokenSpace, shift_radius: int, window: int, stride: int):
    """Token vectors -> cosines of neighbouring windows and of token runs."""

    @F.arrow_udf("struct<adjacent:array<double>,runs:array<double>>")
    def run(batch: pa.Array) -> pa.Array:
        packs = text_packs(space, cells_of(space, batch))
        rows = [r for cells in packs for r in shift_cosines_each(space, cells, shift_radius, window, stride)]
        return pa.StructArray.from_arrays([lists([r[0] for r in rows]), lists([r[1] for r in rows])], ["adjacent", "runs"])

    return run


def average_cosines(windows: np.ndarray, total: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and mean square of the cosines of each row with all references, from the references' sums: for a unit vector u,
    u . sum(r) and u' sum(r r') u, both over the number of references."""
    u = unit_rows(windows)
    return u @ total, np.einsum("ij,ij->i", u @ second, u)


def clip(x: float) -> float:
    return float(min(max(x, 0.0), 1.0))


def window_moments(space: TokenSpace, cell: np.ndarray, radius: int) -> tuple[float, float, float]:
    """Component variance, perturbation signature and outlier score of a text's window embeddings."""
    n = len(cell)
    return moments_of(n, lambda: (unit_rows(space.around(cell, lo, min(n, lo + STEP), radius, radius)) for lo in range(0, n, STEP)))


def moments_of(n: int, parts: Callable[[], Iterable[np.ndarray]]) -> tuple[float, float, float]:
    """The same from the unit vectors of the n windows, in parts that can be made again."""
    if n == 0:
        return 0.0, 0.0, 0.0
    if n <= STEP:  # nearly all texts: their windows are made once
        whole = next(iter(parts()))
        mean = whole.sum(axis=0) / n
        away = whole - mean
        away *= away
        by_dim, far = away.sum(axis=0) / n, [np.sqrt(away.sum(axis=1))]
    else:
        mean = sum(p.sum(axis=0) for p in parts()) / n
        by_dim = sum(((p - mean) ** 2).sum(axis=0) for p in parts()) / n
        far = (np.linalg.norm(p - mean, axis=1) for p in parts())
    variance = float(by_dim.mean() + mean.var())
    if n < 3:
        return variance, 0.0, 0.0
    signature = clip(1.0 - by_dim.std() / (by_dim.mean() + 1e-8))
    dist = np.concatenate(list(far))
    spread = dist.std()
    outlier = 0.0 if spread < 1e-6 else clip(np.abs(dist - dist.mean()).max() / spread / 3.0)
    return variance, signature, outlier


def phrase_anomaly(space: TokenSpace, cell: np.ndarray) -> float:
    """10 x variance over the embeddings of all trigrams; the same as spans.phrase_anomaly."""
    n = len(cell) - 2
    return phrase_of(n * space.dims, [unit_rows(space.around(cell, lo, min(n, lo + STEP), 0, 2)) for lo in range(0, n, STEP)])


def phrase_of(size: int, parts: list[np.ndarray]) -> float:
    """The same from the unit vectors of the trigrams and the number of their components."""
    if size <= 0:
        return 0.0
    mean = sum(p.sum() for p in parts) / size
    return clip(10.0 * (sum((p * p).sum() for p in parts) / size - mean * mean))


def window_numbers_each(space: TokenSpace, cells: list[np.ndarray], radius: int) -> np.ndarray:
    """`window_moments`, `text_gradient` and `phrase_anomaly` of several texts, a row each."""
    if len(cells) == 1:
        return np.array([(*window_moments(space, cells[0], radius), text_gradient(space, cells[0]), phrase_anomaly(space, cells[0]))])
    out = np.zeros((len(cells), 5))
    filled = np.array([len(c) > 0 for c in cells])
    if filled.any():
        out[filled] = np.stack(filled_numbers_each(space, [c for c in cells if len(c)], radius), axis=1)
    return out


def filled_numbers_each(space: TokenSpace, cells: list[np.ndarray], radius: int) -> list[np.ndarray]:
    """The same, a column each, of texts with tokens: sums and extremes of a text are those of its rows among all rows."""
    flat, sizes, starts = ends_of(cells)
    windows, n = unit_rows(space.around_each(flat, sizes, radius, radius)), sizes[:, None]
    mean = np.add.reduceat(windows, starts, axis=0) / n
    away = np.subtract(windows, np.repeat(mean, sizes, axis=0), out=windows)
    away *= away
    by_dim, dist = np.add.reduceat(away, starts, axis=0) / n, np.sqrt(away.sum(axis=1))
    variance = by_dim.mean(axis=1) + mean.var(axis=1)
    signature = np.clip(1.0 - by_dim.std(axis=1) / (by_dim.mean(axis=1) + 1e-8), 0.0, 1.0)
    off = dist - np.repeat(np.add.reduceat(dist, starts) / sizes, sizes)
    spread = np.sqrt(np.add.reduceat(off * off, starts) / sizes)
    far = np.divide(np.maximum.reduceat(np.abs(off), starts), spread, out=np.zeros(len(cells)), where=spread >= 1e-6)
    few = sizes < 3
    v = unit_rows(bucket_rows(space, cells))
    inner = (v[:, 2:] - v[:, :-2]) / 2.0
    gradient = np.sqrt((inner * inner).sum(axis=1) + (v[:, 1] - v[:, 0]) ** 2 + (v[:, -1] - v[:, -2]) ** 2)
    return [variance, np.where(few, 0.0, signature), np.where(few, 0.0, np.clip(far / 3.0, 0.0, 1.0)), gradient, phrases_each(space, flat, sizes, starts)]


def phrases_each(space: TokenSpace, flat: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """`phrase_anomaly` of texts with tokens: a trigram's unit vector adds up to 3 / sqrt(3 + 2 x its equal pairs), its squares to 1."""
    sums = np.zeros(len(flat))
    x, y, z = flat[:-2], flat[1:-1], flat[2:]
    equal = (x == y).astype(np.int64) + (y == z) + (x == z)
    sums[: max(len(flat) - 2, 0)] = 3.0 / np.sqrt(3.0 + 2.0 * equal)
    for k in (1, 2):  # what crosses two texts
        ends = starts + sizes - k
        sums[ends[ends >= 0]] = 0.0
    runs = np.maximum(sizes - 2, 0)
    components = np.maximum(runs * space.dims, 1)
    mean = np.add.reduceat(sums, starts) / components
    return np.where(runs > 0, np.clip(10.0 * (runs / components - mean * mean), 0.0, 1.0), 0.0)


def sentence_moments(space: TokenSpace, cell: np.ndarray, sizes: np.ndarray) -> tuple[float, float]:
    """Mean pairwise cosine of the sentences and 10 x variance of their embeddings."""
    n = len(sizes)
    if n < 2:
        return 1.0, 0.0
    ends = np.cumsum(sizes)
    total, squares, components = np.zeros(space.dims), 0.0, 0.0
    for lo in range(0, n, STEP):
        hi = min(n, lo + STEP)
        a, b = int(ends[lo] - sizes[lo]), int(ends[hi - 1])
        if space.dense:
            sums = np.zeros((hi - lo, space.dims))
            np.add.at(sums, np.repeat(np.arange(hi - lo), sizes[lo:hi]), cell[a:b])
        else:
            at = np.repeat(np.arange(hi - lo), sizes[lo:hi]) * space.dims + cell[a:b]
            sums = np.bincount(at, minlength=(hi - lo) * space.dims).reshape(hi - lo, space.dims).astype(np.float64)
        u = unit_rows(sums)
        total += u.sum(axis=0)
        squares += (u * u).sum()
        components += u.sum()
    consistency = float((total @ total - (sizes > 0).sum()) / (n * (n - 1.0)))
    mean = components / (n * space.dims)
    return consistency, clip(10.0 * (squares / (n * space.dims) - mean * mean))


def sentence_moments_each(space: TokenSpace, cells: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
    """`sentence_moments` of several texts, a row each."""
    n = np.array([len(k) for k in sizes], np.int64)
    if len(cells) == 1 or n.sum() > STEP:
        return np.array([sentence_moments(space, c, k) for c, k in zip(cells, sizes)]).reshape(-1, 2)
    out, several = np.tile([1.0, 0.0], (len(cells), 1)), n >= 2
    if not several.any():
        return out
    flat, each = np.concatenate([c for c, s in zip(cells, several) if s]), np.concatenate([k for k, s in zip(sizes, several) if s])
    n = n[several]
    starts = np.cumsum(n) - n
    at = np.repeat(np.arange(len(each)), each) * space.dims + flat
    u = unit_rows(np.bincount(at, minlength=len(each) * space.dims).reshape(-1, space.dims).astype(np.float64))
    total = np.add.reduceat(u, starts, axis=0)
    filled = np.add.reduceat((each > 0).astype(np.int64), starts)
    squares, components = np.add.reduceat((u * u).sum(axis=1), starts), np.add.reduceat(u.sum(axis=1), starts)
    mean = components / (n * space.dims)
    out[several, 0] = ((total * total).sum(axis=1) - filled) / (n * (n - 1.0))
    out[several, 1] = np.clip(10.0 * (squares / (n * space.dims) - mean * mean), 0.0, 1.0)
    return out


def text_gradient(space: TokenSpace, cell: np.ndarray) -> float:
    """Norm of the gradient over the components of the whole text's embedding."""
    if len(cell) == 0:
        return 0.0
    if space.dense:
        v = sum(space.rows(cell, lo, min(len(cell), lo + STEP)).sum(axis=0) for lo in range(0, len(cell), STEP))
    else:
        v = np.bincount(cell, minlength=space.dims).astype(np.float64)
    v = unit_rows(v[None])[0]
    inner = (v[2:] - v[:-2]) / 2.0
    return float(np.sqrt(inner @ inner + (v[1] - v[0]) ** 2 + (v[-1] - v[-2]) ** 2))


STATISTICS = ["variance", "signature", "outlier", "gradient", "phrase", "consistency", "sentence"]


def text_statistics_udf(space: TokenSpace, radius: int):
    """(token vectors, those of the sentences end to end, sentence sizes) -> the vector features of a text, in one pass. The
    sentences may come as lower-case words where the vectors are bucket numbers."""

    @F.arrow_udf(f"struct<{','.join(f'{n}:double' for n in STATISTICS)}>")
    def run(tokens: pa.Array, sentences: pa.Array, sizes: pa.Array) -> pa.Array:
        spans, counts = cells_of(space, sentences), cells_of(TokenSpace(), sizes)
        rows, done = [np.zeros((0, len(STATISTICS)))], 0
        for cells in text_packs(space, cells_of(space, tokens)):
            part = slice(done, done + len(cells))
            rows.append(np.hstack([window_numbers_each(space, cells, radius), sentence_moments_each(space, spans[part], counts[part])]))
            done += len(cells)
        return pa.StructArray.from_arrays([pa.array(c) for c in np.concatenate(rows).T.copy()], STATISTICS)

    return run


def sentence_statistics_udf(space: TokenSpace):
    """(token vectors of the sentences end to end, sentence sizes) -> consistency and anomaly of the sentences."""

    @F.arrow_udf("struct<consistency:double,sentence:double>")
    def run(sentences: pa.Array, sizes: pa.Array) -> pa.Array:
        counts, rows, done = cells_of(TokenSpace(), sizes), [np.zeros((0, 2))], 0
        for cells in text_packs(space, cells_of(space, sentences)):
            rows.append(sentence_moments_each(space, cells, counts[done : done + len(cells)]))
            done += len(cells)
        return pa.StructArray.from_arrays([pa.array(c) for c in np.concatenate(rows).T.copy()], ["consistency", "sentence"])

    return run
