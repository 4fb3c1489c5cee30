"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from Arrow batches of whole texts. The trees are fitted in numpy on a bounded number of labelled
documents; each level sums gradients per (node, feature, bin). A fitted forest is four flat arrays, complete trees laid out
level by level, and a batch of documents walks all trees together by array indexing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import common

#: Labelled documents that a fit uses at most; those with the smallest hash of their id.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, SMOOTH, LEAST = 80, 4, 64, 0.15, 5.0, 10

_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&|<>{}[]\\^~_=+@", ".", ",", "!", "?", "|", "\n", ":;", "'\"()-/"]
NAMES = [
    "words", "mean_word", "distinct_share", "top_word_share", "repeated_pairs", "repeated_fours", "lines", "words_per_line", "dup_lines", "short_lines",
    "longest_word", "non_ascii", *[f"share_{i}" for i in range(len(_CLASSES))],
]


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES)))
    for k, chars in enumerate(_CLASSES):
        table[list(chars.encode()), k] = 1
    return table


TABLE = _class_table()


def statistics(text: bytes) -> list[float]:
    """The numbers of one whole text, in the order of NAMES; all 0 for an empty one."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(NAMES)
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    pairs = len(set(zip(words, words[1:])))
    fours = len(set(zip(words, words[1:], words[2:], words[3:])))
    letters = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return [
        np.log1p(n), sum(map(len, words)) / n, len(counts) / n, counts.most_common(1)[0][1] / n, 1 - pairs / max(1, n - 1), 1 - fours / max(1, n - 3),
        np.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines),
        max(map(len, words)), letters[128:].sum() / size, *(letters @ TABLE / size),
    ]


# --- trees ---------------------------------------------------------------------------------


@dataclass
class Forest:
    """Complete trees: inner node k of a tree has children 2k+1 and 2k+2; a value above the threshold goes right."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), self.base)
        node = np.zeros((len(x), trees), np.int64)
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None]
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.value[tree, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]


def grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree from gradients and curvatures: (feature, threshold, value, leaf of each row)."""
    n, width = binned.shape
    inner = 2**depth - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(n, np.int64)
    flat = binned + np.arange(width) * bins
    for level in range(depth):
        nodes, first = 2**level, 2**level - 1
        key = ((node - first)[:, None] * (width * bins) + flat).ravel()
        sums = [np.bincount(key, np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(axis=2) for v in (g, h, np.ones(n))]
        total = [s[:, :, -1:] for s in sums]
        part = lambda a, b: a * a / (b + SMOOTH)
        gain = part(sums[0], sums[1]) + part(total[0] - sums[0], total[1] - sums[1]) - part(total[0], total[1])
        gain[(sums[2] < LEAST) | (total[2] - sums[2] < LEAST)] = 0
        best = gain.reshape(nodes, -1).argmax(axis=1)
        for k in range(nodes):
            f, cut = divmod(int(best[k]), bins)
            if gain[k, f, cut] > 1e-9 and cut < len(edges[f]):
                feature[first + k], threshold[first + k] = f, edges[f][cut]
        limit = np.array([np.searchsorted(edges[feature[first + k]], threshold[first + k]) if np.isfinite(threshold[first + k]) else bins for k in range(nodes)])
        at = node - first
        node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > limit[at])
    leaf = node - inner
    value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + SMOOTH)
    return feature, threshold, value, leaf


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Logistic loss. Without both classes, a forest without trees that gives the share of ones (0.5 without rows)."""
    share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if len(np.unique(y)) < 2:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = bin_edges(x, bins)
    binned = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
    margin, grown = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        f, t, v, leaf = grow(binned, edges, p - y, p * (1 - p), depth, bins)
        margin += v[leaf]
        grown.append((f, t, v))
    return Forest(*(np.stack(part) for part in zip(*grown)), base)


# --- Spark -----------------------------------------------------------------------------------


def labelled_sample(labels: DataFrame, label: str, learn: Column, rows: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y) of at most `rows` labelled documents, those with the smallest hash of their id; one row per id."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & learn).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_texts(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of the sample, one row per id: of repeated ids the text with the smallest hash, a null text last."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "doc_id")
    least = F.min(F.struct(F.col("text").isNull(), F.xxhash64("text"), F.col("text").alias("text")))
    return texts.groupBy("doc_id", "y").agg(least.alias("l")).select("doc_id", F.col("l.text").alias("text"), "y")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Forest:
    """Forest from at most `rows` labelled documents (so the sample may be broadcast and its statistics collected)."""
    wanted = labelled_sample(labels, label, learn, rows, id_col)
    texts = labelled_texts(docs, wanted, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            x = np.array([statistics(t) for t in common.as_bytes(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = texts.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y double, x array<double>").orderBy("doc_id", "x").collect()
    return fit_forest(np.array([r.x for r in got]).reshape(-1, len(NAMES)), np.array([r.y for r in got]))


def score(docs: DataFrame, forest: Forest, held_out: Column, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts have the statistics of an empty text and are scored like any other; a null id is never held out;
    repeated rows stay; other columns are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            x = np.array([statistics(t) for t in common.as_bytes(b.column(2))]).reshape(-1, len(NAMES))
            s = forest.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def filter_documents(docs: DataFrame, forest: Forest, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The documents that the forest accepts, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            x = np.array([statistics(t) for t in common.as_bytes(b.column(at))]).reshape(-1, len(NAMES))
            yield b.filter(pa.array(forest.score(x) >= cut))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
