"""Toxicity classifier with counterfactual regularisation.

A logistic model over the hashed words and word beginnings that occur in a text. Besides the labels it is fitted on sentence
pairs: a sentence of a labelled text that mentions a group, and the same sentence with another group in that place. The
squared change of the score within a pair is a penalty, so that the mention itself cannot carry the verdict.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from wardline.llm import common
from wardline.llm.quality_trees import labelled_sample, labelled_texts

#: Labelled texts that a fit uses at most; those with the smallest hash of their id.
FIT_ROWS = 10_000
WIDTH = 1 << 20
EPOCHS, BATCH, RATE, RARE, STRONG, PENALTY = 8, 64, 0.5, 4, 4.0, 1.0
BEGINNINGS = (4, 5, 6)
REMEMBERED = 100_000
#: Neutral names of groups that are swapped for each other.
IDENTITY_TERMS = (
    "women", "men", "girls", "boys", "christians", "muslims", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "foreigners",
    "gays", "lesbians", "transgender", "heterosexual", "blacks", "whites", "asians", "africans", "europeans", "americans", "arabs", "latinos",
    "frauen", "männer", "christen", "muslime", "juden", "ausländer", "femmes", "hommes", "chrétiens", "musulmans", "juifs", "étrangers",
    "mujeres", "hombres", "cristianos", "musulmanes", "judíos", "extranjeros", "elderly", "disabled", "deaf", "blind", "teenagers",
)

WORDS = re.compile(r"[^\W\d_]+").findall
SENTENCES = re.compile(r"[.!?\n]+").split


class WordFeatures(dict):
    """Feature numbers of a word: itself and its beginnings."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        parts = [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n)]
        found = self[word] = tuple(xxh64_intdigest(p) % WIDTH for p in parts)
        return found


FEATURES = WordFeatures()


def features(words: set[str]) -> np.ndarray:
    """Sorted feature numbers of the words, each once."""
    return np.unique(np.fromiter((f for w in words for f in FEATURES[w]), np.int32))


def swapped(words: list[str], terms: tuple[str, ...]) -> list[str] | None:
    """The sentence with every group name replaced by another one of the list; None if it has none."""
    place = {t: k for k, t in enumerate(terms)}
    if not any(w in place for w in words):
        return None
    step = 1 + sum(map(len, words)) % (len(terms) - 1)
    return [terms[(place[w] + step) % len(terms)] if w in place else w for w in words]


def sentence_pairs(text: str, terms: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for s in SENTENCES(text.lower()):
        words = WORDS(s)
        if (other := swapped(words, terms)) is not None:
            out.append((features(set(words)), features(set(other))))
    return out


def telling(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Features whose share differs between the classes by at least STRONG standard errors, in at least RARE texts."""
    ones, zeros = (np.bincount(np.concatenate([np.empty(0, np.int64), *(r for r, v in zip(rows, y) if v == k)]), minlength=WIDTH) for k in (1, 0))
    p, n = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    both = (ones + zeros) / (p + n)
    apart = np.abs(ones / p - zeros / n) / np.sqrt(np.maximum(both * (1 - both) * (1 / p + 1 / n), 1e-12))
    return (apart >= STRONG) & (ones + zeros >= RARE)


def probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit_weights(rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """(weights, bias) of the telling features by AdaGrad over fixed batches; all other weights are 0."""
    weights, seen = np.zeros(WIDTH), np.full(WIDTH, 1.0)
    share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return weights, bias
    kept = telling(rows, y)
    rows = [r[kept[r]] for r in rows]
    pairs = [(a[kept[a]], b[kept[b]]) for a, b in pairs]
    sum_of = lambda part: np.array([weights[r].sum() for r in part])

    def learn(part: list[np.ndarray], slope: np.ndarray) -> None:
        at = np.concatenate(part)
        g = np.repeat(slope, [len(r) for r in part])
        np.add.at(seen, at, g * g)
        np.subtract.at(weights, at, RATE * g / np.sqrt(seen[at]))

    order = np.random.default_rng(0).permutation(len(rows))
    step = max(1, -(-len(rows) // BATCH))
    for _ in range(EPOCHS):
        for k in range(step):
            pick = order[k::step]
            part = [rows[i] for i in pick]
            off = probability(sum_of(part) + bias) - y[pick]
            learn(part, off)
            bias -= 0.1 * off.mean()
            if two := pairs[k::step]:
                p, q = (probability(sum_of(side) + bias) for side in zip(*two))
                learn([a for a, _ in two], 2 * penalty * (p - q) * p * (1 - p))
                learn([b for _, b in two], -2 * penalty * (p - q) * q * (1 - q))
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS, terms: tuple[str, ...] = IDENTITY_TERMS) -> tuple[np.ndarray, float]:
    """Weights and bias, fitted in one task on at most `rows` labelled texts; the driver sees only the weights."""
    wanted = labelled_sample(labels, label, learn, rows, id_col)
    texts = labelled_texts(docs, wanted, id_col, text_col).select("doc_id", "y", "text")

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 128):
            found, pairs = [], []
            for t in common.as_texts(b.column(2)):
                found.append(features(set(WORDS(t.lower()))).tobytes())
                pairs.append([x.tobytes() for p in sentence_pairs(t, terms) for x in p])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary()), pa.array(pairs, pa.list_(pa.binary()))], ["doc_id", "y", "x", "pairs"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(((i, x, y, p) for b in batches for i, y, x, p in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[:2])
        whole = lambda x: np.frombuffer(x, np.int32)
        sides = [(whole(p[k]), whole(p[k + 1])) for *_, p in got for k in range(0, len(p), 2)]
        w, bias = fit_weights([whole(x) for _, x, _, _ in got], np.array([y for _, _, y, _ in got]), sides)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([bias])], ["w", "bias"])

    shaped = texts.mapInArrow(shape, "doc_id long, y double, x binary, pairs array<binary>")
    row = shaped.repartition(1).mapInArrow(learned, "w binary, bias double").first()
    return (np.frombuffer(row.w, "<f4"), row.bias) if row else (np.zeros(WIDTH, np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], held_out: Column, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts have no features and get the bias alone; a null id is never held out; repeated rows stay; other
    columns are ignored; an empty table gives an empty table.
    """
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 128):
            z = np.array([weights[features(set(WORDS(t.lower())))].sum(dtype=np.float64) for t in common.as_texts(b.column(2))])
            s = 1 / (1 + np.exp(-np.clip(z + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
