"""Features of a text seen as spans of token buckets (see wardline.functions.vectors).

All spans of a text live in its own row, so nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import geometry as geo
from wardline.functions import text as tx
from wardline.functions import vectors as vx


def context_spans(buckets: Column, radius: int) -> Column:
    """ARRAY<ARRAY<INT>>: the span around every token."""
    return vx.let(buckets, lambda b: F.transform(b, lambda _, i: vx.window_at(b, i, radius)))


def self_overlaps(spans: Column) -> Column:
    return F.transform(spans, vx.self_overlap)


def neighbours(items: Column, gap: int = 1) -> tuple[Column, Column]:
    """Two arrays that pair every element with the one `gap` places on."""
    n = F.greatest(F.size(items) - gap, F.lit(0))
    return F.slice(items, 1, n), F.slice(items, 1 + gap, n)


def adjacent_cosines(spans: Column, norms: Column, gap: int = 1) -> Column:
    a, b = neighbours(spans, gap)
    na, nb = neighbours(norms, gap)
    shared = F.zip_with(a, b, vx.overlap)
    norm = F.zip_with(na, nb, lambda x, y: F.sqrt((x * y).cast("double")))
    return F.zip_with(shared, norm, lambda m, d: m.cast("double") / d)


def mean_of(values: Column) -> Column:
    return tx.ratio(vx.sum_of(values), F.size(values))


def inverse_root(m: Column) -> Column:
    """1 / sqrt(m), 0 for the empty span."""
    return F.when(m > 0, 1.0 / F.sqrt(m.cast("double"))).otherwise(0.0)


def sentence_spans(text: Column, embedder: vx.Embedder = vx.HASHED) -> Column:
    """Token vectors (or buckets) of every sentence; empty sentences give empty spans."""
    return F.transform(tx.sentences(text), lambda s: embedder.embed(tx.words(s)))


def sentence_units(text: Column, embedder: vx.Embedder = vx.HASHED) -> Column:
    """`sentence_spans`, or the lower-case words of every sentence where they are hashed later (`geometry.cells_of`)."""
    if not geo.is_hashed(embedder):
        return sentence_spans(text, embedder)
    return F.transform(tx.sentences(text), lambda s: geo.lowered(tx.words(s)))


def semantic_consistency(spans: Column) -> Column:
    """Mean dot product over all pairs of unit sentence vectors, from their sum:
    (|sum|^2 - non-empty) / (n (n - 1)); 1 below two sentences."""
    n = F.size(spans).cast("double")
    zero = F.transform(F.sequence(F.lit(0), F.lit(vx.DIMS - 1)), lambda d: F.lit(0.0))

    def add(acc, span):
        return F.zip_with(acc, unit(span), lambda a, b: a + b)

    total = F.aggregate(spans, zero, add)
    square = F.aggregate(total, F.lit(0.0), lambda acc, x: acc + x * x)
    filled = F.size(F.filter(spans, lambda s: F.size(s) > 0))
    return F.when(n < 2, 1.0).otherwise((square - filled) / (n * (n - 1.0)))


def unit(span: Column) -> Column:
    return vx.let(
        inverse_root(vx.self_overlap(span)), lambda w: F.transform(vx.counts(span), lambda c: c.cast("double") * w)
    )


def component_variance(sizes_over_norms: Column, filled: Column, n: Column) -> Column:
    """Population variance of all components of n unit vectors of `DIMS` entries:
    the squares sum to the number of non-empty ones, the components to sum(size / norm)."""
    cells = n.cast("double") * vx.DIMS
    mean = sizes_over_norms / cells
    return filled.cast("double") / cells - mean * mean


def phrase_anomaly(buckets: Column) -> Column:
    """10 x variance over the embeddings of all trigrams, clipped; 0 below three words."""

    def weights(b: Column) -> Column:
        def weight(i: Column) -> Column:
            x, y, z = F.get(b, i), F.get(b, i + 1), F.get(b, i + 2)
            equal = (x == y).cast("int") + (y == z).cast("int") + (x == z).cast("int")
            return 3.0 / F.sqrt((3 + 2 * equal).cast("double"))

        return F.transform(F.sequence(F.lit(0), F.size(b) - 3), weight)

    n = F.size(buckets) - 2
    total = vx.sum_of(vx.let(buckets, weights))
    return F.when(n >= 1, vx.clip(10.0 * component_variance(total, n, n))).otherwise(0.0)


def sentence_anomaly(spans: Column) -> Column:
    """10 x variance over the sentence embeddings, clipped; 0 below two sentences."""
    total = vx.sum_of(F.transform(spans, lambda s: F.size(s) * inverse_root(vx.self_overlap(s))))
    filled = F.size(F.filter(spans, lambda s: F.size(s) > 0))
    n = F.size(spans)
    return F.when(n >= 2, vx.clip(10.0 * component_variance(total, filled, n))).otherwise(0.0)


def cross_level_consistency(token: Column, phrase: Column, sentence: Column) -> Column:
    return vx.clip(1.0 - vx.std(F.array(token, phrase, sentence)))


def position_entropy(scores: Column) -> Column:
    """Entropy of the scores as a distribution over positions, over ln(n); 0 for one position."""

    def entropy(total: Column) -> Column:
        return -vx.sum_of(F.transform(scores, lambda s: (s / total) * F.ln(s / total + 1e-8)))

    n = F.size(scores)
    return F.when(n > 1, vx.let(vx.sum_of(scores) + 1e-8, entropy) / F.ln(n.cast("double"))).otherwise(0.0)


def embedding_steps(cosines: Column) -> Column:
    """Distances between neighbouring unit vectors from their cosines."""
    return F.transform(cosines, lambda c: F.sqrt(F.greatest(2.0 - 2.0 * c, F.lit(0.0))))
