"""Vectors as array columns, and the default hashed embedding.

The default embedding of a token is one of `DIMS` buckets; a span of tokens is
the multiset of its buckets. For two spans, `overlap` counts the pairs of equal
buckets, so cosine(A, B) = overlap(A, B) / sqrt(overlap(A, A) * overlap(B, B))
and everything before the square root is an integer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row.

    A lambda body evaluates the outer expressions it mentions anew for every
    element; bind what is not a plain column first.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bucket(token: Column, dims: int = DIMS) -> Column:
    """md5-derived bucket of a token: the low bits of the first 32 hash bits (dims is a power of two up to 256)."""
    return (F.conv(F.substring(F.md5(F.lower(token)), 7, 2), 16, 10).cast("int") % dims).cast("int")


def buckets(tokens: Column, dims: int = DIMS) -> Column:
    return F.transform(tokens, lambda t: bucket(t, dims))


@dataclass(frozen=True)
class Embedder:
    """Vectors of tokens. `embed` turns an array of tokens into an array with one vector per token (array<float>), or,
    if not `dense`, one bucket number per token, which stands for a unit vector. Any model that runs as a Column fits."""

    name: str
    dims: int
    embed: Callable[[Column], Column]
    dense: bool = True

    def sum_of_tokens(self, units: Column) -> Column:
        """Dense sum of the token vectors that `embed` gave."""
        if not self.dense:
            return counts(units, self.dims)
        zero = F.transform(F.sequence(F.lit(1), F.lit(self.dims)), lambda _: F.lit(0.0))
        return F.aggregate(units, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))

    def embed_text(self, tokens: Column) -> Column:
        """Unit vector of a whole text."""
        return normalize(self.sum_of_tokens(self.embed(tokens)))


HASHED = Embedder(f"hashed-{DIMS}", DIMS, buckets, dense=False)


def count_of(items: Column, x: Column) -> Column:
    return F.size(items) - F.size(F.array_remove(items, x))


def overlap(a: Column, b: Column) -> Column:
    """Pairs (i, j) with a[i] = b[j]; pass columns or lambda variables, or bind with `let`."""
    return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + count_of(b, x).cast("long"))


def span_cosine(a: Column, b: Column) -> Column:
    """Cosine of two bucket multisets, 0 when either is empty."""
    norm = F.sqrt((self_overlap(a) * self_overlap(b)).cast("double"))
    return F.coalesce(F.try_divide(overlap(a, b).cast("double"), norm), F.lit(0.0))


def window_at(items: Column, i: Column, radius: int) -> Column:
    """Elements i-radius .. i+radius (0-based i), cut at the ends."""
    start = F.greatest(i - radius, F.lit(0))
    end = F.least(i + radius, F.size(items) - 1)
    return F.slice(items, start + 1, end - start + 1)


def self_overlap(span: Column) -> Column:
    """overlap(span, span): the sum of the squared bucket counts, from one walk over the sorted span."""
    start = F.struct(F.lit(-1).alias("x"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["x"] == x, a["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("x"), run.alias("run"), (a["n"] + 2 * run - 1).alias("n"))

    return F.aggregate(F.array_sort(span), start, step, lambda a: a["n"])


def counts(span: Column, dims: int = DIMS) -> Column:
    """Dense bucket counts of a span."""
    return let(span, lambda s: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: count_of(s, d)))


def sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def as_doubles(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return sum_of(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b)), F.lit(0.0))


def normalize(a: Column) -> Column:
    def scale(v: Column) -> Column:
        return let(l2_norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))

    return let(a, scale)


def embed(text_tokens: Column) -> Column:
    """Unit-length dense embedding of a token list."""
    return normalize(counts(buckets(text_tokens)))


def variance(a: Column) -> Column:
    """Population variance of the components; null for an empty vector."""

    def around(v: Column, mean: Column) -> Column:
        squares = F.transform(v, lambda x: (x.cast("double") - mean) * (x.cast("double") - mean))
        return F.try_divide(sum_of(squares), F.size(v).cast("double"))

    return let(a, lambda v: let(F.try_divide(sum_of(as_doubles(v)), F.size(v).cast("double")), lambda mean: around(v, mean)))


def std(a: Column) -> Column:
    return F.sqrt(variance(a))


def gradient(a: Column) -> Column:
    """Central differences inside, one-sided differences at the ends."""

    def differences(v: Column) -> Column:
        last = F.size(v) - 1

        def at(i: Column) -> Column:
            lo, hi = F.greatest(i - 1, F.lit(0)), F.least(i + 1, last)
            return (F.get(v, hi).cast("double") - F.get(v, lo).cast("double")) / (hi - lo).cast("double")

        return F.transform(F.sequence(F.lit(0), last), at)

    return let(a, differences)


def gradient_magnitude(a: Column) -> Column:
    return F.when(F.size(a) >= 2, let(gradient(a), l2_norm)).otherwise(0.0)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
