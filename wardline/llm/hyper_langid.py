"""Language identification with hyperdimensional profiles.

Every letter has a random vector of plus and minus ones, drawn from a generator seeded with its code point. An n-gram binds
its letters by multiplying their vectors, each permuted (rolled) by its place; a document bundles its n-grams by adding
them. A language's prototype bundles the documents of that language, and a document belongs to the prototype with the
largest cosine. Bundling is a sum, so it needs only counts of n-grams: counts times n-gram vectors, one matrix product for a
slice of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import common

DIM = 1024
GRAM = 3
UNKNOWN = "und"
#: Characters worked on at once, and n-gram vectors a worker remembers.
SLAB = 200_000
REMEMBERED = 20_000


def _folded() -> np.ndarray:
    """Lower-case code point of every letter, a blank for everything else."""
    table = np.full(0x110000, 32, np.int32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    return _folded()


def gram_codes(text: str) -> np.ndarray:
    """Codes of the letter n-grams of a text, 21 bits a letter; blanks in a row count as one, and one is at either end."""
    points = folded()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]]
    if len(points) < GRAM or not (points != 32).any():
        return np.empty(0, np.int64)
    code = points[: len(points) - GRAM + 1].copy()
    for k in range(1, GRAM):
        code = (code << 21) | points[k : len(points) - GRAM + 1 + k]
    return code


@lru_cache(maxsize=4096)
def letter(point: int, dim: int) -> np.ndarray:
    return (np.random.default_rng(point).integers(0, 2, dim, np.int8) * 2 - 1).astype(np.int8)


@lru_cache(maxsize=REMEMBERED)
def gram_vector(code: int, dim: int) -> np.ndarray:
    out = np.ones(dim, np.int8)
    for place in range(GRAM):
        out = out * np.roll(letter((code >> 21 * (GRAM - 1 - place)) & 0x1FFFFF, dim), place)
    return out


def bundles(texts: list[str], dim: int) -> np.ndarray:
    """One bundled vector per text; zero for a text without letters."""
    out = np.zeros((len(texts), dim), np.float32)
    codes = [gram_codes(t) for t in texts]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(codes[end]) <= SLAB):
            size += len(codes[end])
            end += 1
        known, place = np.unique(np.concatenate(codes[at:end]), return_inverse=True)
        doc = np.repeat(np.arange(end - at), [len(c) for c in codes[at:end]])
        for lo in range(0, len(known), 4096):
            width = min(4096, len(known) - lo)
            mine = (place >= lo) & (place < lo + width) if len(known) > 4096 else slice(None)
            counts = np.bincount(doc[mine] * width + place[mine] - lo, minlength=(end - at) * width).reshape(end - at, width)
            out[at:end] += counts.astype(np.float32) @ np.stack([gram_vector(c, dim) for c in known[lo : lo + width].tolist()]).astype(np.float32)
        at = end
    return out


def prototypes(docs: DataFrame, learn: Column, lang_col: str = "lang", text_col: str = "text", dim: int = DIM) -> dict[str, np.ndarray]:
    """Unit vector per language, bundled from all learning documents; each partition sends one sum per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in common.slices(batches, 128):
            langs = b.column(0).to_pylist()
            for lang, v in zip(langs, bundles(common.as_texts(b.column(1)), dim)):
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], ["lang", "at", "v"])

    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    total = rows.mapInArrow(run, "lang string, at int, v double").groupBy("lang", "at").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("v"))
    found = {r.lang: np.array([x.v for x in r.v]) for r in total.collect()}
    return {lang: (v / np.linalg.norm(v)).astype(np.float32) for lang, v in sorted(found.items()) if np.any(v)}


def identify(docs: DataFrame, protos: dict[str, np.ndarray], held_out: Column, id_col: str = "doc_id", text_col: str = "text", dim: int = DIM) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; the score is the best cosine, negative ones as 0.

    `und` with score 0 for texts that are null or have no letter, and for all if nothing was learned. Equal cosines go to
    the first language by code point. A null id is not held out; repeated rows stay; other columns are ignored; an empty
    table gives an empty table.
    """
    names = list(protos)
    matrix = np.stack([protos[n] for n in names]) if names else np.zeros((1, dim), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 128):
            v = bundles(common.as_texts(b.column(2)), dim)
            size = np.linalg.norm(v, axis=1)
            cos = (v @ matrix.T) / np.maximum(size, 1e-9)[:, None]
            best = cos.argmax(axis=1)
            lang = [names[k] if names and s > 0 else UNKNOWN for k, s in zip(best, size)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(np.clip(cos.max(axis=1), 0, 1).astype(np.float64))], ["doc_id", "held_out", "lang_pred", "score"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
