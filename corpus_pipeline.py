"""A training corpus from `documents`: quality, near copies, repeated passages, source mix, token ids.

Each stage is written as Parquet in the shared folder and read again, so a lost executor costs work of one stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, bwt_dedup, gray_dedup, gray_wide, mixing, quality_trees
from wardline.llm.common import fold, stored, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels outside the held-out fold."""
    forest = quality_trees.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return quality_trees.filter_documents(docs, forest)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: those of op2's operator, and five-word shingles at a similarity of about 0.8 or more."""
    return gray_wide.one_per_group(docs, also=gray_dedup.near_groups)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of over 50 words that occur twice."""
    return bwt_dedup.cleaned_documents(docs, length=bwt_dedup.PASSAGE, words=bwt_dedup.PASSAGE_WORDS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mixed_documents(docs, block=mixing.BLOCK)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of ids and decoded bytes for every document of the mix."""
    path = public_tokenizers.path(RANKS)
    decoded = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return bpe.digests(decoded, "ids")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_strings),
    ("source mixing", source_mix),
    ("byte-level BPE", token_ids),
]

#: Trees, fingerprints and token ids cannot be said in SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
