"""The registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import adaptive_rules, block_simhash, bpe, bwt_dedup, chat_pairs, gray_dedup, hyper_langid, mixing, page_templates, quality_trees, source_audit, spelling, toxicity
from wardline.llm.common import fold, table

RANKS = "byte_bpe_multi_50k.tiktoken"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query(chat_pairs.SQL)
def op1_preference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return chat_pairs.preference_pairs(chat_pairs.broken_off(table(spark, sf, "conversations")))


@query()
def op2_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return gray_dedup.near_groups(table(spark, sf, "documents"))


@query()
def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf, "documents"), path, public_tokenizers.PATTERN), path))


@query()
def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"), fold(F.col("doc_id"), 4) != 2)
    return toxicity.score(docs, model, fold(F.col("doc_id"), 4) == 2)


@query()
def op5_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return block_simhash.fingerprint_table(table(spark, sf, "documents"))


@query()
def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    forest = quality_trees.fit(docs, table(spark, sf, "labels"), fold(F.col("doc_id"), 3) != 1)
    return quality_trees.score(docs, forest, fold(F.col("doc_id"), 3) == 1)


@query(adaptive_rules.SQL)
def op7_adaptive_rules(spark: SparkSession, sf: str) -> DataFrame:
    return adaptive_rules.apply_rules(table(spark, sf, "documents"))


@query()
def op8_repeated_strings(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return bwt_dedup.digests(bwt_dedup.without_repeats(docs, words=bwt_dedup.PASSAGE_WORDS, short=bwt_dedup.PASSAGE))


@query()
def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    known = hyper_langid.prototypes(docs, fold(F.col("doc_id"), 4) != 2)
    return hyper_langid.identify(docs, known, fold(F.col("doc_id"), 4) == 2)


@query(mixing.SQL)
def op10_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), block=mixing.BLOCK)


@query(spelling.SQL)
def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents"))


@query(source_audit.SQL)
def op12_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return source_audit.audit(table(spark, sf, "documents"))


@query()
def op13_html_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return page_templates.main_text(table(spark, sf, "pages"))
