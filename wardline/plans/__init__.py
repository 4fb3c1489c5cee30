"""Registered queries: each is a Spark job over the given tables, with a DuckDB statement where SQL can say it."""

from __future__ import annotations

import importlib

SECTIONS = [
    "text_queries",
    "redaction_queries",
    "vector_queries",
    "detector_queries",
    "fusion_queries",
    "generator_queries",
    "dataset_queries",
    "event_queries",
    "similarity_queries",
    "source_queries",
    "state_queries",
    "model_queries",
]


def registry():
    """(queries, oracle statements) of all sections, by query name."""
    queries, oracle = {}, {}
    for section in SECTIONS:
        module = importlib.import_module(f"wardline.plans.{section}")
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE)
    return queries, oracle
