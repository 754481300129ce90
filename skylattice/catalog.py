"""Registered queries over the driver's tables, and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import model_queries, retrieval_queries, sequence_queries, source_queries, text_queries

_MODULES = (retrieval_queries, sequence_queries, text_queries, source_queries, model_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: statement for m in _MODULES for name, statement in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_kis"](spark, sf_dir)
