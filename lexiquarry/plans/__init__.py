"""Queries of the engine's operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules():
    from . import answer_queries, generation_queries, keyword_queries, model_queries, phrase_queries, result_queries, text_queries

    return [answer_queries, generation_queries, keyword_queries, model_queries, phrase_queries, result_queries, text_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
