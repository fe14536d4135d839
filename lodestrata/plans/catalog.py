"""All queries of the retrieval and evidence engine, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics_queries, evidence_queries, retrieval_queries, stored_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _m in (retrieval_queries, evidence_queries, analytics_queries, text_queries, stored_queries):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
