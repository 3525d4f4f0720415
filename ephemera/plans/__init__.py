"""Every query of the library over the driver tables, and the DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import geo_queries, log_queries, match_queries, metric_queries, report_queries, stream_queries, text_queries

_MODULES = (report_queries, log_queries, text_queries, geo_queries, match_queries, metric_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
