"""All named queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagloom.plans import evidence_queries, metric_queries, monitor_queries, record_queries
from tagloom.plans.metric_queries import pn_micro_macro  # noqa: F401  the flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**metric_queries.Q, **evidence_queries.Q, **monitor_queries.Q, **record_queries.Q}


def oracle_sql() -> dict[str, str]:
    return {**metric_queries.SQL, **evidence_queries.SQL, **monitor_queries.SQL, **record_queries.SQL}
