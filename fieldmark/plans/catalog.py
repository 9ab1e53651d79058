"""Named queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import contract_queries, event_queries, record_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, deduplicate and classify records: the pipeline end to end."""
    return queries()["classify_delivery"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**record_queries.QUERIES, **event_queries.QUERIES, **contract_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**record_queries.SQL, **event_queries.SQL, **contract_queries.SQL}
