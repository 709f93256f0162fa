"""The core's query catalogue: name -> callable(spark, folder), and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import curation, execution


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Kept documents by domain, after the whole funnel."""
    return curation.domain_pools(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return curation.QUERIES | execution.QUERIES


def oracle_sql() -> dict[str, str]:
    return curation.ORACLES | execution.ORACLES
