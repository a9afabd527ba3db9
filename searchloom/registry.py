"""All queries of the core, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("queries_sensor", "queries_search", "queries_aggs", "queries_data", "queries_more")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """A date range filter, then a terms aggregation with two metrics, from its request document."""
    return queries()["b_terms_sub"](spark, sf)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in MODULES:
        out |= import_module(f"searchloom.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"searchloom.{m}").SQL
    return out
