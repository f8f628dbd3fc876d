"""Query registry: name -> (Spark plan, optional DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from opinio.sources.tables import load_table, spread


@dataclass(frozen=True)
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    family: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, family: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, family)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan a driver table, spread over the cores when the file yields fewer
    splits than there are cores (a no-op for large, many-split inputs)."""
    return spread(load_table(spark, sf_dir, name))


def sql_list(words) -> str:
    """A SQL IN-list literal."""
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
