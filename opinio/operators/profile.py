"""Profiling (A1-A4): one aggregate pass each, unpivoted to long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A1: ``(column_name, null_count)`` -- a single scan with partial aggregation."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "null_count")


def duplicate_count(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """A2: rows beyond the first per key; a null key is one group.

    Partial aggregation collapses a hot key map-side, so a key holding a
    third of all rows still costs one row per map task in the shuffle.
    """
    per_key = df.groupBy(*subset).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").cast("long").alias("n_rows"),
                       F.count(F.lit(1)).cast("long").alias("n_keys"),
                       F.sum(F.col("n") - 1).cast("long").alias("n_duplicates"))


def shape(df: DataFrame) -> DataFrame:
    """A3: ``(n_rows, n_cols)``."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("long"))


def column_info(df: DataFrame) -> DataFrame:
    """A4: ``(column_name, data_type, non_null)`` like ``DataFrame.info``."""
    cols = df.columns
    wide = df.agg(*[F.count(F.col(c)).cast("long").alias(c) for c in cols])
    long = wide.unpivot([], cols, "column_name", "non_null")
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return long.select("column_name", F.element_at(types, F.col("column_name")).alias("data_type"),
                       "non_null")


def is_empty(df: DataFrame) -> bool:
    """P12."""
    return df.isEmpty()
