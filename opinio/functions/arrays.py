"""Exploding computed arrays without evaluating them twice.

For an inner ``explode(expr)`` Catalyst infers ``size(expr) > 0`` and pushes
that filter below the projection, so a costly ``expr`` (a regex tokeniser)
runs twice per row.  ``explode_outer`` gets no inferred filter; dropping its
null row afterwards gives the same rows as ``explode`` for arrays without
null elements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, arr, name: str, *cols) -> DataFrame:
    """``(*cols, name)`` with one row per array element."""
    return df.select(*cols, F.explode_outer(arr).alias(name)).filter(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, arr, pos: str, name: str, *cols) -> DataFrame:
    """``(*cols, pos, name)`` with one row per array element."""
    return df.select(*cols, F.posexplode_outer(arr).alias(pos, name)).filter(F.col(pos).isNotNull())
