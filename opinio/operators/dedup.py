"""De-duplication, ordering, limits and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, subset: Sequence[str], order_col: str = "row_id") -> DataFrame:
    """``drop_duplicates(subset, keep='first')`` -- nulls form one group.

    ``min(struct(order_col, ...))`` is a partially aggregated hash aggregate:
    each map task keeps one row per key before the shuffle, so duplicate-heavy
    (hot) keys cost nothing extra.  ``dropDuplicates`` would keep an arbitrary
    row; a ``row_number`` window would shuffle and sort every duplicate.
    """
    subset = list(subset)
    rest = [c for c in df.columns if c not in subset and c != order_col]
    # A struct buffer with strings runs as a sort-based aggregate.  Leading the
    # key with a 64-bit hash makes the sort prefix a long, so long texts are
    # compared byte-wise only on a hash tie; the text itself stays in the key,
    # so grouping is exact.
    firsts = df.groupBy(F.xxhash64(*subset).alias("_h"), *subset).agg(
        F.min(F.struct(order_col, *rest)).alias("_first"))
    out = firsts.select(*subset, *[F.col(f"_first.{c}").alias(c) for c in [order_col, *rest]])
    return out.select(*df.columns)


def distinct_labels(df: DataFrame, label_col: str, order_col: str = "row_id") -> DataFrame:
    """``unique()``: every value incl. null, with its first-seen row."""
    return (df.groupBy(label_col).agg(F.min(order_col).alias("first_row"))
            .orderBy("first_row"))


def head_rows(df: DataFrame, n: int, order_col: str = "row_id") -> DataFrame:
    """D3: first ``n`` rows in row order (TakeOrderedAndProject: a per-task
    top-n, then a bounded merge)."""
    return df.orderBy(order_col).limit(n)


def top_k(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """Descending top-k with a deterministic tie-break."""
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(k)


def set_difference(left: DataFrame, right: DataFrame, col: str) -> DataFrame:
    """Distinct values of ``left.col`` absent from ``right.col``
    (EXCEPT DISTINCT; nulls compare equal).  Both sides are made distinct
    first, combined inside the tasks, so repeats are not shuffled."""
    return left.select(col).distinct().subtract(right.select(col).distinct())


def attach_by_row(df: DataFrame, other: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Index-aligned column assignment as an equi left join on the row
    key (rows of ``df`` without a partner get nulls).  Prefer computing a
    column with ``withColumn`` on the same frame; use this when the values
    come from a separate job (predictions, cluster ids)."""
    return df.join(other, on=row_id, how="left")
