"""Parquet table access and partition-level helpers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; column pruning and filter pushdown reach the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when the rows lie in fewer partitions than the cluster has
    cores, or mostly in a few of them.

    The number of partitions does not tell: files are split by bytes, but a Parquet row group is
    read by one task, so of the splits of a file with a few large row groups most are empty.  The
    rows of each partition are counted (of a Parquet table from its footers, without any column).
    Where the largest holds no more than twice its share the input is left as it is.
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    if have >= want:
        rows = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
        most, every = rows.agg(F.max("n"), F.sum("n")).first()
        if not every or most * want <= 2 * every:
            return df
    return df.repartition(max(want, have))


def bounded_broadcast(df: DataFrame, max_bytes: int = 64_000_000) -> DataFrame:
    """Broadcast-hint ``df`` only after measuring that its values take at most
    ``max_bytes``.

    The measurement is one aggregate, so a derived frame should be written
    (``checkpoint``) first.  Beyond the bound the frame is returned as is and the
    planner (with AQE runtime statistics) picks a shuffle join instead.
    """
    return F.broadcast(df) if value_bytes(df) <= max_bytes else df


def value_bytes(df: DataFrame) -> int:
    """Approximate size of a frame's values: text length, 16 bytes for others."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) + 16 if t == "string" else F.lit(16)
                 for c, t in df.dtypes), F.lit(0))
    return int(df.agg(F.sum(width)).first()[0] or 0)
