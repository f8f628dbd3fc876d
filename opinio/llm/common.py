"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.session import checkpoint_root, release_shuffles, remove_path, work_dir  # noqa: F401 (also imported from here)

#: Words of the corpus contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def column(df: DataFrame, name: str) -> Column:
    """A column by its literal name, dots and other odd characters included."""
    return df["`" + name.replace("`", "``") + "`"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Inside a lambda Spark would evaluate an outer expression again for each
    element; binding it to a lambda variable of a one-element array does not.
    """
    return F.transform(F.array(value), body)[0]


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder the cluster names.

    A reliable checkpoint survives lost executors and is read instead of being
    computed again by each consumer.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Written tables in the shared folder, removed together when the work is done.

    For intermediates too large for ``settle``: Parquet keeps them small on disk.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, work_dir(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        remove_path(self.spark, self.path)

    def table(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.path}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: DataFrame) -> None:
        """Remove one table that is not read any more."""
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            remove_path(self.spark, path)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, row_bytes: Column, max_bytes: int = 16_000_000) -> DataFrame:
    """Broadcast-hint ``df`` only after measuring its size.

    ``df`` should be settled: it is read once for the measurement and once for
    the join.  Beyond ``max_bytes`` the frame is returned unhinted and the
    planner takes a shuffle join.
    """
    total = df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if total <= max_bytes else df
