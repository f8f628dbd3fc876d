"""Evaluation metrics (A11, A12) and a distributed dense row index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy(df: DataFrame, pred_col: str, label_col: str) -> DataFrame:
    """A null label counts as wrong (null-safe equality)."""
    return df.agg(F.avg(F.col(pred_col).eqNullSafe(F.col(label_col)).cast("double")).alias("accuracy"))


def dense_index(df: DataFrame, key: str, out: str = "row_index", partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``key`` order (any orderable, unique key).

    A global ``row_number()`` would pull every row into one task.  Instead the rows
    are range-partitioned by key (balanced by sampling, whether keys are dense or hashed) and
    numbered inside their partition; each partition's offset is the running sum
    over the row counts of those before it -- one row per partition.
    """
    from opinio.session import checkpoint_root
    checkpoint_root(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, key).sortWithinPartitions(key)
              .withColumn("_id", F.monotonically_increasing_id()))
    # Written once: range borders are sampled, so both uses must read one deal.
    dealt = ranged.withColumn("_part", F.shiftright("_id", 33)).checkpoint()
    within = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (dealt.join(F.broadcast(offsets), "_part")  # one row per partition
            .withColumn(out, (F.col("_off") + within).cast("long")).drop("_id", "_part", "_off"))


def epoch_metrics(probs: DataFrame, order_col: str, prob_col: str, label_col: str,
                  batch_size: int = 8) -> DataFrame:
    """Mean over batches of the per-batch mean cross-entropy (batches of
    ``batch_size`` consecutive rows; a short last batch weighs as much as a
    full one), next to the plain row mean and the row accuracy."""
    idx = dense_index(probs, order_col, "_i")
    p_true = F.element_at(prob_col, F.col(label_col).cast("int") + 1)
    rows = idx.select(
        F.floor(F.col("_i") / batch_size).alias("_batch"),
        (-F.log(p_true)).alias("_loss"),
        (F.array_position(prob_col, F.array_max(prob_col)) - 1 == F.col(label_col)).cast("double").alias("_hit"))
    per_batch = rows.groupBy("_batch").agg(F.avg("_loss").alias("_bl"), F.sum("_loss").alias("_sl"),
                                           F.count(F.lit(1)).alias("_n"), F.sum("_hit").alias("_h"))
    return per_batch.agg(
        F.avg("_bl").alias("batch_loss"), (F.sum("_sl") / F.sum("_n")).alias("row_loss"),
        (F.sum("_h") / F.sum("_n")).alias("accuracy"), F.count(F.lit(1)).alias("n_batches"))
