"""ST3: running label counts over event time, and a helper that drives a
streaming query to completion into a table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_label_counts(stream: DataFrame, ts_col: str, label_col: str, window: str = "1 hour",
                          watermark: str = "10 minutes") -> DataFrame:
    """Counts per (event-time window, label).  The watermark bounds the state
    kept per key: a window is finalised (and emitted in append mode) once
    the watermark passes its end, and later rows for it are dropped."""
    ts = F.col(ts_col).cast("timestamp")  # TIMESTAMP_NTZ has no watermark support
    return (stream.withColumn(ts_col, ts).withWatermark(ts_col, watermark)
            .groupBy(F.window(ts_col, window), label_col).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    label_col, "n"))


def run_to_table(spark: SparkSession, stream: DataFrame, out_dir: str, mode: str = "append",
                 fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    """Run ``stream`` over everything available now into a file sink with a
    checkpoint (exactly-once, restartable after executor or driver loss),
    then return the sink contents as a batch DataFrame."""
    writer = (stream.writeStream.format(fmt).option("path", os.path.join(out_dir, "data"))
              .option("checkpointLocation", os.path.join(out_dir, "checkpoint"))
              .outputMode(mode).trigger(availableNow=True))
    for k, v in (options or {}).items():
        writer = writer.option(k, v)
    writer.start().awaitTermination()
    reader = spark.read
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    return reader.schema(stream.schema).format(fmt).load(os.path.join(out_dir, "data"))


def running_totals(stream: DataFrame, label_col: str) -> DataFrame:
    """Running count per label over the whole stream (complete output mode):
    every trigger re-emits the full, updated table.  State is one counter per
    distinct label."""
    return stream.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def run_complete_to_table(spark: SparkSession, stream: DataFrame, out_dir: str) -> DataFrame:
    """Drive a complete-mode aggregation over everything available now.

    File sinks only append, so ``foreachBatch`` writes each trigger's full result to a folder
    named by the batch id.  A snapshot is never changed once it is whole: a batch that is run
    again writes the same rows to its folder, and a snapshot goes only when two newer ones are
    there, so a reader of the last one is not disturbed.
    """
    data = os.path.join(out_dir, "data")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def folder(batch_id: int) -> str:
        return os.path.join(data, f"snapshot-{batch_id}")

    last = {}

    def write_snapshot(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(folder(batch_id))
        last["id"] = batch_id
        old = jvm.org.apache.hadoop.fs.Path(folder(batch_id - 2))
        old.getFileSystem(conf).delete(old, True)

    (stream.writeStream.outputMode("complete").foreachBatch(write_snapshot)
     .option("checkpointLocation", os.path.join(out_dir, "checkpoint"))
     .trigger(availableNow=True).start().awaitTermination())
    if last:
        return spark.read.schema(stream.schema).parquet(folder(last["id"]))
    where = jvm.org.apache.hadoop.fs.Path(data)
    fs = where.getFileSystem(conf)
    ids = [int(f.getPath().getName().rpartition("-")[2]) for f in fs.listStatus(where)] if fs.exists(where) else []
    return spark.read.schema(stream.schema).parquet(folder(max(ids))) if ids else spark.createDataFrame([], stream.schema)
