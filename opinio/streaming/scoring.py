"""ST1 / ST2: score comments arriving as JSON requests or CSV drops."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.operators.lexicon import score_comments
from opinio.resources import Lexicon
from opinio.sources.quoted import lines_of, parse, records

INVALID_TEXT = "the request has no usable text"


def parse_requests(lines: DataFrame, value_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """ST1 parse: each line is a JSON object ``{"text": ...}`` (plus optional
    ``id``).  Valid means ``text`` is present, a JSON string, and not empty;
    anything else (bad JSON, missing key, number, null, "") is an error row.
    The type is checked on the VARIANT, so ``5`` is not accepted as "5"."""
    v = lines.select(F.try_parse_json(value_col).alias("_v"), *keep)
    t = v.select(*keep, F.try_variant_get("_v", "$.id", "bigint").alias("id"),
                 F.try_variant_get("_v", "$.text", "variant").alias("_t"))
    ok = (F.schema_of_variant("_t") == "STRING") & (F.try_variant_get("_t", "$", "string") != "")
    return t.select("id", F.when(ok, F.try_variant_get("_t", "$", "string")).alias("text"),
                    F.coalesce(ok, F.lit(False)).alias("valid"), *keep)


def score_requests(requests: DataFrame, lex: Lexicon) -> DataFrame:
    """ST1 score: ``(id, prediction, error)``; exactly one of the two is set."""
    scored = score_comments(requests, lex, "text", "_score", "_label")
    return scored.select("id", F.when(F.col("valid"), F.col("_label")).alias("prediction"),
                         F.when(~F.col("valid"), F.lit(INVALID_TEXT)).alias("error"))


def score_requests_with_model(requests: DataFrame, model, prepare) -> DataFrame:
    """ST1 with a trained ``PipelineModel``: ``(id, prediction, probability, error)``.

    ``prepare`` adds the model's input columns to a frame with ``text`` (the same
    function as in training).  Each micro-batch is one projection.
    """
    from pyspark.ml.functions import vector_to_array

    from opinio.operators.models import predict_labels
    scored = predict_labels(model, prepare(requests), "_label")
    return scored.select("id", F.when(F.col("valid"), F.col("_label")).alias("prediction"),
                         F.when(F.col("valid"), F.array_max(vector_to_array("probability"))).alias("probability"),
                         F.when(~F.col("valid"), F.lit(INVALID_TEXT)).alias("error"))


def score_csv_with_model(stream: DataFrame, model, prepare, text_col: str = "comment",
                         out: str = "predicted_label") -> DataFrame:
    """ST2 with a trained ``PipelineModel``: the input columns plus the label."""
    if text_col not in stream.columns:
        raise ValueError(f"stream must have a '{text_col}' column")
    from opinio.operators.models import predict_labels
    cols = stream.columns
    return predict_labels(model, prepare(stream.withColumn("text", F.col(text_col))), out).select(*cols, out)


def score_csv_stream(stream: DataFrame, lex: Lexicon, text_col: str = "comment",
                     out: str = "predicted_label") -> DataFrame:
    """ST2: require the comment column, append the predicted label."""
    if text_col not in stream.columns:
        raise ValueError(f"stream must have a '{text_col}' column")
    return score_comments(stream, lex, text_col, "_score", out).drop("_score")


def run_csv_drops(spark: SparkSession, path: str, schema: str, score: Callable[[DataFrame], DataFrame],
                  out_dir: str, fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    """ST2 over all drops available now: quoted CSV files whose fields may span lines, each
    split over many tasks, through ``score`` into ``out_dir``; returns what was written.

    A micro-batch is a set of whole files, so its records can be cut as in a batch job.  Each
    batch has a folder of its own, named by its id: a batch that is run again after a failure
    replaces what it had written.
    """
    options, data, written = options or {}, os.path.join(out_dir, "data"), {}

    def write(lines: DataFrame, batch_id: int) -> None:
        scored = score(parse(records(lines), schema).drop("file", "block", "n"))
        written["schema"] = scored.schema
        scored.write.format(fmt).options(**options).mode("overwrite").save(os.path.join(data, f"batch_id={batch_id}"))

    lines = lines_of(spark.readStream.format("text").option("lineSep", "\n").load(path))
    (lines.writeStream.foreachBatch(write).option("checkpointLocation", os.path.join(out_dir, "checkpoint"))
     .trigger(availableNow=True).start().awaitTermination())
    reader = spark.read.format(fmt).options(**options)
    if written:  # else what earlier runs wrote
        reader = reader.schema(written["schema"])
    return reader.load(data).drop("batch_id")


def answer_once(requests: DataFrame, arrived_col: str = "arrived", within: str = "1 hour") -> DataFrame:
    """ST1: of requests with the same id that arrive within ``within`` only the first goes on.

    The state is one key per id, dropped once the watermark has passed it by ``within``.  A
    request without an id counts by its text, or as one of the unreadable ones.
    """
    key = F.coalesce(F.concat(F.lit("id:"), F.col("id").cast("string")), F.concat(F.lit("text:"), F.sha2("text", 256)), F.lit("unreadable"))
    return (requests.withColumn("_key", key).withWatermark(arrived_col, within)
            .dropDuplicatesWithinWatermark(["_key"]).drop("_key"))


def run_requests(spark: SparkSession, path: str, score: Callable[[DataFrame], DataFrame], out_dir: str,
                 within: str = "1 hour", files_per_batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """ST1 over all request files available now: ``(answers, quarantined)``.

    A resent id is answered once (:func:`answer_once`).  ``score`` gets ``(id, text, valid)`` and
    returns ``(id, prediction, ..., error)``; rows with an error go to a table of their own.  Both
    tables have a folder per batch id, so a batch that is run again replaces its own rows.
    """
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(path).select("value", F.col("_metadata.file_modification_time").alias("arrived"))
    once = answer_once(parse_requests(lines, keep=("arrived",)), "arrived", within)
    places = {kind: os.path.join(out_dir, kind) for kind in ("answers", "quarantine")}
    written = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = score(batch.drop("arrived")).persist()
        written["schema"] = scored.schema
        try:
            for kind, rows in (("answers", scored.where("error IS NULL")), ("quarantine", scored.where("error IS NOT NULL"))):
                rows.write.mode("overwrite").parquet(os.path.join(places[kind], f"batch_id={batch_id}"))
        finally:
            scored.unpersist()

    (once.writeStream.foreachBatch(write).option("checkpointLocation", os.path.join(out_dir, "checkpoint"))
     .trigger(availableNow=True).start().awaitTermination())
    read = spark.read if not written else spark.read.schema(written["schema"])
    return tuple(read.parquet(p).drop("batch_id") for p in places.values())
