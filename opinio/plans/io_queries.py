"""Source/sink (S1, S3, S4, S6, S7) and streaming (ST1-ST3) queries.

Each writes data that Spark derives from the given tables into a fresh
folder under the shared ``spark.checkpoint.dir`` and reads it back.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from opinio.functions import text as T
from opinio.operators import models as MO
from opinio.operators.dedup import keep_first
from opinio.operators.profile import is_empty
from opinio.plans.lexicon_queries import SQL_LABEL, SQL_SCORE, sql_tokens
from opinio.plans.registry import register, sql_list, table
from opinio.resources import DOCS_LEXICON, PANDAS_NA_TOKENS
from opinio.session import work_dir
from opinio.sources import comments as S
from opinio.streaming import counts as SC
from opinio.streaming import scoring as SS


# Domain for the running totals (known event types plus one never seen).
EVENT_TYPES = ("click", "error", "purchase", "view", "signup", "refund")


def _comments(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("no"), F.col("text").alias("comment"), F.col("lang").alias("label"))


def _na(c):
    return f"CASE WHEN {c} IN {sql_list(PANDAS_NA_TOKENS)} THEN NULL ELSE {c} END"


@register("csv_round_trip", family="io", sql=f"""
SELECT doc_id AS no, {_na("text")} AS comment, {_na("lang")} AS label, doc_id AS row_id FROM documents
""")
def q_csv_round_trip(spark, sf):
    """S4 then S1 (+S2): write comments as CSV part files, read them back."""
    path = work_dir(spark, "comments-csv")
    S.write_comments_csv(_comments(spark, sf), path)
    return S.read_comments(spark, path)


@register("split_pruning", family="io", sql="""
SELECT doc_id, n_chars, lang AS split FROM documents WHERE lang = 'fr'
""")
def q_split_pruning(spark, sf):
    """S3: splits as partition folders; the split filter prunes folders."""
    path = work_dir(spark, "splits")
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.col("lang").alias("split"))
    S.write_splits(d, path, "split")
    return S.read_splits(spark, path, "fr").select("doc_id", "n_chars", "split")


@register("quarantine_malformed", family="io", sql="""
SELECT CASE WHEN page_id % 7 = 0 THEN 'bad' ELSE 'good' END AS status, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN page_id % 7 = 0 THEN 0 ELSE page_id END) AS BIGINT) AS id_sum,
       CAST(count(url) AS BIGINT) AS with_url,
       CAST(sum(CASE WHEN page_id % 7 = 0 THEN 0 ELSE length(html) END) AS BIGINT) AS chars
FROM pages GROUP BY 1
""")
def q_quarantine_malformed(spark, sf):
    """All pages as ``page_id,url,html`` CSV rows, whose HTML spans lines, every seventh id
    spoilt: those rows are quarantined with their raw text instead of failing the job."""
    path = work_dir(spark, "pages-drop")
    spoilt = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("x"), F.col("page_id").cast("string"))) \
        .otherwise(F.col("page_id").cast("string"))
    S.write_comments_csv(table(spark, sf, "pages").select(spoilt.alias("page_id"), "url", "html"), path)
    schema = StructType([StructField("page_id", LongType()), *[StructField(c, StringType()) for c in ("url", "html")]])
    good, bad = S.quarantine_malformed(spark, path, schema)
    both = (good.select(F.lit("good").alias("status"), "page_id", "url", F.length("html").alias("chars"))
            .unionByName(bad.select(F.lit("bad").alias("status"), "page_id", F.col(S.CORRUPT_COL).alias("url"), F.lit(0).alias("chars"))))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("page_id"), F.lit(0)).alias("id_sum"),
                                      F.count("url").alias("with_url"), F.sum("chars").cast("long").alias("chars"))


@register("csv_keep_first", family="io", sql=f"""
SELECT comment, arg_min(label, doc_id) AS label FROM (
  SELECT doc_id, {_na("text")} AS comment, coalesce({_na("lang")}, '') || ':' || doc_id AS label FROM documents) GROUP BY comment
""")
def q_csv_keep_first(spark, sf):
    """S1 + D1 without an id column: the row order is that of the files and their lines."""
    path = work_dir(spark, "comments-noid")
    d = (table(spark, sf, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
         .select(F.col("text").alias("comment"), F.concat(F.coalesce("lang", F.lit("")), F.lit(":"), F.col("doc_id")).alias("label")))
    S.write_comments_csv(d, path)
    rows = S.read_comments(spark, path, schema="comment STRING, label STRING", id_col=None)
    return keep_first(rows, ["comment"]).select("comment", "label")


@register("required_columns", family="io", sql="""
SELECT CAST(count(*) AS BIGINT) AS n_rows, count(*) = 0 AS empty, true AS missing_refused FROM documents
""")
def q_required_columns(spark, sf):
    """The comment column is required, its absence is an error; is the table empty?"""
    d = _comments(spark, sf)
    held = S.require_columns(d, ["comment"])
    try:
        S.require_columns(d.drop("comment"), ["comment"])
        refused = False
    except ValueError:
        refused = True
    empty = is_empty(held)
    return held.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(empty).alias("empty"),
                                                              F.lit(refused).alias("missing_refused"))


@register("model_save_load", family="io", sql="""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_different
FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL
""")
def q_model_save_load(spark, sf):
    """Fit, save and reload; both models must give every row the same label."""
    from pyspark.ml import PipelineModel
    from opinio.plans.ml_queries import _labelled, fit_partitions
    d = _labelled(spark, sf).select("doc_id", "ws", "label", "lex_score")
    model = MO.train_classifier(d, "ws", "label", ["lex_score"], partitions=fit_partitions(spark, sf))
    path = work_dir(spark, "model")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    cols = ["doc_id", "ws", "lex_score"]
    one = MO.predict_labels(model, d.select(*cols), "a").select(*cols, "a")
    both = MO.predict_labels(again, one, "b").select("a", "b")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_different"))


@register("stream_model_scoring", family="streaming", sql="""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM documents
""")
def q_stream_model_scoring(spark, sf):
    """ST1 and ST2 with the trained model: every document arrives as a JSON request and as a
    CSV row; both streams must give the label of the batch prediction, and the scored CSV
    still holds the comment."""
    from opinio.plans.ml_queries import _labelled, fit_partitions, scoring_columns
    model = MO.train_classifier(_labelled(spark, sf), "ws", "label", ["lex_score"], partitions=fit_partitions(spark, sf))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    root = work_dir(spark, "model-requests")
    docs.select(F.to_json(F.struct(F.col("doc_id").alias("id"), "text")).alias("value")).write.text(os.path.join(root, "json"))
    lines = spark.readStream.schema("value string").text(os.path.join(root, "json"))
    scored = SS.score_requests_with_model(SS.parse_requests(lines), model, scoring_columns)
    by_json = SC.run_to_table(spark, scored, os.path.join(root, "json-out"))
    S.write_comments_csv(_comments(spark, sf), os.path.join(root, "csv"))
    SS.run_csv_drops(spark, os.path.join(root, "csv"), S.COMMENT_SCHEMA, lambda d: SS.score_csv_with_model(d, model, scoring_columns),
                     os.path.join(root, "csv-out"), "csv", S.CSV_WRITE)
    by_csv = S.read_comments(spark, os.path.join(root, "csv-out", "data", "*"), S.COMMENT_SCHEMA + ", predicted_label STRING", na_tokens=None)
    batch = MO.predict_labels(model, scoring_columns(docs)).select("doc_id", "text", "predicted_label",
                                                                  (F.length("text") > 0).alias("valid"))
    both = (batch.join(by_json.select(F.col("id").alias("doc_id"), F.col("prediction").alias("j")), "doc_id", "left")
            .join(by_csv.select(F.col("no").alias("doc_id"), F.col("predicted_label").alias("c"), "comment"), "doc_id", "left"))
    same_text = F.coalesce("comment", F.lit("")) == F.coalesce("text", F.lit(""))
    wrong = ~same_text | ~F.col("c").eqNullSafe(F.col("predicted_label")) | (F.col("valid") & ~F.col("j").eqNullSafe(F.col("predicted_label")))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("n_different"))


def _requests(spark, sf):
    """Request bodies derived from ``conversations``: user turns send their
    text; of assistant turns the first of a conversation sends its turn number (a
    non-string, invalid), the others their text; empty texts are sent as-is (invalid)."""
    conv = table(spark, sf, "conversations")
    rid = (F.col("conv_id") * 1000 + F.col("turn")).alias("id")
    body = F.when((F.col("role") != "assistant") | (F.col("turn") != 1), F.to_json(F.struct(rid, F.col("text").alias("text")))) \
        .otherwise(F.to_json(F.struct(rid, F.col("turn").alias("text"))))
    return conv.select(body.alias("value"))


@register("stream_json_scoring", family="streaming", sql=f"""
SELECT id, CASE WHEN valid THEN {SQL_LABEL.format(s=SQL_SCORE)} END AS prediction,
       CASE WHEN NOT valid THEN '{SS.INVALID_TEXT.replace("'", "''")}' END AS error
FROM (SELECT conv_id * 1000 + turn AS id, sent AND text IS NOT NULL AND text <> '' AS valid,
             {sql_tokens("CASE WHEN sent THEN text END")} AS ws
      FROM (SELECT *, role <> 'assistant' OR turn <> 1 AS sent FROM conversations))
""")
def q_stream_json_scoring(spark, sf):
    """ST1: JSON request lines landing in a folder, scored by a stream."""
    root = work_dir(spark, "requests")
    _requests(spark, sf).write.text(os.path.join(root, "in"))
    stream = spark.readStream.schema("value string").text(os.path.join(root, "in"))
    scored = SS.score_requests(SS.parse_requests(stream), DOCS_LEXICON)
    return SC.run_to_table(spark, scored, os.path.join(root, "out"))


@register("stream_requests_once", family="streaming", sql=f"""
SELECT id, CASE WHEN valid THEN {SQL_LABEL.format(s=SQL_SCORE)} END AS prediction, NOT valid AS quarantined
FROM (SELECT conv_id * 1000 + turn AS id, sent AND text IS NOT NULL AND text <> '' AS valid,
             {sql_tokens("CASE WHEN sent THEN text END")} AS ws
      FROM (SELECT *, role <> 'assistant' OR turn <> 1 AS sent FROM conversations))
""")
def q_stream_requests_once(spark, sf):
    """ST1: every request is sent twice, in several files and batches; each id is answered once,
    and the invalid ones are quarantined."""
    root = work_dir(spark, "requests-twice")
    requests = _requests(spark, sf)
    requests.repartition(4).write.text(os.path.join(root, "in"))
    requests.repartition(3).write.mode("append").text(os.path.join(root, "in"))
    good, bad = SS.run_requests(spark, os.path.join(root, "in"), lambda r: SS.score_requests(r, DOCS_LEXICON),
                                os.path.join(root, "out"), files_per_batch=3)
    cols = ["id", "prediction", F.col("error").isNotNull().alias("quarantined")]
    return good.select(*cols).unionByName(bad.select(*cols))


@register("stream_csv_scoring", family="streaming", sql=f"""
SELECT doc_id AS no, {_na("text")} AS comment, {_na("lang")} AS label, {SQL_LABEL.format(s=SQL_SCORE)} AS predicted_label
FROM (SELECT doc_id, text, lang, {sql_tokens(_na("text"))} AS ws FROM documents)
""")
def q_stream_csv_scoring(spark, sf):
    """ST2: CSV drops (quoted, multi-line) scored and written by a stream."""
    root = work_dir(spark, "csv-drops")
    S.write_comments_csv(_comments(spark, sf), os.path.join(root, "in"))
    return SS.run_csv_drops(spark, os.path.join(root, "in"), S.COMMENT_SCHEMA,
                            lambda d: SS.score_csv_stream(S.normalize_na(d), DOCS_LEXICON, "comment"), os.path.join(root, "out"))


@register("stream_event_counts", family="streaming", sql="""
SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, CAST(count(*) AS BIGINT) AS n
FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, event_type FROM events)
GROUP BY b, event_type
HAVING b + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
""")
def q_stream_event_counts(spark, sf):
    """ST3: hourly counts per event type with a 10-minute watermark, append
    mode: only windows the watermark has closed are emitted."""
    root = work_dir(spark, "events")
    src = table(spark, sf, "events")
    # Files hold consecutive times, as an event log's do.
    src.repartitionByRange("ts").sortWithinPartitions("ts").write.parquet(os.path.join(root, "in"))
    stream = spark.readStream.schema(src.schema).parquet(os.path.join(root, "in"))
    counts = SC.windowed_label_counts(stream, "ts", "event_type", "1 hour", "10 minutes")
    out = SC.run_to_table(spark, counts, os.path.join(root, "out"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "event_type", "n")


@register("stream_label_totals", family="streaming", sql=f"""
SELECT d.event_type, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT unnest({list(EVENT_TYPES)}) AS event_type) d
LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) c USING (event_type)
""")
def q_stream_label_totals(spark, sf):
    """ST3 totals (stream form of A7): complete-mode running counts per event
    type, reported over a fixed domain with zeros for absent types."""
    root = work_dir(spark, "event-totals")
    src = table(spark, sf, "events")
    src.write.parquet(os.path.join(root, "in"))
    stream = spark.readStream.schema(src.schema).parquet(os.path.join(root, "in"))
    totals = SC.run_complete_to_table(spark, SC.running_totals(stream, "event_type"), os.path.join(root, "out"))
    dom = spark.createDataFrame([(x,) for x in EVENT_TYPES], "event_type string")
    return (F.broadcast(dom).join(totals, "event_type", "left")
            .select("event_type", F.coalesce("n", F.lit(0)).cast("long").alias("n")))
