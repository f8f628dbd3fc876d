"""Training-data pipeline over ``documents``: the stages in their order.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each
stage's result as Parquet and rereads it as the next stage's documents.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.llm import decontaminate as benchmarks
from opinio.llm import lines, minhash, mixing, toxicity
from opinio.llm.common import broadcast_if_small, release_shuffles, remove_path, settle
from opinio.session import work_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject (score under 0.5).

    A null text is scored as an empty one and stays null; rows that repeat id and text, or
    have no id, are judged one by one.
    """
    lexicon = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, lexicon, keep=COLUMNS).where("score < 0.5").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated multi-line chunks and passages of 25 words or more.

    The first of equal passages stays: that of the smallest id, in a document the upper one.
    Rows that repeat id and text are cut alike; rows without id come after all others; null
    text stays null.  A document left without any word goes: all it said stands elsewhere.
    One that had no word before stays as it was.
    """
    cut = lines.dedup_passages(docs.select(*COLUMNS))
    emptied = (F.col("n_lines_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.where(~F.coalesce(emptied, F.lit(False))).select(*COLUMNS[:-1], F.length("text").cast("long").alias("n_chars"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least id.

    Rows go by id and text: without an id a row comes last in its group, of several texts
    under the least id that with the least hash stays, and of equal rows one.
    """
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    found = minhash.near_duplicates(docs, keyed=True)
    least = settle(found.where("comp IS NOT NULL").groupBy("comp").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
                   .where("lo != hi").select("comp", "lo"))
    release_shuffles(spark)
    gone = settle(found.join(broadcast_if_small(least, F.lit(64)), "comp").where(own != F.col("lo"))
                  .select("doc_id", "text_key").distinct())
    again = settle(found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                   .select("doc_id", "text_key"))
    release_shuffles(spark)

    def among(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = broadcast_if_small(keys, F.lit(32)).toDF("__id", "__key")
        same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
        return df.join(keys, same, how)

    left = among(docs.select(*COLUMNS), gone, "left_anti")
    if again.isEmpty():
        return left
    one = among(left, again, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return among(left, again, "left_anti").unionByName(one.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    A null or empty text has no words and stays; repeated rows are judged one by one.
    """
    found = benchmarks.decontaminate(docs, _table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where("NOT contaminated").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: documents taken at least once, with how many words are taken.

    Documents without words are not taken; rows that repeat id and text are taken together;
    a null source is a source, last in order.
    """
    return mixing.mix_sources(docs, keep=COLUMNS).where("taken > 0")


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("minhash_dedup", dedup_near),
          ("decontamination", decontaminate), ("mixing", mix)]

#: SQL cannot express the learned and the MinHash stages: tests/llm compares the run with a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table.

    A stage's table goes when the next one is written; that of the last stage but one stays in
    the shared folder, since the result reads it.
    """
    docs, read = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            remove_path(spark, read)
        docs, read = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
