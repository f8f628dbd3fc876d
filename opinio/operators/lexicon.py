"""Lexicon sentiment over tables.

Two physical forms with equal results:

* array form (:func:`score_comments`): token array + ``zip_with`` with hash-set
  lookups; a pure projection, no shuffle at all.  Used while the lexicon can
  be inlined in the plan.
* exploded form (:func:`score_comments_exploded`): ``(row, word, previous
  word)`` pairs joined to lexicon tables; only lexicon hits and one
  ``(row_id, 0)`` seed per row are shuffled, pre-aggregated per task.  Used
  for lexicons given as (possibly large) tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.functions import lexicon as L
from opinio.functions.arrays import explode_rows
from opinio.functions.text import word_tokens
from opinio.resources import Lexicon
from opinio.sources.tables import bounded_broadcast


def tokens(df: DataFrame, text_col: str, out: str = "_ws") -> DataFrame:
    """Materialise ``\\b\\w+\\b`` tokens of the lower-cased text once; null
    text scores as empty text."""
    return df.withColumn(out, word_tokens(F.coalesce(F.col(text_col), F.lit(""))))


def mark_negation(df: DataFrame, lex: Lexicon, text_col: str = "comment",
                  out: str = "marked") -> DataFrame:
    """L1: processed text (negators consumed, ``NEG_``/``POS_`` markers)."""
    return (tokens(df, text_col)
            .withColumn(out, F.array_join(L.negation_marks("_ws", lex), " "))
            .drop("_ws"))


def score_comments(df: DataFrame, lex: Lexicon, text_col: str = "comment",
                   score_col: str = "score", label_col: str | None = "sentiment") -> DataFrame:
    """L2 + L3, array form, for a lexicon held by the caller: its words become
    hash sets in the plan.  Table-sized lexicons use the exploded form."""
    out = tokens(df, text_col).withColumn(score_col, L.lexicon_score("_ws", lex)).drop("_ws")
    if label_col:
        out = out.withColumn(label_col, L.score_label(score_col))
    return out


def score_comments_exploded(df: DataFrame, polarity: DataFrame, negators: DataFrame,
                            text_col: str = "comment", row_id: str = "row_id",
                            keep: Sequence[str] = (), score_col: str = "score",
                            label_col: str | None = "sentiment") -> DataFrame:
    """L2 + L3, exploded form for table lexicons ``polarity(word, polarity)``
    and ``negators(word)``.  Returns ``(row_id, *keep, score[, label])``."""
    toks = tokens(df.select(row_id, *keep, text_col), text_col)
    pairs = explode_rows(toks, F.zip_with(
        "_ws", F.concat(F.array(F.lit(None).cast("string")), F.col("_ws")),
        lambda w, p: F.struct(w.alias("word"), p.alias("prev"))), "t", row_id, *keep).select(
        row_id, *keep, "t.word", "t.prev")
    pol = bounded_broadcast(polarity.select("word", F.col("polarity").cast("int").alias("polarity")))
    neg = bounded_broadcast(negators.select(F.col("word").alias("prev")).distinct()).withColumn("_neg", F.lit(-1))
    hits = (pairs.join(pol, on="word", how="inner")
            .join(neg, on="prev", how="left")
            .select(row_id, *keep, (F.col("polarity") * F.coalesce("_neg", F.lit(1))).alias("_c")))
    seeds = toks.select(row_id, *keep, F.lit(0).alias("_c"))
    out = seeds.unionByName(hits).groupBy(row_id, *keep).agg(F.sum("_c").cast("int").alias(score_col))
    if label_col:
        out = out.withColumn(label_col, L.score_label(score_col))
    return out


def classify(df: DataFrame, lex: Lexicon, text_col: str = "comment",
             out: str = "sentiment") -> DataFrame:
    """L4: drop null comments, then label each one."""
    return score_comments(df.dropna(subset=[text_col]), lex, text_col, "_score", out).drop("_score")


def accuracy_by(df: DataFrame, pred_col: str, label_col: str,
                group_cols: Sequence[str] = ()) -> DataFrame:
    """Share of rows where prediction equals label; a null label
    counts as wrong (null-safe equality, not ``avg`` over a nullable bool)."""
    acc = F.avg(F.col(pred_col).eqNullSafe(F.col(label_col)).cast("double"))
    return df.groupBy(*group_cols).agg(acc.alias("accuracy"), F.count(F.lit(1)).alias("n"))
