"""Lexicon sentiment queries (flagship slice, L1-L5, P10, P11, M9 lexicon form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinio.functions import labels as LB
from opinio.functions import lexicon as LX
from opinio.functions import text as T
from opinio.operators import clean as C
from opinio.operators import dedup as D
from opinio.operators import lexicon as L
from opinio.operators import wordstats as W
from opinio.plans.registry import register, sql_list, table
from opinio.plans.text_queries import ASPECTS, sql_normalize
from opinio.resources import DOCS_LEXICON as LEX
from opinio.sources.tables import spread

POS, NEG, NOTS = sql_list(LEX.positive), sql_list(LEX.negative), sql_list(LEX.negators)
POLAR = sql_list(LEX.positive + LEX.negative)


def sql_tokens(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '{T.WORD_RE}')"


SQL_SCORE = (f"CAST(coalesce(list_sum(list_transform(ws, lambda w, i: "
             f"(CASE WHEN w IN {POS} THEN 1 WHEN w IN {NEG} THEN -1 ELSE 0 END) * "
             f"(CASE WHEN i > 1 AND ws[i - 1] IN {NOTS} THEN -1 ELSE 1 END))), 0) AS INTEGER)")
SQL_LABEL = "CASE WHEN {s} > 0 THEN 'positif' WHEN {s} < 0 THEN 'negatif' ELSE 'netral' END"


def flagship(spark, sf_dir):
    """Minimum end-to-end slice: keep-first dedup -> normalise -> tokens ->
    negation-aware lexicon score -> label -> label share per language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    firsts = D.keep_first(docs, ["text"], "doc_id")
    scored = L.score_comments(firsts.withColumn("text", T.normalize("text")), LEX, "text",
                              "score", "sentiment")
    return W.label_share(scored, "sentiment", by=["lang"])


@register("sentiment_share_by_lang", family="lexicon", sql=f"""
WITH d AS (SELECT doc_id, text, lang FROM (
             SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1),
t AS (SELECT lang, {sql_tokens(sql_normalize("text"))} AS ws FROM d),
s AS (SELECT lang, {SQL_LABEL.format(s=SQL_SCORE)} AS sentiment FROM t)
SELECT lang, sentiment, CAST(count(*) AS BIGINT) AS n,
       round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 1) AS share
FROM s GROUP BY lang, sentiment
""")
def q_flagship(spark, sf):
    return flagship(spark, sf)


@register("mark_negation", family="lexicon", sql=f"""
SELECT doc_id, array_to_string(list_filter(list_transform(ws, lambda w, i:
  CASE WHEN w IN {NOTS} AND i < len(ws) AND ws[i + 1] IN {POLAR} THEN NULL
       WHEN i > 1 AND ws[i - 1] IN {NOTS} AND w IN {POS} THEN 'NEG_' || w
       WHEN i > 1 AND ws[i - 1] IN {NOTS} AND w IN {NEG} THEN 'POS_' || w
       ELSE w END), lambda x: x IS NOT NULL), ' ') AS marked
FROM (SELECT doc_id, {sql_tokens("text")} AS ws FROM documents)
""")
def q_mark_negation(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return L.mark_negation(d, LEX, "text", "marked").select("doc_id", "marked")


@register("lexicon_score", family="lexicon", sql=f"""
SELECT doc_id, {SQL_SCORE} AS score FROM (SELECT doc_id, {sql_tokens("text")} AS ws FROM documents)
""")
def q_lexicon_score(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return L.score_comments(d, LEX, "text", "score", None).select("doc_id", "score")


@register("lexicon_score_exploded", family="lexicon", sql=f"""
SELECT doc_id, {SQL_SCORE} AS score, {SQL_LABEL.format(s=SQL_SCORE)} AS sentiment
FROM (SELECT doc_id, {sql_tokens("text")} AS ws FROM documents)
""")
def q_lexicon_score_exploded(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return L.score_comments_exploded(d, LEX.polarity_frame(spark), LEX.negator_frame(spark),
                                     "text", "doc_id")


@register("lexicon_classify", family="lexicon", sql=f"""
SELECT conv_id, turn, role, {SQL_LABEL.format(s=SQL_SCORE)} AS sentiment
FROM (SELECT conv_id, turn, role, {sql_tokens("text")} AS ws FROM conversations WHERE text IS NOT NULL)
""")
def q_lexicon_classify(spark, sf):
    conv = spread(table(spark, sf, "conversations"))
    return L.classify(conv, LEX, "text", "sentiment").select("conv_id", "turn", "role", "sentiment")


TRUTH_SQL = "CASE l.quality WHEN 1 THEN 'positif' WHEN 0 THEN 'negatif' END"


@register("lexicon_accuracy", family="lexicon", sql=f"""
SELECT lang, round(avg(CASE WHEN sentiment IS NOT DISTINCT FROM truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       CAST(count(*) AS BIGINT) AS n
FROM (SELECT d.lang, {SQL_LABEL.format(s=SQL_SCORE)} AS sentiment, {TRUTH_SQL} AS truth
      FROM (SELECT doc_id, lang, {sql_tokens("text")} AS ws FROM documents) d LEFT JOIN labels l USING (doc_id))
GROUP BY lang
""")
def q_lexicon_accuracy(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    truth = table(spark, sf, "labels").select(
        "doc_id", LB.map_values("quality", {1: "positif", 0: "negatif"}).alias("truth"))
    scored = L.score_comments(spread(d), LEX, "text", "_s", "sentiment").join(truth, "doc_id", "left")
    return L.accuracy_by(scored, "sentiment", "truth", ["lang"]).withColumn(
        "accuracy", F.round("accuracy", 6))


@register("score_code", family="lexicon", sql=f"""
SELECT doc_id, sentiment, CASE sentiment WHEN 'positif' THEN 2 WHEN 'negatif' THEN 0 ELSE 1 END AS code
FROM (SELECT doc_id, {SQL_LABEL.format(s=SQL_SCORE)} AS sentiment
      FROM (SELECT doc_id, {sql_tokens("text")} AS ws FROM documents))
""")
def q_score_code(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    s = L.score_comments(d, LEX, "text", "_s", "sentiment")
    return s.select("doc_id", "sentiment", LB.label_code("sentiment").alias("code"))


@register("blank_guard", family="lexicon", sql=f"""
SELECT doc_id, CASE WHEN regexp_replace(coalesce(long_words, ''), '{T.EDGE_SPACE_RE}', '', 'g') = '' THEN 'netral'
                    ELSE prediction END AS prediction
FROM (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'positif' ELSE 'negatif' END AS prediction,
             array_to_string(list_filter({sql_tokens("text")}, lambda w: length(w) >= 14), ' ') AS long_words FROM documents)
""")
def q_blank_guard(spark, sf):
    """Predictions that are never neutral, guarded where no long word is left of the text."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text", "n_chars"))
    d = d.withColumn("long_words", F.array_join(
        F.filter(T.word_tokens("text"), lambda w: F.length(w) >= 14), " "))
    d = d.withColumn("pred", F.when(F.col("n_chars") % 2 == 0, "positif").otherwise("negatif"))
    return d.select("doc_id", LB.blank_guard("long_words", "pred").alias("prediction"))


@register("sentiment_aspect", family="lexicon", sql=f"""
SELECT doc_id, {SQL_LABEL.format(s=SQL_SCORE)} AS sentiment,
       list_filter(regexp_extract_all(coalesce(text, ''), '{T.WORD_RE}'), lambda w: lower(w) IN {sql_list(ASPECTS)})[1] AS aspect
FROM (SELECT doc_id, text, {sql_tokens("text")} AS ws FROM documents)
""")
def q_sentiment_aspect(spark, sf):
    """T12 with L3: the sentiment and the first aspect of each comment."""
    d = spread(table(spark, sf, "documents")).select("doc_id", "text")
    return C.sentiment_aspect(d, "text", LEX, ASPECTS).select("doc_id", "sentiment", "aspect")


@register("lexicon_attribution", family="lexicon", sql=f"""
WITH t AS (SELECT doc_id, unnest(ws) AS word, unnest(list_prepend(NULL, ws)[1:len(ws)]) AS prev
           FROM (SELECT doc_id, {sql_tokens("text")} AS ws FROM documents)),
c AS (SELECT doc_id, word, (CASE WHEN word IN {POS} THEN 1 ELSE -1 END) * (CASE WHEN prev IN {NOTS} THEN -1 ELSE 1 END) AS c
      FROM t WHERE word IN {POLAR})
SELECT doc_id, word, CAST(sum(c) AS BIGINT) AS contribution, CAST(count(*) AS BIGINT) AS occurrences
FROM c GROUP BY doc_id, word
""")
def q_lexicon_attribution(spark, sf):
    """M9, lexicon form: each word's signed contribution to its document's score."""
    from opinio.operators.models import lexicon_attribution
    d = table(spark, sf, "documents").select("doc_id", "text")
    return lexicon_attribution(d, LEX.polarity_frame(spark), LEX.negator_frame(spark), "text", "doc_id")
