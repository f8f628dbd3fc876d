"""Profiling, dedup, text normalisation and word-statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinio.functions import labels as LB
from opinio.functions import text as T
from opinio.functions.arrays import explode_rows
from opinio.operators import clean as C
from opinio.operators import dedup as D
from opinio.operators import profile as PR
from opinio.operators import stemming as ST
from opinio.operators import wordstats as W
from opinio.plans.registry import register, sql_list, table
from opinio.resources import (DOCS_EMOJI, DOCS_LANGS, DOCS_STOPWORDS, DOCS_SYNONYMS,
                              LABEL_CODES, PANDAS_NA_TOKENS)
from opinio.sources.tables import spread

WS = T.SPACE_CHARS
PUNCT = T.PUNCT_RE
EDGE = T.EDGE_SPACE_RE

# DuckDB spellings of the shared text expressions.
def sql_normalize(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '{PUNCT}', '', 'g'), '{EDGE}', '', 'g')"


def sql_split(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '[{WS}]+'), lambda x: x <> '')"


def sql_clean(c: str, stop: str) -> str:
    base = (f"regexp_replace(regexp_replace(lower(coalesce(CAST({c} AS VARCHAR), '')), "
            f"'{T.DIGITS_RE}', '', 'g'), '{PUNCT}', '', 'g')")
    return f"array_to_string(list_filter({sql_split(base)}, lambda w: w NOT IN {stop}), ' ')"


def docs(spark, sf):
    return table(spark, sf, "documents")


def docs_labels(spark, sf):
    return docs(spark, sf).join(table(spark, sf, "labels"), on="doc_id", how="left")


# ---------------------------------------------------------------- profiling
@register("null_counts", family="profile", sql="""
SELECT column_name, CAST(null_count AS BIGINT) AS null_count FROM (
  SELECT 'doc_id' AS column_name, count(*) - count(d.doc_id) AS null_count FROM documents d LEFT JOIN labels l USING (doc_id)
  UNION ALL SELECT 'text', count(*) - count(text) FROM documents d LEFT JOIN labels l USING (doc_id)
  UNION ALL SELECT 'lang', count(*) - count(lang) FROM documents d LEFT JOIN labels l USING (doc_id)
  UNION ALL SELECT 'source', count(*) - count(source) FROM documents d LEFT JOIN labels l USING (doc_id)
  UNION ALL SELECT 'n_chars', count(*) - count(n_chars) FROM documents d LEFT JOIN labels l USING (doc_id)
  UNION ALL SELECT 'quality', count(*) - count(quality) FROM documents d LEFT JOIN labels l USING (doc_id)
  UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM documents d LEFT JOIN labels l USING (doc_id))
""")
def q_null_counts(spark, sf):
    return PR.null_counts(docs_labels(spark, sf))


@register("duplicate_count", family="profile", sql="""
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_keys,
       CAST(sum(n - 1) AS BIGINT) AS n_duplicates
FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)
""")
def q_duplicate_count(spark, sf):
    return PR.duplicate_count(docs(spark, sf), ["text"])


@register("shape", family="profile", sql="""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(5 AS BIGINT) AS n_cols FROM documents
""")
def q_shape(spark, sf):
    return PR.shape(docs(spark, sf))


@register("column_info", family="profile", sql="""
SELECT * FROM (VALUES ('doc_id', 'bigint'), ('text', 'string'), ('lang', 'string'),
                      ('source', 'string'), ('n_chars', 'bigint')) t(column_name, data_type)
JOIN (SELECT 'doc_id' AS column_name, CAST(count(doc_id) AS BIGINT) AS non_null FROM documents
      UNION ALL SELECT 'text', count(text) FROM documents
      UNION ALL SELECT 'lang', count(lang) FROM documents
      UNION ALL SELECT 'source', count(source) FROM documents
      UNION ALL SELECT 'n_chars', count(n_chars) FROM documents) c USING (column_name)
""")
def q_column_info(spark, sf):
    return PR.column_info(docs(spark, sf))


# -------------------------------------------------------------- label stats
@register("label_counts", family="wordstats", sql="""
SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang
""")
def q_label_counts(spark, sf):
    return W.label_counts(docs(spark, sf), "lang")


@register("label_share", family="wordstats", sql="""
SELECT source, lang, CAST(n AS BIGINT) AS n, round(100.0 * n / sum(n) OVER (PARTITION BY source), 1) AS share
FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY source, lang)
""")
def q_label_share(spark, sf):
    return W.label_share(docs(spark, sf), "lang", by=["source"])


@register("label_counts_fixed", family="wordstats", sql=f"""
SELECT d.lang, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT unnest({list(DOCS_LANGS)}) AS lang) d
LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) c USING (lang)
""")
def q_label_counts_fixed(spark, sf):
    return W.label_counts_fixed(docs(spark, sf), "lang", DOCS_LANGS)


@register("top_words", family="wordstats", sql=f"""
SELECT word, CAST(count(*) AS BIGINT) AS n
FROM (SELECT unnest({sql_split("coalesce(text, '')")}) AS word FROM documents WHERE lang = 'fr')
GROUP BY word ORDER BY n DESC, word LIMIT 10
""")
def q_top_words(spark, sf):
    return W.top_words(docs(spark, sf), "text", 10, "lang", "fr")


@register("word_cloud_weights", family="wordstats", sql=f"""
SELECT word, n, n / max(n) OVER () AS weight FROM (
  SELECT word, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT unnest(list_filter({sql_split(sql_clean("text", sql_list(DOCS_STOPWORDS)))},
                                  lambda w: length(w) >= 2)) AS word
        FROM documents WHERE lang = 'de')
  GROUP BY word ORDER BY n DESC, word LIMIT 200)
""")
def q_word_cloud_weights(spark, sf):
    return W.word_cloud_weights(docs(spark, sf), "text", "lang", "de", 200, DOCS_STOPWORDS)


@register("word_cloud_bigrams", family="wordstats", sql=f"""
SELECT word, n, n / max(n) OVER () AS weight FROM (
  SELECT word, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT unnest(list_concat(ws, list_transform(generate_series(2, len(ws)),
                                                     lambda i: ws[i - 1] || ' ' || ws[i]))) AS word
        FROM (SELECT list_filter({sql_split(sql_clean("text", sql_list(DOCS_STOPWORDS)))},
                                 lambda w: length(w) >= 2) AS ws
              FROM documents WHERE lang = 'fr'))
  GROUP BY word ORDER BY n DESC, word LIMIT 200)
""")
def q_word_cloud_bigrams(spark, sf):
    """A9 with the collocation option: adjacent word pairs count as terms."""
    return W.word_cloud_weights(docs(spark, sf), "text", "lang", "fr", 200, DOCS_STOPWORDS, bigrams=True)


_LL = "CASE WHEN {k} > 0 THEN {k} * ln(greatest({p}, 1e-300)) ELSE 0 END + CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * ln(greatest(1 - {p}, 1e-300)) ELSE 0 END"


def _ll(k: str, n: str, p: str) -> str:
    return "(" + _LL.format(k=k, n=n, p=f"({p})") + ")"


@register("collocations", family="wordstats", sql=f"""
WITH d AS (SELECT doc_id, list_filter({sql_split(sql_clean("text", sql_list(DOCS_STOPWORDS)))}, lambda w: length(w) >= 2) AS ws FROM documents),
w AS (SELECT word, count(*)::DOUBLE AS n FROM (SELECT unnest(ws) AS word FROM d) GROUP BY word),
p AS (SELECT a, b, count(*)::DOUBLE AS k FROM (SELECT ws[i] AS a, ws[i + 1] AS b FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM d)) GROUP BY a, b),
c AS (SELECT p.*, x.n AS na, greatest(y.n - k, 0) AS rest, greatest(t - x.n, 1) AS other, y.n / t AS p0
      FROM p JOIN w x ON x.word = a JOIN w y ON y.word = b, (SELECT sum(n) AS t FROM w)),
s AS (SELECT a, b, k, 2 * ({_ll("k", "na", "k / na")} + {_ll("rest", "other", "rest / other")}
                           - {_ll("k", "na", "p0")} - {_ll("rest", "other", "p0")}) AS llr FROM c),
kept AS (SELECT * FROM s WHERE llr > 30),
taken AS (SELECT word, sum(k) AS k FROM (SELECT a AS word, k FROM kept UNION ALL SELECT b, k FROM kept) GROUP BY word)
SELECT word AS term, CAST(n - coalesce(k, 0) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS llr FROM w LEFT JOIN taken USING (word) WHERE n > coalesce(k, 0)
UNION ALL SELECT a || ' ' || b, CAST(k AS BIGINT), round(llr, 3) FROM kept
""")
def q_collocations(spark, sf):
    """Adjacent pairs that occur together more than chance, taken off their words."""
    d = spread(docs(spark, sf)).select(F.filter(T.clean_words("text", DOCS_STOPWORDS), lambda w: F.length(w) >= 2).alias("ws"))
    return W.collocations(d, "ws").select("term", "n", F.round("llr", 3).alias("llr"))


@register("group_word_weights", family="wordstats", sql=f"""
SELECT source, word, n, CAST(rank AS INTEGER) AS rank, n / max(n) OVER (PARTITION BY source) AS weight FROM (
  SELECT source, word, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM (
    SELECT source, word, CAST(count(*) AS BIGINT) AS n
    FROM (SELECT source, unnest(list_filter({sql_split(sql_clean("text", sql_list(DOCS_STOPWORDS)))},
                                            lambda w: length(w) >= 2)) AS word FROM documents)
    GROUP BY source, word))
WHERE rank <= 200
""")
def q_group_word_weights(spark, sf):
    return W.group_word_weights(docs(spark, sf), "text", "source", 200, DOCS_STOPWORDS)


# --------------------------------------------------------- dedup and order
@register("keep_first", family="dedup", sql="""
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1
""")
def q_keep_first(spark, sf):
    return D.keep_first(docs(spark, sf), ["text"], "doc_id")


@register("distinct_labels", family="dedup", sql="""
SELECT role, min(turn * 1000000000 + conv_id) AS first_row FROM conversations GROUP BY role
""")
def q_distinct_labels(spark, sf):
    conv = table(spark, sf, "conversations").withColumn(
        "row_id", F.col("turn") * 1_000_000_000 + F.col("conv_id"))
    return D.distinct_labels(conv, "role", "row_id")


@register("attach_by_row", family="dedup", sql="""
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def q_attach_by_row(spark, sf):
    return D.attach_by_row(docs(spark, sf).select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@register("head_rows", family="dedup", sql="""
SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 10
""")
def q_head_rows(spark, sf):
    return D.head_rows(docs(spark, sf), 10, "doc_id")


@register("top_sources", family="dedup", sql="""
SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5
""")
def q_top_sources(spark, sf):
    counts = docs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return D.top_k(counts, 5, "n", "source")


@register("word_difference", family="dedup", sql=f"""
SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '{T.WORD_RE}')) AS word FROM documents)
EXCEPT
SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '{T.WORD_RE}')) AS word FROM benchmark)
""")
def q_word_difference(spark, sf):
    a = explode_rows(docs(spark, sf), T.word_tokens("text"), "word")
    b = explode_rows(table(spark, sf, "benchmark"), T.word_tokens("text"), "word")
    return D.set_difference(a, b, "word")


# ------------------------------------------------------- projections, P*
@register("select_rename", family="project", sql="""
SELECT doc_id, text AS comment, lang AS label FROM documents
""")
def q_select_rename(spark, sf):
    return (docs(spark, sf).select("doc_id", "text", "lang")
            .withColumnRenamed("text", "comment").withColumnRenamed("lang", "label"))


@register("drop_null_labels", family="project", sql="""
SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL
""")
def q_drop_null_labels(spark, sf):
    return docs_labels(spark, sf).select("doc_id", "quality").dropna(subset=["quality"])


@register("label_filter", family="project", sql="""
SELECT doc_id, n_chars FROM documents WHERE lang = 'es'
""")
def q_label_filter(spark, sf):
    return docs(spark, sf).filter(F.col("lang") == "es").select("doc_id", "n_chars")


@register("text_cast", family="project", sql="""
SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'nan') AS quality_text,
       coalesce(CAST(l.toxic AS VARCHAR), '') AS toxic_text
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def q_text_cast(spark, sf):
    return docs_labels(spark, sf).select(
        "doc_id", T.as_text("quality", "nan").alias("quality_text"), T.as_text("toxic", "").alias("toxic_text"))


@register("na_to_null", family="project", sql=f"""
SELECT doc_id, CASE WHEN source IN {sql_list(PANDAS_NA_TOKENS + ('src3',))} THEN NULL ELSE source END AS source
FROM documents
""")
def q_na_to_null(spark, sf):
    # 'src3' is treated as one more missing-value spelling so the rule fires.
    return docs(spark, sf).select("doc_id", T.null_if_na("source", PANDAS_NA_TOKENS + ("src3",)).alias("source"))


STAR_SQL = """
SELECT doc_id,
  CASE WHEN coalesce(s4, 0) <> 0 OR coalesce(s5, 0) <> 0 THEN 'Positif'
       WHEN coalesce(s3, 0) <> 0 THEN 'Netral'
       WHEN coalesce(s1, 0) <> 0 OR coalesce(s2, 0) <> 0 THEN 'Negatif'
       ELSE 'Unknown' END AS label
FROM (SELECT d.doc_id,
        CASE WHEN d.n_chars < 500 OR l.toxic = 1 THEN 1 ELSE 0 END AS s1,
        CASE WHEN d.n_chars >= 500 AND d.n_chars < 1000 THEN 1 ELSE 0 END AS s2,
        CASE WHEN d.n_chars >= 1000 AND d.n_chars < 2000 THEN 1 ELSE 0 END AS s3,
        CASE WHEN d.n_chars >= 2000 AND d.n_chars < 5000 THEN 1 WHEN d.n_chars >= 20000 THEN NULL ELSE 0 END AS s4,
        CASE WHEN d.n_chars >= 5000 AND l.quality = 1 THEN 1 ELSE 0 END AS s5
      FROM documents d LEFT JOIN labels l USING (doc_id))
"""


@register("stars_to_label", family="project", sql=STAR_SQL)
def q_stars_to_label(spark, sf):
    d = docs_labels(spark, sf)
    n = F.col("n_chars")
    flags = d.select(
        "doc_id",
        F.when((n < 500) | (F.col("toxic") == 1), 1).otherwise(0).alias("s1"),
        F.when((n >= 500) & (n < 1000), 1).otherwise(0).alias("s2"),
        F.when((n >= 1000) & (n < 2000), 1).otherwise(0).alias("s3"),
        F.when((n >= 2000) & (n < 5000), 1).when(n >= 20000, None).otherwise(0).alias("s4"),
        F.when((n >= 5000) & (F.col("quality") == 1), 1).otherwise(0).alias("s5"))
    return flags.select("doc_id", LB.stars_to_label("s1", "s2", "s3", "s4", "s5").alias("label"))


@register("label_code_map", family="project", sql="""
SELECT doc_id, label, CASE label WHEN 'negatif' THEN 0 WHEN 'netral' THEN 1 WHEN 'positif' THEN 2 END AS code
FROM (SELECT doc_id, CASE lang WHEN 'de' THEN 'negatif' WHEN 'fr' THEN 'positif' WHEN 'es' THEN 'netral'
                     ELSE 'other' END AS label FROM documents)
""")
def q_label_code_map(spark, sf):
    lab = LB.map_values("lang", {"de": "negatif", "fr": "positif", "es": "netral"})
    d = docs(spark, sf).select("doc_id", F.coalesce(lab, F.lit("other")).alias("label"))
    return d.withColumn("code", LB.map_values("label", LABEL_CODES))


# ------------------------------------------------------------- text, T*
@register("normalize_text", family="text", sql=f"""
SELECT doc_id, {sql_normalize("text")} AS text FROM documents
""")
def q_normalize_text(spark, sf):
    return spread(docs(spark, sf)).select("doc_id", T.normalize("text").alias("text"))


@register("remove_digits", family="text", sql=f"""
SELECT doc_id, regexp_replace(text, '{T.DIGITS_RE}', '', 'g') AS text FROM documents
""")
def q_remove_digits(spark, sf):
    return spread(docs(spark, sf)).select("doc_id", T.remove_digits("text").alias("text"))


@register("collapse_spaces", family="text", sql=f"""
SELECT doc_id, array_to_string({sql_split("text")}, ' ') AS text FROM documents
""")
def q_collapse_spaces(spark, sf):
    return spread(docs(spark, sf)).select("doc_id", T.collapse_spaces("text").alias("text"))


@register("word_tokens", family="text", sql=f"""
SELECT doc_id, CAST(len(ws) AS INTEGER) AS n_tokens, array_to_string(ws, ' ') AS tokens
FROM (SELECT doc_id, regexp_extract_all(lower(text), '{T.WORD_RE}') AS ws FROM documents)
""")
def q_word_tokens(spark, sf):
    d = spread(docs(spark, sf)).select("doc_id", T.word_tokens("text").alias("ws"))
    return d.select("doc_id", F.size("ws").alias("n_tokens"), F.array_join("ws", " ").alias("tokens"))


@register("stopword_removal", family="text", sql=f"""
SELECT doc_id, array_to_string(list_filter({sql_split(sql_normalize("text"))},
                                           lambda w: w NOT IN {sql_list(DOCS_STOPWORDS)}), ' ') AS text
FROM documents
""")
def q_stopword_removal(spark, sf):
    d = spread(docs(spark, sf)).select("doc_id", T.split_words(T.normalize("text")).alias("ws"))
    return C.remove_stopwords(d, "ws", DOCS_STOPWORDS).select("doc_id", T.join_words("ws").alias("text"))


@register("stopword_removal_table", family="text", sql=f"""
WITH stop AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{T.WORD_RE}')) AS word FROM benchmark),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
      FROM (SELECT doc_id, {sql_split(sql_normalize("text"))} AS ws FROM documents))
SELECT d.doc_id, coalesce(string_agg(t.word, ' ' ORDER BY t.pos)
                          FILTER (WHERE t.word NOT IN (SELECT word FROM stop)), '') AS text
FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id
""")
def q_stopword_removal_table(spark, sf):
    """T7 with a stopword *table*: every word of ``benchmark`` is a stopword."""
    stop = explode_rows(table(spark, sf, "benchmark"), T.word_tokens("text"), "word")
    d = docs(spark, sf).select("doc_id", T.split_words(T.normalize("text")).alias("ws"))
    return C.remove_stopwords(d, "ws", stop, row_id="doc_id").select("doc_id", T.join_words("ws").alias("text"))


SUFFIXES = ("ment", "tion", "ing", "ed", "es", "s")
PREFIXES = ("re", "en", "de")


def _stem_sql() -> str:
    cands = []
    prio = 0
    for s in SUFFIXES:
        cands.append(f"SELECT word, {prio} AS prio, CASE WHEN suffix(word, '{s}') THEN word[1:length(word)-{len(s)}] END AS cand FROM v")
        prio += 1
    for p in PREFIXES:
        cands.append(f"SELECT word, {prio}, CASE WHEN prefix(word, '{p}') THEN word[{len(p) + 1}:] END FROM v")
        prio += 1
    for p in PREFIXES:
        for s in SUFFIXES:
            cands.append(f"SELECT word, {prio}, CASE WHEN prefix(word, '{p}') AND suffix(word, '{s}') AND length(word) > {len(p) + len(s)} "
                         f"THEN word[{len(p) + 1}:length(word)-{len(s)}] END FROM v")
            prio += 1
    return f"""
WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{T.WORD_RE}')) AS word FROM documents),
c AS ({' UNION ALL '.join(cands)}),
ok AS (SELECT word, prio, cand FROM c WHERE cand IS NOT NULL AND length(cand) >= 3 AND cand IN (SELECT word FROM v)),
best AS (SELECT word, arg_min(cand, prio) AS stem FROM ok GROUP BY word)
SELECT v.word, coalesce(best.stem, v.word) AS stem FROM v LEFT JOIN best USING (word)
"""


@register("stems", family="text", sql=_stem_sql())
def q_stems(spark, sf):
    d = docs(spark, sf).select(T.word_tokens("text").alias("ws"))
    return C.affix_stems(C.vocabulary(d, "ws"), PREFIXES, SUFFIXES, 3)


@register("stemmed_text", family="text", sql=f"""
WITH stem_map AS ({_stem_sql()}),
toks AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
         FROM (SELECT doc_id, regexp_extract_all(lower(text), '{T.WORD_RE}') AS ws FROM documents))
SELECT d.doc_id, coalesce(string_agg(s.stem, ' ' ORDER BY t.pos), '') AS text
FROM documents d LEFT JOIN toks t USING (doc_id) LEFT JOIN stem_map s USING (word)
GROUP BY d.doc_id
""")
def q_stemmed_text(spark, sf):
    d = docs(spark, sf).select("doc_id", T.word_tokens("text").alias("ws"))
    stems = C.affix_stems(C.vocabulary(d, "ws"), PREFIXES, SUFFIXES, 3)
    out = C.apply_word_map(d, "ws", stems, row_id="doc_id")
    return out.select("doc_id", T.join_words("ws").alias("text"))


@register("synonyms", family="text", sql=f"""
SELECT doc_id, array_to_string(list_transform({sql_split(sql_normalize("text"))},
  lambda w: CASE w {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in DOCS_SYNONYMS.items())} ELSE w END), ' ') AS text
FROM documents
""")
def q_synonyms(spark, sf):
    d = spread(docs(spark, sf)).select("doc_id", T.split_words(T.normalize("text")).alias("ws"))
    return C.replace_synonyms(d, "ws", DOCS_SYNONYMS).select("doc_id", T.join_words("ws").alias("text"))


def _emoji_sql() -> str:
    expr = "text"
    for seq in sorted(DOCS_EMOJI, key=lambda s: (-len(s), s)):
        expr = f"replace({expr}, '{seq}', ' {DOCS_EMOJI[seq]} ')"
    return f"SELECT doc_id, {expr} AS text FROM conversations_docs"


@register("emoji_names", family="text",
          sql=_emoji_sql().replace("conversations_docs", "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"))
def q_emoji_names(spark, sf):
    conv = table(spark, sf, "conversations")
    d = conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return d.select("doc_id", T.replace_emoji("text", DOCS_EMOJI).alias("text"))


@register("clean_text", family="text", sql=f"""
SELECT doc_id, {sql_clean("text", sql_list(DOCS_STOPWORDS))} AS text FROM documents
""")
def q_clean_text(spark, sf):
    return spread(docs(spark, sf)).select("doc_id", T.clean_text("text", DOCS_STOPWORDS).alias("text"))


ASPECTS = ("und", "et", "and", "y", "with", "avec", "mit", "con")


@register("first_aspect", family="text", sql=f"""
SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '{T.WORD_RE}'),
                           lambda w: lower(w) IN {sql_list(ASPECTS)})[1] AS aspect
FROM documents
""")
def q_first_aspect(spark, sf):
    return C.first_aspect(spread(docs(spark, sf)).select("doc_id", "text"), "text", ASPECTS).select("doc_id", "aspect")


@register("clean_comments", family="text", sql=f"""
SELECT doc_id AS row_id,
       array_to_string(list_filter({sql_split(sql_normalize("comment"))},
                                   lambda w: w NOT IN {sql_list(DOCS_STOPWORDS)}), ' ') AS comment,
       lower(label) AS label
FROM (SELECT *, row_number() OVER (PARTITION BY comment ORDER BY doc_id) AS rn
      FROM (SELECT doc_id, text AS comment, lang AS label FROM documents) WHERE comment IS NOT NULL)
WHERE rn = 1
""")
def q_clean_comments(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").alias("row_id"), F.col("text").alias("comment"),
                               F.col("lang").alias("label"))
    return C.clean_comments(d, "comment", "label", "row_id", DOCS_STOPWORDS)


@register("clean_comments_stemmed", family="text", sql=f"""
WITH stem_map AS ({_stem_sql()}),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY comment ORDER BY doc_id) AS rn
                          FROM (SELECT doc_id, text AS comment, lang AS label FROM documents) WHERE comment IS NOT NULL) WHERE rn = 1),
kept AS (SELECT doc_id, lower(label) AS label, list_filter({sql_split(sql_normalize("comment"))},
                                                           lambda w: w NOT IN {sql_list(DOCS_STOPWORDS)}) AS ws FROM firsts),
toks AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM kept),
stemmed AS (SELECT doc_id, pos, coalesce(stem, word) AS w FROM toks LEFT JOIN stem_map USING (word))
SELECT k.doc_id AS row_id, coalesce(string_agg(CASE w {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in DOCS_SYNONYMS.items())} ELSE w END,
                                               ' ' ORDER BY pos), '') AS comment, any_value(label) AS label
FROM kept k LEFT JOIN stemmed USING (doc_id) GROUP BY k.doc_id
""")
def q_clean_comments_stemmed(spark, sf):
    """C10 with all its word steps in the notebook's order: stopwords, stems, synonyms."""
    d = docs(spark, sf).select(F.col("doc_id").alias("row_id"), F.col("text").alias("comment"), F.col("lang").alias("label"))
    words = C.vocabulary(d.select(T.word_tokens("comment").alias("ws")), "ws")
    stems = C.affix_stems(words, PREFIXES, SUFFIXES, 3)
    return C.clean_comments(d, "comment", "label", "row_id", DOCS_STOPWORDS, stems, DOCS_SYNONYMS)


# Forms derived from a word: what the language's affixes make of it.
INFLECTED = {
    "passive": "'di' || w", "stative": "'ber' || w", "possessive": "w || 'nya'", "emphatic": "w || 'kulah'", "plural": "w || '-' || w",
    "noun": "'ke' || w || 'annya'",
    "active": "CASE substr(w, 1, 1) WHEN 't' THEN 'men' WHEN 'p' THEN 'mem' WHEN 'k' THEN 'meng' ELSE 'meny' END || substr(w, 2)",
}
ROOT_RULE = {"active": "[tpks][aiueo][a-z]{2,}"}
ROOT_RE = "[a-z]{4,}"


def _forms_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS kind, {e} AS form FROM r WHERE regexp_full_match(w, '{ROOT_RULE.get(k, ROOT_RE)}')"
                              for k, e in INFLECTED.items())


@register("confix_stems", family="text", sql=f"""
WITH r AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '{T.WORD_RE}')) AS w FROM documents)
           WHERE regexp_full_match(w, '{ROOT_RE}')),
f AS ({_forms_sql()})
SELECT kind, CAST(count(DISTINCT form) AS BIGINT) AS n_forms, CAST(count(DISTINCT form) AS BIGINT) AS n_restored FROM f GROUP BY kind
""")
def q_confix_stems(spark, sf):
    """T8 by confix stripping: the words of the documents are the root dictionary, inflected
    forms are derived from each of them, and every form must come back to a root."""
    words = C.vocabulary(docs(spark, sf).select(T.word_tokens("text").alias("ws")), "ws")
    roots = words.where(F.col("word").rlike(f"^{ROOT_RE}$"))
    from opinio.session import checkpoint_root
    checkpoint_root(spark)
    roots = roots.checkpoint()
    kinds = F.array(*[F.when(F.col("word").rlike(f"^{ROOT_RULE.get(k, ROOT_RE)}$"),
                             F.struct(F.lit(k).alias("kind"), F.expr(e.replace("w", "word") if k != "active" else e.replace("(w,", "(word,")).alias("word")))
                      for k, e in INFLECTED.items()])
    forms = explode_rows(roots, F.filter(kinds, lambda x: x.isNotNull()), "f").select("f.kind", "f.word").distinct().checkpoint()
    stems = ST.confix_stems(forms.select("word"), roots)
    found = stems.join(roots.select(F.col("word").alias("stem")), "stem", "left_semi").withColumn("found", F.lit(1))
    return (forms.join(found, "word", "left").groupBy("kind")
            .agg(F.count(F.lit(1)).alias("n_forms"), F.count("found").alias("n_restored")))


@register("residual_duplicates", family="text", sql=f"""
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_keys,
       CAST(sum(n - 1) AS BIGINT) AS n_duplicates
FROM (SELECT comment, count(*) AS n FROM (
        SELECT array_to_string(list_filter({sql_split(sql_normalize("comment"))},
                                           lambda w: w NOT IN {sql_list(DOCS_STOPWORDS)}), ' ') AS comment
        FROM (SELECT *, row_number() OVER (PARTITION BY comment ORDER BY doc_id) AS rn
              FROM (SELECT doc_id, text AS comment FROM documents) WHERE comment IS NOT NULL)
        WHERE rn = 1)
      GROUP BY comment)
""")
def q_residual_duplicates(spark, sf):
    """A2 after C10: dedup runs on the raw text, before case folding and
    punctuation stripping, so cleaned texts can collide again; this is the
    residue the original notebook counts after cleaning."""
    d = docs(spark, sf).select(F.col("doc_id").alias("row_id"), F.col("text").alias("comment"),
                               F.col("lang").alias("label"))
    cleaned = C.clean_comments(d, "comment", "label", "row_id", DOCS_STOPWORDS)
    return PR.duplicate_count(cleaned, ["comment"])


@register("clean_comments_observed", family="text", sql=f"""
SELECT doc_id AS row_id, regexp_replace(comment, '{EDGE}', '', 'g') AS comment, lower(label) AS label
FROM (SELECT *, row_number() OVER (PARTITION BY comment ORDER BY doc_id) AS rn
      FROM (SELECT doc_id, text AS comment, upper(lang) AS label FROM documents))
WHERE rn = 1
""")
def q_clean_comments_observed(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").alias("row_id"), F.col("text").alias("comment"),
                               F.upper("lang").alias("label"))
    return C.clean_comments_observed(d, "comment", "label", "row_id")
