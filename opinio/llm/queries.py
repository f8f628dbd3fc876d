"""Registered queries of this subpackage, with DuckDB SQL where SQL can express them.

A query applies one operator with its production parameters to its whole table and
derives the fixed result columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.llm import (
    chat,
    decontaminate,
    hardneg,
    lines,
    minhash,
    mixing,
    pii,
    quality,
    suffix,
    tokencount,
    toxicity,
    warc,
    whitening,
)
from opinio.llm.common import remove_path, settle
from opinio.plans.registry import table
from opinio.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return deco


_W = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_W}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size,
               list_extract([5.0, 2.0, 1.0]::DOUBLE[], ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1) AS w
        FROM sized GROUP BY source),
capped AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM src),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER ()
             - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl
  FROM capped),
best AS (SELECT arg_min(lvl, ratio) AS lvl FROM levels WHERE ratio >= lvl),
target AS (
  SELECT source, source_size, CASE WHEN best.lvl IS NULL OR ratio < best.lvl THEN cap ELSE best.lvl * w END AS target
  FROM levels, best),
goal AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM target),
hist AS (SELECT source, h, sum(size)::BIGINT AS words,
                sum(sum(size)) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM sized GROUP BY source, h),
cut AS (
  SELECT g.source, min(struct_pack(h := h.h, nearer := (h.words - (rest - (h.upto - h.words)) < rest - (h.upto - h.words)))) AS hit
  FROM (SELECT *, target - copies * source_size AS rest FROM goal) g
  JOIN hist h ON h.source IS NOT DISTINCT FROM g.source WHERE h.upto > rest GROUP BY g.source)
SELECT s.doc_id, s.size, g.source_size, g.target,
       (s.size * (g.copies + CASE WHEN s.h < coalesce(c.hit.h + c.hit.nearer::BIGINT, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
LEFT JOIN cut c ON c.source IS NOT DISTINCT FROM s.source
"""


@register("op1_mix", OP1_SQL)
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, keep=("doc_id",))


@register("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.detect(docs, keep=("doc_id",))
    in_kinds = lambda kinds: F.array_join(F.transform(
        F.filter("pii", lambda s: s["kind"].isin(list(kinds))),
        lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.BASE_KINDS],
                        F.sha2(in_kinds(pii.BASE_KINDS), 256).alias("base_sha256"),
                        in_kinds(pii.KINDS).alias("spans"))


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_W}') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) o(k) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(ls) AS n_lines, length(regexp_replace(t, '[^!?]+', '', 'g')) AS n_marks
      FROM w LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 20 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * n_marks > 50 * n_words) AS kept,
       (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
        + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
        + CASE WHEN 100 * n_marks > 50 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed
FROM m
"""


@register("op6_quality", OP6_SQL)
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    book = quality.ledger(quality.measure(docs, keep=("doc_id",)), keep=("doc_id",))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality.passes(quality.BASE)).alias("base_failed"),
                       quality.passes(quality.PRODUCTION).alias("kept"), "failed")


@register("op3_warc")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    warc.write_archives(warc.plan_records(pages), path)
    # The merged index is written before the archives of this run are removed.  A page is a capture.
    index = settle(warc.merge_index(warc.read_archives(spark, path), rows=pages.count()))
    remove_path(spark, path)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                        "url_key", "captured")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
           FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
lens AS (SELECT DISTINCT least(13, len(ws)) AS m FROM b WHERE len(ws) > 0),
pat AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS w
        FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
win AS (SELECT rid, m, i, array_to_string(ws[i:i + m - 1], ' ') AS w
        FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, lens WHERE len(ws) >= m)),
hit AS (SELECT win.rid, win.i, win.m, pat.item_id FROM win JOIN pat ON win.m = pat.m AND win.w = pat.w),
words AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT rid, coalesce(item_id::VARCHAR, '') AS id FROM hit) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN its USING (rid)
"""


@register("op9_decontaminate", OP9_SQL)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.decontaminate(docs, benchmark, keep=("doc_id",))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@register("op4_minhash")
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op10_suffix")
def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


OP5_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
           FROM documents),
h AS (SELECT *, CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]') THEN md5(line) END AS h FROM l),
b AS (SELECT *, h IS NULL OR lead(h) OVER w IS NULL OR substr(md5(coalesce(lag(h) OVER w, '') || h), 1, 2) < '55' AS ends
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM b),
c AS (SELECT doc_id, min(i) AS a, max(i) AS z, string_agg(line, chr(10) ORDER BY i) AS run, count(*) AS n_lines FROM n GROUP BY doc_id, pos),
sized AS (SELECT doc_id, i, len(regexp_extract_all(line, '{_W}')) AS n FROM l),
words AS (SELECT doc_id, i, upto, upto - n AS before
          FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM sized WHERE n > 0)),
ahead AS (SELECT x.doc_id, x.i AS a, y.i AS z FROM words x ASOF JOIN words y ON x.doc_id = y.doc_id AND x.before + 25 <= y.upto),
back AS (SELECT x.doc_id, y.i AS a, x.i AS z FROM words x ASOF JOIN words y ON x.doc_id = y.doc_id AND x.upto - 25 >= y.before),
runs AS (SELECT doc_id, a, z, array_to_string(string_split(text, chr(10))[a + 1:z + 1], chr(10)) AS run
         FROM (SELECT * FROM ahead UNION SELECT * FROM back) JOIN documents USING (doc_id)
         UNION SELECT doc_id, a, z, run FROM c WHERE n_lines > 1 OR len(regexp_extract_all(run, '{_W}')) >= 25),
later AS (SELECT * FROM (SELECT *, min({{'d': doc_id, 'a': a}}) OVER (PARTITION BY run) AS lo FROM runs) WHERE {{'d': doc_id, 'a': a}} <> lo),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM later),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
             string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS kept
      FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_lines_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN t USING (doc_id)
"""


@register("op5_lines", OP5_SQL)
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of its own: lines in, lines removed as repeated chunks or passages, digest of what stays."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    return lines.dedup_passages(docs).select("doc_id", "n_lines", "n_lines_removed",
                                             F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(docs, lexicon, keep=("doc_id",))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
b AS (SELECT *, replace(text, '\', '\\') AS t FROM c),
e AS (SELECT *, length(replace(replace(replace(replace(replace(replace(replace(t, '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'),
             '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>')) AS n FROM b)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(16 + length(role) + n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@register("op8_chat", OP8_SQL)
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(same).alias("text"))
    made = chat.conversations(chat.linear_trees(rows.union(added)))
    read = made.select("tree", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                       chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(whole, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP11_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, label, unnest(x) AS x, unnest(range(len(x))) AS i FROM v),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, sum(a.x * b.x)::BIGINT AS score
      FROM e a JOIN e b ON a.i = b.i WHERE a.vec_id % 100 = 0 GROUP BY a.vec_id, b.vec_id, a.label, b.label),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
             row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n
      FROM s WHERE same AND vec_id <> anchor_id),
m AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
       AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
      WHERE p.n <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 5
"""


@register("op11_hardneg", OP11_SQL)
def op11_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hardneg.mine(vectors, F.col("vec_id") % 100 == 0, label_col=label)


@register("op12_tokens")
def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    counted = tokencount.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id",))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
