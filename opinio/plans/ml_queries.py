"""Feature, model and metric queries."""

from __future__ import annotations

import os

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from opinio.functions import labels as LB
from opinio.functions import text as T
from opinio.functions.arrays import explode_rows, posexplode_rows
from opinio.operators import epochs as EP
from opinio.operators import features as FE
from opinio.operators import metrics as ME
from opinio.operators import models as MO
from opinio.operators import shapley as SH
from opinio.operators import subwords as SW
from opinio.operators import wordvectors as WV
from opinio.operators.lexicon import score_comments
from opinio.plans.lexicon_queries import SQL_SCORE, sql_tokens
from opinio.plans.registry import register, sql_list, table
from opinio.resources import DOCS_LEXICON, DOCS_STOPWORDS
from opinio.session import checkpoint_root
from opinio.sources.tables import spread

TFIDF_MAX_FEATURES = 500
SEQ_VOCAB = 30_000
SEQ_LEN = 128


def _docs_tokens(spark, sf, min_len=1):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", T.word_tokens("text", min_len).alias("ws"))


def _labelled(spark, sf):
    """documents with a sentiment-style label derived from ``labels.quality``."""
    lab = table(spark, sf, "labels").select(
        "doc_id", LB.map_values("quality", {1: "positif", 0: "negatif"}).alias("label"))
    d = table(spark, sf, "documents").select("doc_id", "text").join(lab, "doc_id")
    d = score_comments(d, DOCS_LEXICON, "text", "lex_score", None)
    return d.withColumn("ws", T.word_tokens("text", 2)).withColumn("lex_score", F.col("lex_score").cast("double"))


@register("label_encoding", family="ml", sql="""
SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_index FROM documents
""")
def q_label_encoding(spark, sf):
    """M1: the languages' codes as a table, joined to the documents."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    coded = FE.encode_labels(d, "lang", FE.label_codes(d, "lang"))
    return coded.withColumn("label_index", F.col("label_index").cast("int"))


@register("tfidf_weights", family="ml", sql=f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{T.WORD2_RE}')) AS word FROM documents),
n AS (SELECT count(*) AS n FROM documents),
p AS (SELECT doc_id, word, count(*) AS tf FROM t GROUP BY doc_id, word),
v AS (SELECT word, sum(tf) AS cf, count(*) AS df FROM p GROUP BY word ORDER BY cf DESC, word LIMIT {TFIDF_MAX_FEATURES}),
w AS (SELECT p.doc_id, p.word, p.tf * (ln((1.0 + n.n) / (1.0 + v.df)) + 1.0) AS w FROM p JOIN v USING (word) CROSS JOIN n)
SELECT doc_id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w
""")
def q_tfidf_weights(spark, sf):
    d = _docs_tokens(spark, sf, 2)
    vocab = FE.fit_tfidf(d, "ws", "doc_id", TFIDF_MAX_FEATURES)
    return FE.tfidf_weights(d, "ws", "doc_id", vocab).select(
        "doc_id", "word", F.round("weight", 6).alias("weight"))


@register("tfidf_vectors", family="ml", sql=f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{T.WORD2_RE}')) AS word FROM documents),
n AS (SELECT count(*) AS n FROM documents),
p AS (SELECT doc_id, word, count(*) AS tf FROM t GROUP BY doc_id, word),
v AS (SELECT word, sum(tf) AS cf, count(*) AS df FROM p GROUP BY word ORDER BY cf DESC, word LIMIT {TFIDF_MAX_FEATURES}),
w AS (SELECT p.doc_id, p.word, p.tf * (ln((1.0 + n.n) / (1.0 + v.df)) + 1.0) AS w FROM p JOIN v USING (word) CROSS JOIN n),
x AS (SELECT doc_id, word, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM w),
s AS (SELECT doc_id, count(*) AS nnz, max(x) AS hi, sum(x) AS total FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.nnz, 0) AS INTEGER) AS nnz, round(coalesce(hi, 0.0), 6) AS max_weight,
       round(coalesce(total, 0.0), 6) AS sum_weight FROM documents d LEFT JOIN s USING (doc_id)
""")
def q_tfidf_vectors(spark, sf):
    """M2 vector form: non-zero entries, largest entry and sum of each document's
    vector (documents without vocabulary words keep a zero vector)."""
    d = _docs_tokens(spark, sf, 2)
    vocab = FE.fit_tfidf(d, "ws", "doc_id", TFIDF_MAX_FEATURES)
    v = FE.tfidf_vectors(d, "ws", vocab)
    v = v.select("doc_id", F.transform(F.filter(FE.cells("features"), lambda c: c["x"] != 0.0), lambda c: c["x"]).alias("a"))
    return v.select("doc_id", F.size("a").alias("nnz"), F.round(F.coalesce(F.array_max("a"), F.lit(0.0)), 6).alias("max_weight"),
                    F.round(LB.array_sum("a"), 6).alias("sum_weight"))


_TFIDF_X_SQL = f"""
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{T.WORD2_RE}')) AS word FROM documents),
n AS (SELECT count(*) AS n FROM documents),
p AS (SELECT doc_id, word, count(*) AS tf FROM t GROUP BY doc_id, word),
v AS (SELECT word, sum(tf) AS cf, count(*) AS df FROM p GROUP BY word ORDER BY cf DESC, word LIMIT {TFIDF_MAX_FEATURES}),
w AS (SELECT p.doc_id, p.word, p.tf * (ln((1.0 + n.n) / (1.0 + v.df)) + 1.0) AS w FROM p JOIN v USING (word) CROSS JOIN n),
x AS MATERIALIZED (SELECT doc_id, word, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM w)"""


@register("linear_attribution", family="ml", sql=f"""
WITH {_TFIDF_X_SQL},
cls AS (SELECT lang AS class, count(*) AS nc FROM documents GROUP BY lang),
coef AS (SELECT d.lang AS class, x.word, sum(x.x) / max(c.nc) AS coef
         FROM x JOIN documents d USING (doc_id) JOIN cls c ON d.lang = c.class GROUP BY d.lang, x.word),
mean AS (SELECT word, sum(x) / max(n.n) AS mean FROM x CROSS JOIN n GROUP BY word),
cm AS MATERIALIZED (SELECT * FROM coef JOIN mean USING (word)),
allb AS (SELECT class, sum(-coef * mean) AS a FROM cm GROUP BY class),
own AS MATERIALIZED (SELECT x.doc_id, cm.class, x.word, x.x, cm.coef, cm.mean
                     FROM x JOIN documents d USING (doc_id) JOIN cm ON cm.word = x.word AND cm.class = d.lang),
presb AS (SELECT doc_id, sum(-coef * mean) AS p FROM own GROUP BY doc_id)
SELECT doc_id, class, word, round(coef * (x - mean), 6) AS attribution FROM own
UNION ALL
SELECT d.doc_id, allb.class, CAST(NULL AS VARCHAR) AS word, round(allb.a - coalesce(presb.p, 0.0), 6) AS attribution
FROM documents d JOIN allb ON d.lang = allb.class LEFT JOIN presb USING (doc_id)
""")
def q_linear_attribution(spark, sf):
    """M9, linear form: exact attributions ``coef * (x - mean)`` of a linear
    scorer over TF-IDF weights -- one coefficient vector per language, its
    mean TF-IDF vector -- per document and present word in the document's own class, plus one
    baseline row (word null) per document for the absent words."""
    d = _docs_tokens(spark, sf, 2)
    vocab = FE.fit_tfidf(d, "ws", "doc_id", TFIDF_MAX_FEATURES)
    # The weights feed four branches (coefficients, means, present words,
    # baselines): written once to the shared checkpoint folder rather than
    # re-tokenising the corpus per branch.
    checkpoint_root(spark)
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("class"))
    # The class of a document rides in its row key, so no join brings it back.
    keyed = spread(table(spark, sf, "documents")).select(
        F.struct("doc_id", F.col("lang").alias("class")).alias("key"), T.word_tokens("text", 2).alias("ws"))
    x = FE.tfidf_weights(keyed, "ws", "key", vocab).select(
        "key.doc_id", "key.class", "word", F.col("weight").alias("x")).checkpoint()
    n_c = docs.groupBy("class").agg(F.count(F.lit(1)).alias("n_c"))
    coefs = (x.groupBy("class", "word").agg(F.sum("x").alias("_s"))
             .join(n_c, "class").select("class", "word", (F.col("_s") / F.col("n_c")).alias("coef")))
    x = x.select("doc_id", "word", "x")
    means = x.groupBy("word").agg((F.sum("x") / F.lit(vocab.n_docs)).alias("mean"))
    out = MO.linear_attribution(x, coefs, means, "doc_id", rows=docs)
    return out.select("doc_id", "class", "word", F.round("attribution", 6).alias("attribution"))


@register("kmeans_clusters", family="ml", sql="""
SELECT doc_id, true AS is_nearest, true AS in_range, true AS centre_is_mean FROM documents
""")
def q_kmeans_clusters(spark, sf):
    """M3: TF-IDF vectors clustered with k=3, best of 10 seeded starts.  Cluster
    ids are arbitrary; checked is that each document's cluster is that of its nearest centroid,
    and that the centroid is the mean of the documents given to it (which is so only after the
    iterations have settled)."""
    d = _docs_tokens(spark, sf, 2)
    vocab = FE.fit_tfidf(d, "ws", "doc_id", TFIDF_MAX_FEATURES)
    checkpoint_root(spark)
    v = FE.tfidf_vectors(d, "ws", vocab).select("doc_id", "features").checkpoint()  # fits and scoring read it
    model = MO.fit_kmeans(v, "features", k=3, seed=42, n_init=10, partitions=fit_partitions(spark, sf), row_id="doc_id")
    centres = [c.tolist() for c in model.clusterCenters()]
    got = model.transform(v).select("doc_id", "cluster", vector_to_array("features").alias("_v")).checkpoint()
    dist = got.withColumn("_d", MO.squared_distances("_v", centres))
    own = F.element_at("_d", F.col("cluster") + 1)
    means = MO.class_centroids(got, "_v", "cluster")
    off = F.aggregate(F.zip_with("v", F.element_at(F.lit(centres), F.col("class") + 1), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: F.greatest(a, b))
    settled = F.broadcast(means.select(F.col("class").alias("cluster"), (off < 1e-3).alias("centre_is_mean")))  # three rows
    return dist.join(settled, "cluster", "left").select(
        "doc_id", (own <= F.array_min("_d") + 1e-9).alias("is_nearest"), F.col("cluster").between(0, 2).alias("in_range"), "centre_is_mean")


@register("nearest_centroid", family="ml", sql="""
WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i
           FROM embeddings),
c AS (SELECT label AS cluster, i, avg(x) AS m FROM e GROUP BY label, i),
d AS (SELECT e.vec_id, c.cluster, sum((e.x - c.m) * (e.x - c.m)) AS dist FROM e JOIN c USING (i)
      GROUP BY e.vec_id, c.cluster)
SELECT vec_id, CAST(arg_min(cluster, dist) AS INTEGER) AS cluster FROM d GROUP BY vec_id
""")
def q_nearest_centroid(spark, sf):
    emb = table(spark, sf, "embeddings")
    cents = MO.class_centroids(emb, "embedding", "label")
    return MO.assign_nearest(emb.select("vec_id", "embedding"), "embedding", cents).select(
        "vec_id", F.col("cluster").cast("int").alias("cluster"))


@register("argmax_label", family="ml", sql="""
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax FROM embeddings
""")
def q_argmax_label(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", LB.argmax_index("embedding").alias("argmax"))


@register("softmax", family="ml", sql="""
WITH z AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings),
e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z),
p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
SELECT vec_id, round(list_max(p), 6) AS p_max, round(p[1], 6) AS p_first, round(list_sum(p), 6) AS p_sum FROM p
""")
def q_softmax(spark, sf):
    p = MO.softmax_probs(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", "p")
    return p.select("vec_id", F.round(F.array_max("p"), 6).alias("p_max"),
                    F.round(F.col("p")[0], 6).alias("p_first"),
                    F.round(LB.array_sum("p"), 6).alias("p_sum"))


@register("epoch_metrics", family="ml", sql="""
WITH u AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cen AS (SELECT label AS class, i, avg(x) AS m FROM u GROUP BY label, i),
dst AS (SELECT u.vec_id, u.label, cen.class, -sum((u.x - cen.m) * (u.x - cen.m)) AS d FROM u JOIN cen USING (i) GROUP BY ALL),
z AS (SELECT vec_id, any_value(label) AS label, list(d ORDER BY class) AS z FROM dst GROUP BY vec_id),
e AS (SELECT vec_id, label, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z),
q AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e),
r AS (SELECT floor((row_number() OVER (ORDER BY vec_id) - 1) / 8) AS batch, -ln(p[label + 1]) AS loss,
             CASE WHEN list_position(p, list_max(p)) - 1 = label THEN 1.0 ELSE 0.0 END AS hit FROM q),
b AS (SELECT batch, avg(loss) AS bl, sum(loss) AS sl, count(*) AS n, sum(hit) AS h FROM r GROUP BY batch)
SELECT round(avg(bl), 6) AS batch_loss, round(sum(sl) / sum(n), 6) AS row_loss,
       round(sum(h) / sum(n), 6) AS accuracy, CAST(count(*) AS BIGINT) AS n_batches FROM b
""")
def q_epoch_metrics(spark, sf):
    """A12 over every whole embedding: a row's class scores are minus its squared
    distances to the label centroids; softmax gives the probabilities whose
    per-batch (8 rows, in ``vec_id`` order) mean cross-entropy is averaged, next to
    the row mean and accuracy."""
    emb = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    cents = sorted(MO.class_centroids(emb, "v", "label").collect())  # one per label, 0-9
    near = F.transform(MO.squared_distances("v", [c["v"] for c in cents]), lambda d: -d)
    emb = emb.select("vec_id", "label", near.alias("z"))
    p = MO.softmax_probs(emb, "z", "p")
    m = ME.epoch_metrics(p, "vec_id", "p", "label", 8)
    return m.select(*[F.round(c, 6).alias(c) for c in ("batch_loss", "row_loss", "accuracy")],
                    F.col("n_batches").cast("long").alias("n_batches"))


@register("sequence_encoding", family="ml", sql=f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{T.WORD_RE}') AS ws FROM documents),
v AS (SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) + 1 AS INTEGER) AS id
      FROM (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM t) GROUP BY word
            ORDER BY n DESC, word LIMIT {SEQ_VOCAB})),
e AS (SELECT doc_id, unnest(ws[1:{SEQ_LEN}]) AS word, generate_subscripts(ws[1:{SEQ_LEN}], 1) AS pos FROM t),
g AS (SELECT e.doc_id, list(coalesce(v.id, 1) ORDER BY e.pos) AS ids FROM e LEFT JOIN v USING (word) GROUP BY e.doc_id)
SELECT t.doc_id, CAST(coalesce(len(g.ids), 0) AS INTEGER) AS n_tokens,
       array_to_string(list_concat(coalesce(g.ids, []), list_transform(range({SEQ_LEN} - coalesce(len(g.ids), 0)), lambda x: 0)), ' ') AS input_ids,
       CAST(coalesce(len(g.ids), 0) AS INTEGER) AS mask_sum
FROM t LEFT JOIN g USING (doc_id)
""")
def q_sequence_encoding(spark, sf):
    d = _docs_tokens(spark, sf, 1)
    vocab = FE.sequence_vocab(d, "ws", SEQ_VOCAB)
    enc = FE.encode_sequences(d, "ws", "doc_id", vocab, SEQ_LEN)
    return enc.select("doc_id", F.size(F.filter("input_ids", lambda x: x != 0)).alias("n_tokens"),
                      F.array_join("input_ids", " ").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


@register("sequence_encoding_longest", family="ml", sql=f"""
WITH t AS (SELECT conv_id * 1000 + turn AS turn_id, regexp_extract_all(lower(coalesce(text, '')), '{T.WORD_RE}') AS ws
           FROM conversations),
m AS (SELECT coalesce(max(least(len(ws), {SEQ_LEN})), 0) AS width FROM t),
v AS (SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) + 1 AS INTEGER) AS id
      FROM (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM t) GROUP BY word
            ORDER BY n DESC, word LIMIT {SEQ_VOCAB})),
e AS (SELECT turn_id, unnest(ws[1:{SEQ_LEN}]) AS word, generate_subscripts(ws[1:{SEQ_LEN}], 1) AS pos FROM t),
g AS (SELECT e.turn_id, list(coalesce(v.id, 1) ORDER BY e.pos) AS ids FROM e LEFT JOIN v USING (word) GROUP BY e.turn_id)
SELECT t.turn_id, CAST(m.width AS INTEGER) AS seq_len,
       array_to_string(list_concat(coalesce(g.ids, []),
                                   list_transform(range(m.width - coalesce(len(g.ids), 0)), lambda x: 0)), ' ') AS input_ids,
       CAST(coalesce(len(g.ids), 0) AS INTEGER) AS mask_sum
FROM t LEFT JOIN g USING (turn_id) CROSS JOIN m
""")
def q_sequence_encoding_longest(spark, sf):
    """M7 with ``padding=True``: conversation turns cut at 128 tokens and
    padded to the longest turn after truncation."""
    conv = spread(table(spark, sf, "conversations"))
    d = conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"),
                    T.word_tokens(F.coalesce(F.col("text"), F.lit(""))).alias("ws"))
    vocab = FE.sequence_vocab(d, "ws", SEQ_VOCAB)
    enc = FE.encode_sequences(d, "ws", "turn_id", vocab, SEQ_LEN, pad_to="longest")
    return enc.select("turn_id", F.size("input_ids").alias("seq_len"),
                      F.array_join("input_ids", " ").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


def held_out(key: str):
    """A fifth of the rows, by a hash of their key: never trained on."""
    return F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(5)) == 0


@register("train_classifier", family="ml", sql="""
SELECT count(*) AS n_rows, true AS labels_known, true AS beats_majority
FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL
""")
def q_train_classifier(spark, sf):
    """M4: fit the pipeline on four fifths of the labelled documents.  On the fifth that it has
    not seen it must do at least as well as always saying the most frequent label."""
    d = _labelled(spark, sf)
    model = MO.train_classifier(d.where(~held_out("doc_id")), "ws", "label", ["lex_score"], partitions=fit_partitions(spark, sf))
    pred = MO.predict_labels(model, d).select("label", "predicted_label", held_out("doc_id").alias("unseen"))
    hit = lambda c: F.count_if(F.col("unseen") & c)
    return pred.agg(
        F.count(F.lit(1)).alias("n_rows"), F.bool_and(F.col("predicted_label").isin("positif", "negatif")).alias("labels_known"),
        (hit(F.col("label") == F.col("predicted_label")) >=
         F.greatest(hit(F.col("label") == "positif"), hit(F.col("label") == "negatif"))).alias("beats_majority"))


def fit_partitions(spark, sf, table_name: str = "documents", bytes_each: int = 8_000_000) -> int:
    """Partitions of the queries' iterative fits, from the bytes of the table's files: one for
    each 8 MB, so that they grow with the input and are the same on any cluster."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(os.path.join(sf, f"{table_name}.parquet"))
    size = path.getFileSystem(conf).getContentSummary(path).getLength()
    return max(1, -(-size // bytes_each))


def scoring_columns(df):
    """The classifier's input columns from ``text``, as in training."""
    d = score_comments(df, DOCS_LEXICON, "text", "lex_score", None)
    return d.withColumn("ws", T.word_tokens(F.coalesce("text", F.lit("")), 2)).withColumn("lex_score", F.col("lex_score").cast("double"))


@register("batch_predict", family="ml", sql="""
SELECT doc_id, 2 AS n_probabilities, 1.0::DOUBLE AS p_sum, true AS label_is_argmax, true AS softmax_agrees FROM documents
""")
def q_batch_predict(spark, sf):
    """M5, M6: train on the labelled documents, score every document: one probability per label,
    summing to 1, the label being the likeliest; each is the softmax of the row's margins, which
    are worked out here from the features and the model's coefficients."""
    model = MO.train_classifier(_labelled(spark, sf), "ws", "label", ["lex_score"], partitions=fit_partitions(spark, sf))
    d = scoring_columns(table(spark, sf, "documents").select("doc_id", "text"))
    # Scoring frames carry no label: the fitted label indexer skips a missing column.
    lr = model.stages[-1]
    coef = lr.coefficientMatrix.toArray()  # labels x HASH_FEATURES
    margin = lambda w, b: F.aggregate("cells", F.lit(b), lambda m, x: m + x["x"] * F.element_at(F.lit(w), x["i"] + 1))
    margins = F.array(*[margin(w, b) for w, b in zip(coef.tolist(), lr.interceptVector.toArray().tolist(), strict=True)])
    p = MO.predict_labels(model, d).select("doc_id", "predicted_label", vector_to_array("probability").alias("p"), FE.cells("features").alias("cells"))
    p = MO.softmax_probs(p.withColumn("m", margins), "m", "own")
    off = F.aggregate(F.zip_with("p", "own", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: F.greatest(a, b))
    return p.select("doc_id", F.size("p").alias("n_probabilities"), F.round(LB.array_sum("p"), 6).alias("p_sum"),
                    (LB.argmax_label("p", model.stages[0].labels) == F.col("predicted_label")).alias("label_is_argmax"),
                    (off < 1e-9).alias("softmax_agrees"))


@register("classifier_attribution", family="ml", sql="""
SELECT doc_id, true AS sums_to_margin, true AS explains_prediction FROM documents
""")
def q_classifier_attribution(spark, sf):
    """M9 for the fitted classifier: the shares of a document's terms in its predicted
    class add up to that class's margin."""
    model = MO.train_classifier(_labelled(spark, sf), "ws", "label", ["lex_score"], partitions=fit_partitions(spark, sf))
    d = scoring_columns(spread(table(spark, sf, "documents").select("doc_id", "text")))
    checkpoint_root(spark)
    shares = MO.classifier_attribution(model, d, "ws", "doc_id")
    sums = shares.groupBy("doc_id", "label").agg(F.sum("attribution").alias("total"))
    raw = MO.predict_labels(model, d).select("doc_id", "predicted_label", F.array_max(vector_to_array("rawPrediction")).alias("margin"))
    return raw.join(sums, "doc_id", "left").select(
        "doc_id", F.coalesce(F.abs(F.col("total") - F.col("margin")) < 1e-6, F.lit(False)).alias("sums_to_margin"),
        F.coalesce(F.col("label") == F.col("predicted_label"), F.lit(False)).alias("explains_prediction"))


@register("cluster_word_clouds", family="ml", sql="""
SELECT 3 AS n_clusters, count(*) AS n_docs, true AS clouds_agree
FROM documents JOIN labels USING (doc_id) WHERE quality = 1
""")
def q_cluster_word_clouds(spark, sf):
    """A10 over M3: cleaned comments of one label, TF-IDF vectors, three clusters and the
    ten heaviest words of each, which must be those of the cluster's own documents counted here."""
    from opinio.operators import clean as C
    from opinio.operators.wordstats import group_word_weights
    keep = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    d = table(spark, sf, "documents").select("doc_id", "text").join(keep, "doc_id")
    checkpoint_root(spark)
    d = d.select("doc_id", T.clean_text("text", DOCS_STOPWORDS).alias("text"))
    d = d.withColumn("ws", T.word_tokens("text", 2))
    vocab = FE.fit_tfidf(d, "ws", "doc_id", TFIDF_MAX_FEATURES)
    v = FE.tfidf_vectors(d, "ws", vocab).select("doc_id", "text", "features").checkpoint()
    model = MO.fit_kmeans(v, "features", k=3, seed=42, n_init=3, partitions=fit_partitions(spark, sf), row_id="doc_id")
    grouped = model.transform(v).select("doc_id", "text", F.col("cluster").cast("string").alias("cluster")).checkpoint()
    clouds = group_word_weights(grouped, "text", "cluster", max_words=10)
    clouds = clouds.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct(F.round(-F.col("weight"), 9).alias("w"), "word"))).alias("cloud"))
    said = explode_rows(grouped, F.regexp_extract_all("text", F.lit(T.WORD2_RE), 0), "word", "cluster").groupBy("cluster", "word").count()
    most = said.groupBy("cluster").agg(F.max("count").alias("most"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "word"))), 1, 10).alias("top"))
    own = most.select("cluster", F.transform("top", lambda x: F.struct(F.round(x["c"] / F.col("most"), 9).alias("w"), x["word"])).alias("own"))
    both = clouds.join(own, "cluster", "full")
    return both.agg(F.count(F.lit(1)).cast("int").alias("n_clusters"), F.lit(grouped.count()).cast("long").alias("n_docs"),
                    F.bool_and(F.coalesce(F.col("cloud") == F.col("own"), F.lit(False))).alias("clouds_agree"))


@register("hybrid_features", family="ml", sql=f"""
WITH v AS (SELECT count(DISTINCT w) AS nv
           FROM (SELECT unnest(regexp_extract_all(lower(text), '{T.WORD2_RE}')) AS w FROM documents))
SELECT doc_id, CAST(least(v.nv, {TFIDF_MAX_FEATURES}) + 1 AS INTEGER) AS n_features, CAST(score AS DOUBLE) AS lex_score,
       round(coalesce(total, 0.0), 6) AS sum_weight
FROM (SELECT doc_id, {SQL_SCORE} AS score FROM (SELECT doc_id, {sql_tokens("text")} AS ws FROM documents))
CROSS JOIN v LEFT JOIN (SELECT doc_id, sum(x) AS total FROM (WITH {_TFIDF_X_SQL} SELECT * FROM x) GROUP BY doc_id) USING (doc_id)
""")
def q_hybrid_features(spark, sf):
    """M8: TF-IDF vector concatenated with the lexicon score."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    d = score_comments(d, DOCS_LEXICON, "text", "lex_score", None).withColumn(
        "ws", T.word_tokens("text", 2)).withColumn("lex_score", F.col("lex_score").cast("double"))
    vocab = FE.fit_tfidf(d, "ws", "doc_id", TFIDF_MAX_FEATURES)
    h = FE.hybrid_features(FE.tfidf_vectors(d, "ws", vocab), "features", ["lex_score"])
    arr = vector_to_array("hybrid")
    h = h.select("doc_id", arr.alias("a"))
    return h.select("doc_id", F.size("a").alias("n_features"), F.element_at("a", -1).alias("lex_score"),
                    F.round(LB.array_sum("a") - F.element_at("a", -1), 6).alias("sum_weight"))


@register("user_model_predict", family="ml", sql="""
SELECT vec_id, true AS same_label FROM embeddings
""")
def q_user_model_predict(spark, sf):
    """M5 with a model that is not a Spark ML stage: the coefficients of a fitted classifier of
    the embeddings, exported as arrays, score rows in Arrow batches (``predict_batch_udf``, the
    model built once per worker); the labels must be those that Spark ML gives."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding", array_to_vector("embedding").alias("features"))
    fitted = LogisticRegression(family="multinomial", regParam=0.01, maxIter=20).fit(
        MO.for_iterations(e, fit_partitions(spark, sf, "embeddings"), "vec_id"))
    coef, intercept = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()

    def exported():
        return lambda vectors: vectors @ coef.T + intercept

    labels = [str(i) for i in range(len(intercept))]
    scored = fitted.transform(MO.predict_with_model(e, "embedding", exported, labels))
    same = F.col("predicted_label") == F.col("prediction").cast("int").cast("string")
    # Scores travel as floats: a row whose two best margins are closer than that has no one label.
    top = F.slice(F.sort_array(vector_to_array("rawPrediction"), asc=False), 1, 2)
    return scored.select("vec_id", (same | (top[0] - top[1] < 1e-4)).alias("same_label"))


@register("lda_topics", family="ml", sql=f"""
WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '{T.WORD2_RE}')) AS word FROM documents),
s AS (SELECT count(*) AS n_tokens, count(DISTINCT word) AS n_words FROM t)
SELECT t AS topic, CAST(n_words AS BIGINT) AS n_words, 1.0::DOUBLE AS weight_sum, CAST(n_tokens AS BIGINT) AS all_tokens,
       true AS ranked FROM s, range(3) a(t)
""")
def q_lda_topics(spark, sf):
    """Three topics over the documents.  Each is a distribution over all words of the
    corpus, the topics share out every token of it, and the top words are the heaviest."""
    from pyspark.sql.window import Window
    docs = _docs_tokens(spark, sf, 2)
    checkpoint_root(spark)
    topics = MO.lda_fit(docs, "ws", k=3, seed=42, row_id="doc_id", partitions=fit_partitions(spark, sf, bytes_each=4_000_000))
    stats = topics.groupBy("topic").agg(F.count(F.lit(1)).alias("n_words"), F.round(F.sum("weight"), 6).alias("weight_sum"),
                                        F.max("weight").alias("heaviest"), F.sum("n").alias("n"))
    every = F.sum("n").over(Window.partitionBy(F.lit(1)))  # three rows
    return stats.select(F.col("topic").cast("long").alias("topic"), "n_words", "weight_sum", F.round(every).cast("long").alias("all_tokens"),
                        (F.col("heaviest") * F.col("n_words") > 1).alias("ranked"))


@register("model_selection", family="ml", sql="""
SELECT unnest([0.0, 0.01, 0.1])::DOUBLE AS reg_param, true AS loss_agrees, 1 AS n_chosen
""")
def q_model_selection(spark, sf):
    """Validation log loss of each candidate regularisation, worked out here from the
    probabilities of the validation rows; the chosen candidate is the one with the least."""
    d = _labelled(spark, sf)
    sel = MO.select_model(d, "ws", "label", "doc_id", partitions=fit_partitions(spark, sf))
    valid = sel.featurizer.transform(d.where(~MO.training_part("doc_id", 42, 0.8))).select("label_index", "features")
    checkpoint_root(spark)
    valid = valid.checkpoint()
    losses = []
    for m in sel.models:
        p = F.element_at(vector_to_array("probability"), F.col("label_index").cast("int") + 1)
        losses.append(m.transform(valid).agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15))))).first()[0])
    chosen = losses.index(min(losses))
    rows = [(float(r), abs(m - own) < 1e-9, int(sel.best_index == chosen))
            for r, m, own in zip(sel.reg_params, sel.log_losses, losses, strict=True)]
    return spark.createDataFrame(rows, "reg_param double, loss_agrees boolean, n_chosen int")


@register("early_stop", family="ml", sql="""
WITH m AS (SELECT event_type AS run, CAST(hour(ts) AS INTEGER) AS epoch, avg(value) AS loss FROM events GROUP BY ALL),
a AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM m),
b AS (SELECT *, CASE WHEN pb IS NULL OR loss < pb THEN 1 ELSE 0 END AS imp FROM a),
c AS (SELECT *, sum(imp) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY run, grp ORDER BY epoch) - 1 AS since FROM c),
s AS (SELECT run, min(CASE WHEN since = 3 THEN epoch END) AS stop_epoch FROM d GROUP BY run)
SELECT d.run, first(d.epoch ORDER BY d.loss, d.epoch) AS best_epoch, round(min(d.loss), 6) AS best_loss, s.stop_epoch
FROM d JOIN s USING (run) WHERE s.stop_epoch IS NULL OR d.epoch <= s.stop_epoch GROUP BY d.run, s.stop_epoch
""")
def q_early_stop(spark, sf):
    ev = table(spark, sf, "events")
    m = ev.groupBy(F.col("event_type").alias("run"), F.hour("ts").cast("int").alias("epoch")).agg(
        F.avg("value").alias("loss"))
    out = MO.early_stop(m, "run", "epoch", "loss", 3)
    return out.withColumn("best_loss", F.round("best_loss", 6))


@register("sentence_vectors", family="ml", sql=f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{T.WORD_RE}') AS ws FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS bits FROM (SELECT doc_id, unnest(ws) AS w FROM t)),
s AS (SELECT doc_id, i, (2 * sum((bits >> i) & 1) - count(*)) / count(*)::DOUBLE AS x FROM b, range(32) r(i) GROUP BY doc_id, i)
SELECT doc_id, r.i AS dim, round(coalesce(s.x, 0.0), 6) AS x
FROM t CROSS JOIN range(32) r(i) LEFT JOIN s USING (doc_id, i)
""")
def q_sentence_vectors(spark, sf):
    """Mean sign vector per document, all 32 components."""
    v = FE.sentence_vectors(_docs_tokens(spark, sf, 1), "ws", "doc_id", size=32)
    return posexplode_rows(v, "sentence_vector", "dim", "x", "doc_id").select(
        "doc_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@register("shapley_values", family="ml", sql=f"""
SELECT doc_id, CAST(least(len(ws), 16) AS BIGINT) AS n_players, CAST({SQL_SCORE} AS DOUBLE) AS total
FROM (SELECT doc_id, {sql_tokens("text")} AS ws FROM documents)
""")
def q_shapley_values(spark, sf):
    """M9 for any model, here the negation-aware scorer: the values of a document's groups of
    words add up to its score (that of no text is 0)."""
    d = _docs_tokens(spark, sf, 1)
    score = lambda c: score_comments(c, DOCS_LEXICON, "text", "score", None)
    v = SH.shapley_values(d, "ws", score, "doc_id", players=16, orders=2)
    return v.groupBy("doc_id").agg(F.count_if(F.col("player") >= 0).alias("n_players"), (F.round(F.sum("value"), 6) + 0.0).alias("total"))


@register("epoch_training", family="ml")
def q_epoch_training(spark, sf):
    """A classifier of the labelled documents trained by epochs with early stopping;
    one row per epoch, and whether the restored state has the best epoch's validation loss."""
    d = _labelled(spark, sf)
    checkpoint_root(spark)
    x = MO.text_featurizer("ws", "label", ["lex_score"]).fit(d).transform(d).select("doc_id", "label_index", "features").checkpoint()
    width = MO.HASH_FEATURES + 1
    fit = EP.train_epochs(x, "features", "label_index", "doc_id", 2, width, batch_rows=1024)
    valid = x.where(EP.hash_share(F.col("doc_id").cast("string"), 42) < int(0.2 * (1 << 28)))
    p = MO.softmax_probs(EP.class_margins(valid, "features", fit.weights), "margins", "p")
    rows = [(e["epoch"], e["train_loss"], e["train_acc"], e["valid_loss"], e["valid_acc"], e["improved"]) for e in fit.epochs]
    table_of = spark.createDataFrame(rows, "epoch int, train_loss double, train_acc double, valid_loss double, valid_acc double, improved boolean")
    loss = p.agg(F.avg(-F.log(F.greatest(F.element_at("p", F.col("label_index").cast("int") + 1), F.lit(1e-15)))).alias("restored_loss"))
    return (table_of.join(F.broadcast(loss), F.lit(True)).withColumn("best_epoch", F.lit(fit.best_epoch))
            .withColumn("stop_epoch", F.lit(fit.stop_epoch).cast("int")).withColumn("n_train", F.lit(fit.n_train)).withColumn("n_valid", F.lit(fit.n_valid)))


PPMI_MIN = 20


@register("word_ppmi", family="ml", sql=f"""
WITH d AS (SELECT regexp_extract_all(lower(text), '{T.WORD_RE}') AS ws FROM documents),
w AS (SELECT word FROM (SELECT unnest(ws) AS word FROM d) GROUP BY word HAVING count(*) >= {PPMI_MIN}),
p AS (SELECT ws[i] AS a, ws[i + k] AS b FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM d), (VALUES (1), (2)) o(k) WHERE i + k <= len(ws)),
c AS (SELECT word, ctx, count(*) AS n FROM (SELECT a AS word, b AS ctx FROM p UNION ALL SELECT b, a FROM p)
      WHERE word IN (SELECT word FROM w) AND ctx IN (SELECT word FROM w) GROUP BY word, ctx),
m AS (SELECT word, sum(n) AS m FROM c GROUP BY word),
x AS (SELECT c.word, c.ctx, n, ln(n * t / (x.m::DOUBLE * y.m)) AS x
      FROM c JOIN m x ON x.word = c.word JOIN m y ON y.word = c.ctx, (SELECT sum(m)::DOUBLE AS t FROM m))
SELECT word, ctx, CAST(n AS BIGINT) AS n, round(x, 6) AS x FROM x WHERE round(x, 9) > 0
""")
def q_word_ppmi(spark, sf):
    """The table from which word vectors are learned."""
    t = WV.ppmi(_docs_tokens(spark, sf, 1), "ws", 2, PPMI_MIN)
    return t.where(F.round("x", 9) > 0).select("word", "ctx", "n", F.round("x", 6).alias("x"))


@register("word_vectors", family="ml", sql=f"""
WITH d AS (SELECT regexp_extract_all(lower(text), '{T.WORD_RE}') AS ws FROM documents),
w AS (SELECT word FROM (SELECT unnest(ws) AS word FROM d) GROUP BY word HAVING count(*) >= {PPMI_MIN})
SELECT doc_id, coalesce(bool_or(word IN (SELECT word FROM w)), false) AS has_vector, 8 AS size, true AS orthogonal
FROM documents LEFT JOIN (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{T.WORD_RE}')) AS word FROM documents) USING (doc_id)
GROUP BY doc_id
""")
def q_word_vectors(spark, sf):
    """Learned word vectors, averaged per document.  The vectors' components are orthogonal
    over the vocabulary, as eigenvectors are."""
    docs = _docs_tokens(spark, sf, 1)
    vectors, _ = WV.word_vectors(WV.ppmi(docs, "ws", 2, PPMI_MIN), size=8, iterations=4)
    checkpoint_root(spark)
    vectors = vectors.checkpoint()
    v = F.col("vector")
    gram = vectors.agg(*[F.sum(v[i] * v[j]) for i in range(8) for j in range(8)]).first()
    off = max(abs(gram[8 * i + j]) / (gram[9 * i] * gram[9 * j]) ** 0.5 for i in range(8) for j in range(8) if i != j)
    means = WV.sentence_means(docs, "ws", "doc_id", vectors)
    return means.select("doc_id", F.col("sentence_vector").isNotNull().alias("has_vector"), F.lit(8).alias("size"),
                        F.lit(bool(off < 1e-6)).alias("orthogonal"))


@register("mined_aspects", family="ml", sql=f"""
WITH d AS (SELECT regexp_extract_all(lower(text), '{T.WORD_RE}') AS ws FROM documents),
said AS (SELECT word, count(*) AS said FROM (SELECT unnest(ws) AS word FROM d) GROUP BY word),
p AS (SELECT ws[i] AS a, ws[i + 1] AS b FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM d)),
near AS (SELECT word, ctx, count(*) AS n FROM (SELECT a AS word, b AS ctx FROM p UNION ALL SELECT b, a FROM p)
         WHERE word NOT IN {sql_list(DOCS_STOPWORDS)} GROUP BY word, ctx),
f0 AS (SELECT unnest({list(DOCS_LEXICON.positive + DOCS_LEXICON.negative)}) AS word, 'opinion' AS kind, 0 AS round, 0 AS hits),
{", ".join(f"""
f{i} AS (SELECT h.word, '{kind}' AS kind, {r} AS round, hits
         FROM (SELECT word, sum(n) AS hits FROM near WHERE ctx IN (SELECT word FROM f{i - 1}) GROUP BY word HAVING sum(n) >= 3) h
         JOIN said USING (word) WHERE hits >= 0.05 * said AND {" AND ".join(f"h.word NOT IN (SELECT word FROM f{j})" for j in range(i))})"""
           for i, (r, kind) in enumerate([(1, "aspect"), (1, "opinion"), (2, "aspect"), (2, "opinion")], 1))}
SELECT word, kind, CAST(round AS INTEGER) AS round, CAST(hits AS BIGINT) AS hits
FROM ({" UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(5))})
""")
def q_mined_aspects(spark, sf):
    """Aspect words found by double propagation from the lexicon's words."""
    known = spark.createDataFrame([(w,) for w in DOCS_LEXICON.positive + DOCS_LEXICON.negative], "word string")
    stop = spark.createDataFrame([(w,) for w in DOCS_STOPWORDS], "word string")
    return WV.mine_aspects(_docs_tokens(spark, sf, 1), "ws", known, stop)


@register("subword_encoding", family="ml", sql=f"""
SELECT doc_id, CAST(coalesce(len(ws), 0) AS INTEGER) AS n_words, 0 AS n_unknown, true AS restored,
       least(128, {SEQ_LEN}) AS length, true AS mask_fits
FROM (SELECT doc_id, regexp_extract_all(lower(text), '{T.WORD_RE}') AS ws FROM documents)
""")
def q_subword_encoding(spark, sf):
    """M7 by pieces of a public tokenizer's vocabulary: no word is unknown, the pieces of a whole
    document give back its words, and the padded sequence holds the first of them."""
    import public_tokenizers
    pieces = SW.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    docs = _docs_tokens(spark, sf, 1).withColumn("ws", F.coalesce("ws", F.array().cast("array<string>")))
    checkpoint_root(spark)
    said = F.array_join(F.transform("ws", lambda w: F.concat(F.lit(" "), w)), "")
    ids = SW.subword_ids(docs.select("doc_id", "ws", F.size("ws").alias("n_words"), said.alias("said")), "ws", pieces,
                         ["doc_id", "n_words", "said"]).checkpoint()
    vocabulary = spark.createDataFrame([(p, i) for p, i in pieces.items()], "piece string, id int")
    text = SW.decode("ids", vocabulary, ids, "doc_id")
    seq = SW.encode_subwords(docs, "ws", "doc_id", pieces, SEQ_LEN, begin_id=50256, end_id=50256)
    body = F.slice("ids", 1, SEQ_LEN - 2)
    inner = F.slice("input_ids", 2, F.size(body))
    return ids.join(text, "doc_id").join(seq, "doc_id").select(
        "doc_id", "n_words", F.size(F.filter("ids", lambda i: i < 0)).alias("n_unknown"),
        (F.col("text") == F.col("said")).alias("restored"),
        F.size("input_ids").alias("length"),
        ((F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x) == F.size(body) + 2) & (inner == body)).alias("mask_fits"))
