"""Clustering, classification, prediction, attribution and model selection
(M3-M6, M9-M11), re-aimed to Spark ML and DataFrame jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from opinio.functions import labels as LB
from opinio.functions.arrays import explode_rows
from opinio.functions.text import word_tokens
from opinio.operators.arrowcounts import row_word_counts
from opinio.operators.features import cells
from opinio.operators.metrics import dense_index
from opinio.session import checkpoint_root, release_shuffles, remove_path, work_dir
from opinio.sources.tables import bounded_broadcast


#: Dimensions of hashed term counts.  Hashing keeps every word of the corpus (rare ones may
#: share a dimension) and needs neither a vocabulary job nor a vocabulary on the driver.
HASH_FEATURES = 1 << 12
#: Centroids or class totals that are held in the plan at once; more go in blocks.
CLASS_BLOCK = 10_000


def for_iterations(df: DataFrame, partitions: int | None, key: str | None = None) -> DataFrame:
    """``df`` in ``partitions`` for an iterative fit, if given.

    The partition count is the caller's choice (from the input's bytes, say).  With ``key``
    rows are dealt by its hash and ordered by it, so that seeding and summation do not depend
    on how the input happened to be split, nor on the number of cores.
    """
    if partitions is None:
        return df
    if key is None:
        return df.coalesce(partitions)
    return df.repartition(partitions, key).sortWithinPartitions(key)


def lexicon_attribution(df: DataFrame, polarity: DataFrame, negators: DataFrame,
                        text_col: str = "comment", row_id: str = "row_id") -> DataFrame:
    """M9 (lexicon scorer): ``(row_id, word, contribution, occurrences)`` -- the
    signed share of each polar word in its row's score.  Only lexicon hits are
    shuffled (pre-aggregated per task)."""
    toks = df.select(row_id, word_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("_ws"))
    pairs = explode_rows(toks, F.zip_with(
        "_ws", F.concat(F.array(F.lit(None).cast("string")), F.col("_ws")),
        lambda w, p: F.struct(w.alias("word"), p.alias("prev"))), "t", row_id).select(row_id, "t.word", "t.prev")
    pol = bounded_broadcast(polarity.select("word", F.col("polarity").cast("int").alias("polarity")))
    neg = bounded_broadcast(negators.select(F.col("word").alias("prev")).distinct()).withColumn("_neg", F.lit(-1))
    hits = pairs.join(pol, "word").join(neg, "prev", "left")
    return hits.groupBy(row_id, "word").agg(
        F.sum(F.col("polarity") * F.coalesce("_neg", F.lit(1))).cast("long").alias("contribution"),
        F.count(F.lit(1)).cast("long").alias("occurrences"))


# ------------------------------------------------------------ M3 / M3b
def fit_kmeans(df: DataFrame, features_col: str = "features", k: int = 3, seed: int = 42,
               n_init: int = 10, max_iter: int = 300, parallelism: int = 8, partitions: int | None = None,
               row_id: str | None = None):
    """M3: k-means with ``n_init`` seeded starts (seed, seed+1, ...), keeping
    the model with the lowest within-cluster cost (the first start on ties).

    Each fit is a distributed Lloyd iteration; only k centroids travel to the
    driver.  Up to ``parallelism`` starts run as concurrent Spark jobs (as
    ``TrainValidationSplit`` fits its candidates): a start's per-iteration
    jobs are short, so running them side by side keeps the executors busy.
    """
    from pyspark.ml.clustering import KMeans
    # The starts share one persisted copy of the vectors (recomputed from
    # the source if an executor is lost) instead of re-deriving them.
    cached = for_iterations(df.select(features_col, *([row_id] if row_id else [])), partitions, row_id).persist()
    points = cached

    def one(i):
        model = KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol=features_col,
                       predictionCol="cluster").fit(points)
        return model.summary.trainingCost, i, model

    try:
        fits = _concurrent(one, range(n_init), parallelism, df.sparkSession)
    finally:
        cached.unpersist()
    return min(fits, key=lambda f: (f[0], f[1]))[2]


def _concurrent(fn, items, parallelism: int, spark):
    """``[fn(x) for x in items]`` with up to ``parallelism`` items submitting
    Spark jobs at once (threads inherit the caller's job properties)."""
    from concurrent.futures import ThreadPoolExecutor
    from pyspark.util import inheritable_thread_target
    items = list(items)
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fn), items))


def class_centroids(df: DataFrame, vec_col: str, class_col: str) -> DataFrame:
    """``(class, v)``: per-class mean vectors, aggregated distributedly over
    ``(class, position)``; written once, since assignment reads it in blocks."""
    checkpoint_root(df.sparkSession)
    per_dim = (df.select(F.col(class_col).alias("class"), F.posexplode(F.col(vec_col).cast("array<double>")).alias("i", "x"))
               .groupBy("class", "i").agg(F.avg("x").alias("m")))
    vectors = per_dim.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))
    return vectors.select("class", F.transform("v", lambda s: s["m"]).alias("v")).checkpoint()


def blocks_of(df: DataFrame, key: str, size: int = CLASS_BLOCK):
    """Rows of a small-per-block table, about ``size`` at a time, ordered by ``key``."""
    n = df.count()
    blocks = max(1, -(-n // size))
    for k in range(blocks):
        part = df if blocks == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k)
        yield sorted(part.collect(), key=lambda r: (r[key] is None, r[key]))


def squared_distances(vec_col: str, vectors) -> Column:
    """Array of squared Euclidean distances of a vector column to given vectors."""
    cents = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in vectors])
    return F.transform(cents, lambda c: F.aggregate(
        F.zip_with(vec_col, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


#: Centroids searched at once, in bytes of their components; more go in passes.
CENTROID_BYTES = 1 << 26
#: Rows and centroids that are compared at once.
NEAR_ROWS, NEAR_CENTROIDS = 512, 1024


class Nearest:
    """The nearest of broadcast centroids per row, pruned by the triangle inequality.

    Centroids are ordered by their norms and searched in runs, those of the nearest norms
    first.  Two vectors are at least as far apart as their norms differ, so a run whose norms
    differ from a row's by more than the best distance so far is passed over.
    """

    def __init__(self, block):
        self.block = block

    def __call__(self, batches):
        import numpy as np
        import pyarrow as pa
        centres = self.block.value  # in the order of their classes
        norms = np.sqrt((centres * centres).sum(axis=1))
        order = np.argsort(norms, kind="stable")
        runs = [order[i:i + NEAR_CENTROIDS] for i in range(0, len(order), NEAR_CENTROIDS)]
        low, high = np.array([norms[r[0]] for r in runs]), np.array([norms[r[-1]] for r in runs])
        for b in batches:
            there = b.column("_v").is_valid().to_numpy(zero_copy_only=False)
            x = b.column("_v").drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, centres.shape[1])
            own = np.sqrt((x * x).sum(axis=1))
            best, found = np.full(len(x), np.inf), np.full(len(x), -1)
            by_norm = np.argsort(own, kind="stable")
            for rows in (by_norm[i:i + NEAR_ROWS] for i in range(0, len(x), NEAR_ROWS)):
                gaps = np.maximum(np.maximum(low[:, None] - own[rows], own[rows] - high[:, None]), 0)  # runs x rows
                for r in np.argsort(gaps.min(axis=1), kind="stable"):
                    open_ = rows[gaps[r] ** 2 <= best[rows] * (1 + 1e-9)]
                    if not len(open_):
                        continue
                    about = own[open_, None] ** 2 + norms[runs[r]] ** 2 - 2 * x[open_] @ centres[runs[r]].T
                    slack = 1e-9 * (own[open_] ** 2 + high[r] ** 2 + 1)
                    near = about <= (np.minimum(about.min(axis=1), best[open_]) + slack)[:, None]
                    i, j = np.nonzero(near)  # the few whose exact distance decides, least class on ties
                    at, c = open_[i], runs[r][j]
                    exact = ((x[at] - centres[c]) ** 2).sum(axis=1)
                    for k in np.lexsort((c, exact)):
                        if (exact[k], c[k]) < (best[at[k]], found[at[k]]) or found[at[k]] < 0:
                            best[at[k]], found[at[k]] = exact[k], c[k]
            d, n = np.full(b.num_rows, np.inf), np.full(b.num_rows, -1)
            d[there], n[there] = best, found
            names = [c for c in b.schema.names if c != "_v"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], b.column("_v"), pa.array(d), pa.array(n.astype("int64"))],
                                             [*names, "_v", "_d", "_n"])


def assign_nearest(df: DataFrame, vec_col: str, centroids: DataFrame, out: str = "cluster") -> DataFrame:
    """Nearest centroid by squared Euclidean distance (least class on ties).

    ``centroids`` is ``(class, v)``, all of one length.  They are broadcast as a matrix, in blocks
    of bounded size, so the plan is the same for any number of classes; each row's best is
    carried from block to block.  A null vector, one with a null component or of another
    length, has a null cluster.
    """
    import numpy as np
    spark = df.sparkSession
    width = centroids.agg(F.max(F.size("v"))).first()[0]
    kind = centroids.schema["class"].dataType
    if not width:
        return df.withColumn(out, F.lit(None).cast(kind))
    vec = F.col(vec_col).cast("array<double>")
    usable = (F.size(vec) == width) & ~F.exists(vec, lambda x: x.isNull())
    best = df.withColumn("_v", F.when(usable, vec)).withColumn("_best", F.lit(None).cast(f"struct<d:double,c:{kind.simpleString()}>"))
    for k, rows in enumerate(blocks_of(centroids, "class", max(1, CENTROID_BYTES // (8 * width)))):
        if not rows:
            continue
        block = spark.sparkContext.broadcast(np.array([r["v"] for r in rows], dtype=float))
        classes = spark.createDataFrame([(i, r["class"]) for i, r in enumerate(rows)], StructType(
            [StructField("_n", LongType()), StructField("_class", kind)]))
        names = best.drop("_v").columns
        schema = StructType([*[best.schema[c] for c in names], best.schema["_v"], StructField("_d", DoubleType()), StructField("_n", LongType())])
        found = best.select(*names, "_v").mapInArrow(Nearest(block), schema).join(F.broadcast(classes), "_n", "left")  # a bounded block
        here = F.when(F.col("_n") >= 0, F.struct(F.col("_d").alias("d"), F.col("_class").alias("c")))
        best = found.withColumn("_best", F.least("_best", here)).drop("_d", "_n", "_class")
        if k:  # blocks after the first: not all are to be live at once
            checkpoint_root(spark)
            best = best.checkpoint()
    return best.select(*[c for c in df.columns if c != out], F.col("_best.c").alias(out))


# ------------------------------------------------------------ M4 / M5
def text_featurizer(ws_col: str, label_col: str, extra_cols: Sequence[str] = (), n_features: int = HASH_FEATURES):
    """Unfitted stages: label codes, hashed term counts, IDF, L2 norm (+ extra features)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, IDF, Normalizer, StringIndexer, VectorAssembler
    return Pipeline(stages=[
        StringIndexer(inputCol=label_col, outputCol="label_index", stringOrderType="alphabetAsc"),
        HashingTF(inputCol=ws_col, outputCol="_tf", numFeatures=n_features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(p=2.0, inputCol="_idf", outputCol="_text_vec"),
        VectorAssembler(inputCols=["_text_vec", *extra_cols], outputCol="features", handleInvalid="keep"),
    ])


def train_classifier(df: DataFrame, ws_col: str, label_col: str, extra_cols: Sequence[str] = (),
                     n_features: int = HASH_FEATURES, reg_param: float = 0.01, max_iter: int = 100,
                     partitions: int | None = None):
    """M4: hashed term counts -> IDF -> L2 Normalizer -> (+ extra features) ->
    multinomial logistic regression, returned as one ``PipelineModel``.

    Only the columns that the stages read are kept; the per-row vectors are
    persisted for the iterations (recomputed if an executor is lost).
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    lr = LogisticRegression(family="multinomial", labelCol="label_index", featuresCol="features",
                            regParam=reg_param, maxIter=max_iter)
    cached = df.select(ws_col, label_col, *extra_cols).persist()
    try:
        feat = text_featurizer(ws_col, label_col, extra_cols, n_features).fit(cached)
        x = feat.transform(cached).select("label_index", "features").persist()
        try:
            model = lr.fit(for_iterations(x, partitions))
        finally:
            x.unpersist()
    finally:
        cached.unpersist()
    return PipelineModel(stages=[*feat.stages, model])


def predict_labels(model, df: DataFrame, out: str = "predicted_label") -> DataFrame:
    """M5, M6: batch or stream scoring with a fitted pipeline; appends the label
    string next to the model's ``probability`` vector (one entry per label)."""
    from pyspark.ml.feature import IndexToString
    labels = model.stages[0].labels
    scored = model.transform(df)
    return IndexToString(inputCol="prediction", outputCol=out, labels=labels).transform(scored)


def softmax_probs(df: DataFrame, scores_col: str, out: str = "probability") -> DataFrame:
    """M6: softmax of a score array; each intermediate is its own column so
    the max and the sum are computed once per row, not once per element."""
    from opinio.functions.labels import array_sum, divide_by, shifted_exp
    return (df.withColumn("_m", F.array_max(F.col(scores_col).cast("array<double>")))
            .withColumn("_e", shifted_exp(scores_col, "_m"))
            .withColumn("_s", array_sum("_e"))
            .withColumn(out, divide_by("_e", "_s"))
            .drop("_m", "_e", "_s"))


# ---------------------------------------------------------------- M9
def linear_attribution(weights: DataFrame, coefs: DataFrame, means: DataFrame,
                       row_id: str = "row_id", rows: DataFrame | None = None) -> DataFrame:
    """M9 (linear model): exact attribution ``coef[c, w] * (x[d, w] - mean[w])`` for the words
    present in a row, plus one baseline term (word null) per row for the absent words,
    ``-sum coef * mean`` over them; ``(row_id, class, word, attribution)``.

    ``weights(row_id, word, x)``, ``coefs(class, word, coef)``, ``means(word, mean)``.  Without
    ``rows`` each row that has a word is explained for each class.  ``rows(row_id, class)`` names
    the classes a row is explained for -- its own, say -- and also gives the baseline of rows
    without any vocabulary word; nothing is made for other classes.  Coefficients are per
    vocabulary word and class and broadcast after a size check.
    """
    checkpoint_root(weights.sparkSession)
    cm = bounded_broadcast(coefs.join(means, "word").checkpoint())  # read several times below
    full_base = bounded_broadcast(cm.groupBy("class").agg(F.sum(-F.col("coef") * F.col("mean")).alias("_all")).checkpoint())
    if rows is None:
        hits = weights.join(cm, "word")
    else:
        hits = weights.join(rows, row_id).join(cm, ["class", "word"])
    present = hits.select(
        row_id, "class", "word", (F.col("coef") * (F.col("x") - F.col("mean"))).alias("attribution"))
    present_base = hits.groupBy(row_id, "class").agg(F.sum(-F.col("coef") * F.col("mean")).alias("_present"))
    asked = present_base if rows is None else rows.join(present_base, [row_id, "class"], "left")
    base = asked.join(full_base, "class").select(
        row_id, "class", F.lit(None).cast("string").alias("word"),
        (F.col("_all") - F.coalesce(F.col("_present"), F.lit(0.0))).alias("attribution"))
    return present.unionByName(base)


def classifier_attribution(model, df: DataFrame, ws_col: str, row_id: str = "row_id") -> DataFrame:
    """M9 for a fitted text classifier: ``(row_id, label, term_index, attribution)``, the share
    of each term dimension in the margin of the row's *predicted* class; a row's
    shares and the class intercept (``term_index`` -1) sum to that margin.

    Per row over the non-zero cells of its vector: no shuffle, no rows x classes output.
    Terms are hash dimensions (``HashingTF.indexOf`` gives a word's).
    """
    lr = model.stages[-1]
    coef = lr.coefficientMatrix.toArray()
    sc = df.sparkSession.sparkContext
    weights = sc.broadcast((coef, lr.interceptVector.toArray()))  # classes x HASH_FEATURES doubles

    def explain(batches):
        import numpy as np
        import pyarrow as pa
        c, b = weights.value
        for batch in batches:
            rows, terms, values = [], [], []
            for i, (k, own) in enumerate(zip(batch.column("_class").to_pylist(), batch.column("_cells").to_pylist(), strict=True)):
                at = [x["i"] for x in own]
                share = c[int(k), np.array(at, int)] * np.array([x["x"] for x in own], float)
                rows += [i] * (len(at) + 1)
                terms += [-1, *at]
                values += [float(b[int(k)]), *share.tolist()]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(row_id).take(at), batch.column("predicted_label").take(at), pa.array(terms, pa.int32()),
                 pa.array(values, pa.float64())], [row_id, "label", "term_index", "attribution"])

    scored = predict_labels(model, df).select(row_id, "predicted_label", F.col("prediction").alias("_class"), cells("features").alias("_cells"))
    kind = dict(df.dtypes)[row_id]
    return scored.mapInArrow(explain, f"`{row_id}` {kind}, label string, term_index int, attribution double")


# --------------------------------------------------------------- M10
def lda_topics(df: DataFrame, ws_col: str, k: int = 3, seed: int = 42, vocab_size: int | None = None,
               max_iter: int = 10, top_terms: int = 10, row_id: str | None = None):
    """Topic model (declared in the original workflow, never coded); returns
    ``(topic, rank, weight, word)``, the ``top_terms`` heaviest words of each topic.

    See :func:`lda_fit`; every word of the corpus is a term, unless ``vocab_size`` keeps only so
    many of the most frequent ones.
    """
    topics = lda_fit(df, ws_col, k, seed, vocab_size, max_iter, row_id)
    order = Window.partitionBy("topic").orderBy(F.col("weight").desc(), "word")
    ranked = topics.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top_terms)
    return ranked.select("topic", "rank", "weight", "word")


#: Words whose topic counts are broadcast in a sweep, the most frequent ones; the tokens of all
#: others, a few in a hundred, are joined by a shuffle.
FREQUENT_WORDS = 1 << 19


def lda_fit(df: DataFrame, ws_col: str, k: int = 3, seed: int = 42, vocab_size: int | None = None,
            max_iter: int = 10, row_id: str | None = None, alpha: float = 0.1, beta: float = 0.01,
            partitions: int | None = None) -> DataFrame:
    """M10 fit: ``(topic, word, weight, n)``: each topic's distribution over all words, and the
    expected number of tokens of the word in the topic.

    Expectation-maximisation with collapsed counts.  The ``(row, word, n)`` counts of the corpus
    are numbers, dealt to ``partitions`` by row and persisted once; a sweep joins to them the topic
    counts of rows (dealt alike, so the corpus stays where it is) and of words, shares each count
    out over the topics and adds the shares up per word and per row in one aggregation.  Words are
    numbered by their frequency: the counts of the first ``FREQUENT_WORDS`` are broadcast, the
    tokens of the others meet theirs in a shuffle, so the vocabulary may have any size.  Only
    the two tables of counts are written, those of the sweep before being removed with its shuffle
    files; only the ``k`` topic totals are collected.  Starts come from a hash of row and word,
    the same on any cluster if ``row_id`` is given.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    key = F.col(row_id) if row_id else F.monotonically_increasing_id()
    topics = range(k)
    total = lambda cols: sum(cols[1:], cols[0])
    held = [work_dir(spark, "lda-counts")]
    row_word_counts(df.select(key.alias("_row"), F.col(ws_col).alias("_ws")), "_ws", "_row").write.parquet(held[0])
    counted = spark.read.parquet(held[0])
    words = counted.groupBy("word").agg(F.sum("n").alias("cf"))
    if vocab_size:
        words = words.orderBy(F.desc("cf"), "word").limit(vocab_size)
    # Numbers from 0, the most frequent word first.
    ranked = dense_index(words.select(F.struct((-F.col("cf")).alias("less"), "word").alias("at")), "at", "w")
    codes = ranked.select(F.col("at.word").alias("word"), "w").checkpoint()
    size = codes.count()
    rare = size > FREQUENT_WORDS
    start = [1.0 + F.pmod(F.xxhash64(F.lit(seed), F.lit(t), "_row", "word"), F.lit(1000)) / 1000.0 for t in topics]
    often = F.broadcast(codes.where(F.col("w") < FREQUENT_WORDS))
    if rare:
        met = counted.join(often, "word", "left")
        seldom = met.where("w IS NULL").drop("w").join(codes.where(F.col("w") >= FREQUENT_WORDS).hint("merge"), "word")
        coded = met.where("w IS NOT NULL").unionByName(seldom)
    else:
        coded = counted.join(often, "word")  # inner: with vocab_size other words are left out
    coded = coded.select("_row", F.col("w").cast("int").alias("w") if size < 1 << 31 else "w", F.col("n").cast("double").alias("n"),
                         *[s.alias(f"s{t}") for t, s in zip(topics, start, strict=True)])
    dealt = coded.repartition(partitions, "_row") if partitions else coded.repartition("_row")
    tokens = dealt.sortWithinPartitions("_row").persist()

    def added(parts: DataFrame) -> tuple[DataFrame, DataFrame, str]:
        """The counts of words and of rows, written: ``parts`` read once, sums by either key."""
        path = work_dir(spark, "lda-sweep")
        sums = parts.groupingSets([["w"], ["_row"]], "w", "_row").agg(
            F.grouping("w").alias("of_row"), *[F.sum(f"r{t}").alias(f"c{t}") for t in topics])
        sums.write.partitionBy("of_row").parquet(path)
        both = spark.read.schema(sums.drop("of_row").schema.add("of_row", "integer")).parquet(path)
        pick = lambda of, name, c: both.where(F.col("of_row") == of).select(name, *[F.col(f"c{t}").alias(f"{c}{t}") for t in topics])
        return pick(0, "w", "w"), pick(1, "_row", "d"), path

    norm = total([F.col(f"s{t}") for t in topics])
    shares = tokens.select("_row", "w", *[(F.col("n") * F.col(f"s{t}") / norm).alias(f"r{t}") for t in topics])
    try:
        for sweep in range(max_iter + 1):
            by_word, by_row, path = added(shares)
            whole = by_word.agg(*[F.sum(f"w{t}").alias(f"w{t}") for t in topics]).first()
            held.append(path)
            if len(held) > 2:  # nothing reads the sums of the sweep before any more
                remove_path(spark, held.pop(1))
            if sweep % 3 == 2:
                release_shuffles(spark)
            if sweep == max_iter or not size:
                break
            here = tokens.drop(*[f"s{t}" for t in topics]).join(by_row.hint("merge"), "_row")
            joined = here.join(F.broadcast(by_word.where(F.col("w") < FREQUENT_WORDS)), "w")
            if rare:
                joined = joined.unionByName(here.where(F.col("w") >= FREQUENT_WORDS).join(
                    by_word.where(F.col("w") >= FREQUENT_WORDS).hint("merge"), "w"))
            likely = [(F.col(f"d{t}") + alpha) * (F.col(f"w{t}") + beta) / (whole[f"w{t}"] + size * beta) for t in topics]
            p = joined.select("_row", "w", "n", *[x.alias(f"p{t}") for t, x in zip(topics, likely, strict=True)])
            norm = total([F.col(f"p{t}") for t in topics])
            shares = p.select("_row", "w", *[(F.col("n") * F.col(f"p{t}") / norm).alias(f"r{t}") for t in topics])
        each = F.array(*[F.struct(F.lit(t).alias("topic"), F.col(f"w{t}").alias("n"),
                                  ((F.col(f"w{t}") + beta) / ((whole[f"w{t}"] or 0.0) + size * beta)).alias("weight")) for t in topics])
        found = by_word.join(codes, "w").select("word", F.explode(each).alias("x")).select("x.topic", "word", "x.weight", "x.n").checkpoint()
    finally:
        tokens.unpersist()
    for path in held:
        remove_path(spark, path)
    return found


# --------------------------------------------------------------- M11
@dataclass(frozen=True)
class Selection:
    """M11a result: the shared featurizer, one fitted classifier per
    candidate, and each candidate's validation log loss."""
    featurizer: object
    reg_params: tuple
    models: tuple
    log_losses: tuple

    @property
    def best_index(self) -> int:
        return min(range(len(self.log_losses)), key=lambda i: (self.log_losses[i], i))

    @property
    def best_model(self):
        from pyspark.ml import PipelineModel
        return PipelineModel(stages=[*self.featurizer.stages, self.models[self.best_index]])


def training_part(row_id: str, seed: int, train_ratio: float) -> Column:
    """Whether a row is trained on, by a seeded hash of its key."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(1_000_000)) < int(1_000_000 * train_ratio)


def select_model(df: DataFrame, ws_col: str, label_col: str, row_id: str, reg_params=(0.0, 0.01, 0.1),
                 train_ratio: float = 0.8, seed: int = 42, parallelism: int = 3, max_iter: int = 100,
                 n_features: int = HASH_FEATURES, partitions: int | None = None) -> Selection:
    """Keep the candidate with the best validation log loss.

    Same protocol as ``TrainValidationSplit`` over the whole pipeline (one
    split, by a seeded hash of the row key and so the same on any partition
    layout; every stage fitted on the training part only), but the
    featurizer -- identical for every candidate, since only the
    regularisation varies -- is fitted once and its output persisted; the
    candidates then fit concurrently on those vectors.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    cached = df.select(row_id, ws_col, label_col).persist()
    try:
        part = training_part(row_id, seed, train_ratio)
        train, valid = cached.where(part), cached.where(~part)
        featurizer = text_featurizer(ws_col, label_col, n_features=n_features).fit(train)
        tx = featurizer.transform(train).select("label_index", "features").persist()
        vx = featurizer.transform(valid).select("label_index", "features").persist()
        ev = MulticlassClassificationEvaluator(labelCol="label_index", metricName="logLoss")
        tx_sized = for_iterations(tx, partitions)

        def one(reg):
            m = LogisticRegression(family="multinomial", labelCol="label_index", featuresCol="features",
                                   maxIter=max_iter, regParam=float(reg)).fit(tx_sized)
            return m, ev.evaluate(m.transform(vx))

        try:
            fits = _concurrent(one, reg_params, parallelism, df.sparkSession)
        finally:
            tx.unpersist()
            vx.unpersist()
    finally:
        cached.unpersist()
    return Selection(featurizer, tuple(reg_params), tuple(m for m, _ in fits), tuple(l for _, l in fits))


def early_stop(metrics: DataFrame, run_col: str, epoch_col: str, loss_col: str,
               patience: int = 3) -> DataFrame:
    """Per run, the epoch where training stops (``patience`` epochs in
    a row without a new best loss; null if it never stops) and the best epoch
    kept up to that point.  Windows are per run over its epochs only."""
    w = Window.partitionBy(run_col).orderBy(epoch_col)
    prev_best = F.min(loss_col).over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = metrics.withColumn("_imp", (prev_best.isNull() | (F.col(loss_col) < prev_best)).cast("int"))
    m = m.withColumn("_grp", F.sum("_imp").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("_since", F.row_number().over(Window.partitionBy(run_col, "_grp").orderBy(epoch_col)) - 1)
    stops = m.groupBy(run_col).agg(F.min(F.when(F.col("_since") == patience, F.col(epoch_col))).alias("stop_epoch"))
    m = m.join(stops, run_col)
    kept = m.filter(F.col("stop_epoch").isNull() | (F.col(epoch_col) <= F.col("stop_epoch")))
    return kept.groupBy(run_col, "stop_epoch").agg(
        F.min(F.struct(F.col(loss_col), F.col(epoch_col))).alias("_b")).select(
        run_col, F.col(f"_b.{epoch_col}").alias("best_epoch"), F.col(f"_b.{loss_col}").alias("best_loss"),
        "stop_epoch")


# ------------------------------------------------- M5, user-model hook
def predict_with_model(df: DataFrame, text_col: str, make_predict_fn, labels: Sequence[str],
                       n_classes: int | None = None, batch_size: int = 256,
                       out: str = "predicted_label") -> DataFrame:
    """M5 for a model that is not a Spark ML stage (e.g. an exported neural
    network): ``make_predict_fn()`` is called once per Python worker and
    returns ``fn(texts: np.ndarray) -> np.ndarray[n, n_classes]`` of class
    scores (of an array column ``fn`` gets a matrix with a row per input).  Rows travel to Python in Arrow batches of ``batch_size``; the
    argmax and label lookup run back on the JVM side."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    n = n_classes or len(labels)
    kind = df.schema[text_col].dataType
    vectors = isinstance(kind, ArrayType)
    # The length of the vectors, which must all have it.
    width = df.agg(F.max(F.size(text_col))).first()[0] or 0 if vectors else 0
    udf = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size,
                            input_tensor_shapes=[[width]] if vectors else None)
    scored = df.withColumn("_scores", udf(F.col(text_col) if vectors else F.coalesce(F.col(text_col), F.lit(""))))
    scored = scored.withColumn("_scores", F.when(F.size("_scores") == n, F.col("_scores")).otherwise(
        F.raise_error(F.format_string("the model gave %s scores for %s labels", F.size("_scores"), F.lit(n)))))
    return scored.withColumn(out, LB.argmax_label("_scores", list(labels))).drop("_scores")
