"""Word vectors learned from the corpus's own co-occurrences (M12), and mined aspects.

Counts of word pairs within a window give a sparse symmetric table of positive pointwise
mutual information; its leading eigenvectors, found by block power iteration, are the word
vectors.  The table and the vectors are DataFrames keyed by word: an iteration is a join and
an aggregation, and only ``size x size`` numbers reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.operators.arrowcounts import pair_counts, row_word_counts, run_word_counts
from opinio.session import checkpoint_root, work_dir
from opinio.sources.tables import bounded_broadcast


def _both_ways(pairs: DataFrame, *values: str) -> DataFrame:
    """``(word, ctx, *values)`` of written pairs that are given once; a word beside itself has one row."""
    turned = pairs.where("a <> b").select(F.col("b").alias("word"), F.col("a").alias("ctx"), *values)
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("ctx"), *values).unionByName(turned)


def _once(df: DataFrame, ws_col: str, window: int, known: DataFrame | None = None) -> DataFrame:
    """``(a, b, n)``: each pair of words once, counted in either order; a word beside itself
    counts for both places."""
    pairs = pair_counts(df, ws_col, window, either_way=True, known=known)
    return pairs.withColumn("n", F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n")))


def cooccurrences(df: DataFrame, ws_col: str, window: int = 2) -> DataFrame:
    """``(word, ctx, n)``: how often two words stand at most ``window`` apart, both ways round.

    Pairs are counted in the tasks, by the words' numbers, before the one shuffle, in which each
    pair is held in one order; a pair that fills the corpus is a row for each million words.
    """
    return _both_ways(_written(_once(df, ws_col, window), "word-pairs"), "n")


def _ppmi_once(df: DataFrame, ws_col: str, window: int, min_count: int) -> DataFrame:
    """``(a, b, n, x)``: the pairs of :func:`ppmi`, each once."""
    checkpoint_root(df.sparkSession)
    kept = run_word_counts(df, ws_col).where(F.col("n") >= min_count).select("word").checkpoint()
    pairs = _written(_once(df, ws_col, window, bounded_broadcast(kept)), "word-pairs")
    sums = _both_ways(pairs, "n").groupBy("word").agg(F.sum("n").alias("m")).checkpoint()
    own = bounded_broadcast(sums)
    total = F.broadcast(sums.agg(F.sum("m").cast("double").alias("total")))  # one row
    side = lambda c, m: own.select(F.col("word").alias(c), F.col("m").cast("double").alias(m))
    scored = pairs.join(side("a", "ma"), "a").join(side("b", "mb"), "b").join(total, F.lit(True))
    x = F.ln(F.col("n") * F.col("total") / (F.col("ma") * F.col("mb")))
    return scored.select("a", "b", "n", x.alias("x")).where("x > 0")


def ppmi(df: DataFrame, ws_col: str, window: int = 2, min_count: int = 5) -> DataFrame:
    """``(word, ctx, n, x)``: ``x = ln(n * total / (n_word * n_ctx))`` where that is positive.

    Only words that occur at least ``min_count`` times have a vector (so in any model of this
    kind: of a rarer word there is too little evidence); totals are over their pairs.
    """
    return _both_ways(_ppmi_once(df, ws_col, window, min_count), "n", "x")


def _written(df: DataFrame, name: str) -> DataFrame:
    """A large intermediate, written once as Parquet, which is smaller than a checkpoint."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _axes(size: int) -> list[Column]:
    return [F.col(f"v{i}") for i in range(size)]


def _turned(df: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Rows ``v`` times a small matrix, as plain column expressions."""
    size = len(matrix)
    axes = _axes(size)
    new = [sum((axes[j] * float(matrix[j, i]) for j in range(1, size)), axes[0] * float(matrix[0, i])) for i in range(matrix.shape[1])]
    return df.select("word", *[c.alias(f"v{i}") for i, c in enumerate(new)])


def _products(left: DataFrame, right: DataFrame, size: int) -> np.ndarray:
    """``left.T @ right`` over their common words."""
    names = [f"r{i}" for i in range(size)]
    both = left.join(right.toDF("word", *names), "word")
    sums = both.agg(*[F.sum(F.col(f"v{i}") * F.col(n)).alias(f"s{i}_{j}") for i in range(size) for j, n in enumerate(names)]).first()
    return np.array([x or 0.0 for x in sums], dtype=float).reshape(size, size)


def _through(table: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """The table times the vectors: one row per word of the table."""
    side = bounded_broadcast(vectors.withColumnRenamed("word", "ctx"))
    return table.join(side, "ctx").groupBy("word").agg(*[F.sum(F.col("x") * F.col(f"v{i}")).alias(f"v{i}") for i in range(size)])


def word_vectors(table: DataFrame, size: int = 16, iterations: int = 6, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """``(word, vector)`` and the eigenvalues, from a symmetric ``table(word, ctx, x)``.

    Block power iteration from signs drawn by a hash of the word: multiply by the table, make
    the columns orthonormal through the Cholesky factor of their Gram matrix, repeat; at last
    turn them to the eigenvectors within their span and scale each by the root of its value.
    Vectors of words with like neighbours point alike.  Fewer words than ``size`` give as many
    columns as there are words; an empty table gives no rows.
    """
    checkpoint_root(table.sparkSession)
    table = _written(table.select("word", "ctx", "x"), "word-table")
    words = table.select("word").distinct().checkpoint()
    size = min(size, words.count())
    if not size:
        return words.select("word", F.expr("CAST(array() AS array<double>)").alias("vector")), []
    x = words.select("word", *[(F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "word"), F.lit(2001)) / 1000.0 - 1).alias(f"v{i}") for i in range(size)])
    for _ in range(iterations):
        x = _orthonormal(_through(table, x.checkpoint(), size).checkpoint(), size)
    x = x.checkpoint()
    values, turn = np.linalg.eigh((lambda g: (g + g.T) / 2)(_products(x, _through(table, x, size).checkpoint(), size)))
    order = np.argsort(-np.abs(values))
    scaled = _turned(x, turn[:, order] * np.sqrt(np.abs(values[order])))
    return scaled.select("word", F.array(*_axes(size)).alias("vector")), values[order].tolist()


def _orthonormal(y: DataFrame, size: int) -> DataFrame:
    gram = y.agg(*[F.sum(F.col(f"v{i}") * F.col(f"v{j}")) for i in range(size) for j in range(size)]).first()
    g = np.array([v or 0.0 for v in gram], dtype=float).reshape(size, size)
    scale = max(np.trace(g), 1e-300)
    lower = np.linalg.cholesky(g + 1e-14 * scale * np.eye(size))
    return _turned(y, np.linalg.inv(lower).T)


def sentence_means(df: DataFrame, ws_col: str, row_id: str, vectors: DataFrame, out: str = "sentence_vector") -> DataFrame:
    """``(row_id, out)``: mean of the vectors of a row's words that have one; null without any.

    A row's words are counted, joined once and averaged in the tasks per component.
    """
    size = (vectors.select(F.max(F.size("vector"))).first()[0]) or 0
    flat = bounded_broadcast(vectors.select("word", *[F.get("vector", i).alias(f"v{i}") for i in range(size)]))
    if not size:
        return df.select(row_id).distinct().select(row_id, F.lit(None).cast("array<double>").alias(out))
    hits = row_word_counts(df, ws_col, row_id).join(flat, "word")
    sums = hits.select(row_id, "n", *[(F.col("n") * F.col(f"v{i}")).alias(f"v{i}") for i in range(size)])
    every = df.select(row_id, F.lit(None).cast("long").alias("n"), *[F.lit(None).cast("double").alias(f"v{i}") for i in range(size)])
    means = every.unionByName(sums).groupBy(row_id).agg(F.sum("n").alias("n"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(size)])
    return means.select(row_id, F.when(F.col("n") > 0, F.array(*[c / F.col("n") for c in _axes(size)])).alias(out))


def mine_aspects(df: DataFrame, ws_col: str, opinions: DataFrame, stopwords: DataFrame, rounds: int = 2,
                 min_hits: int = 3, min_share: float = 0.05) -> DataFrame:
    """``(word, kind, round, hits)``: aspect and opinion words by double propagation.

    From known ``opinions(word)`` each round finds the words that stand next to them -- at
    least ``min_hits`` times, and in at least ``min_share`` of their own occurrences -- as aspects,
    and then, next to the round's aspects, new opinions by the same rule.  ``stopwords(word)`` are
    neither.  A word keeps the kind and round in which it was first found; known opinions
    have round 0.  Adjacent pairs are counted once; a round is two joins of that table.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    near = _both_ways(_written(_once(df, ws_col, 1), "neighbours"), "n").join(
        bounded_broadcast(stopwords.select("word").distinct()), "word", "left_anti")
    said = run_word_counts(df, ws_col).withColumnRenamed("n", "said").checkpoint()
    found = opinions.select("word").distinct().select("word", F.lit("opinion").alias("kind"), F.lit(0).alias("round"), F.lit(0).cast("long").alias("hits"))
    found = found.checkpoint()
    fresh = {"opinion": found.select("word")}
    for r in range(1, rounds + 1):
        for kind, other in (("aspect", "opinion"), ("opinion", "aspect")):
            hits = near.join(bounded_broadcast(fresh[other].withColumnRenamed("word", "ctx")), "ctx").groupBy("word").agg(F.sum("n").alias("hits"))
            new = (hits.where(F.col("hits") >= min_hits).join(said, "word").where(F.col("hits") >= min_share * F.col("said"))
                   .join(bounded_broadcast(found.select("word")), "word", "left_anti")
                   .select("word", F.lit(kind).alias("kind"), F.lit(r).alias("round"), "hits").checkpoint())
            fresh[kind] = new.select("word")
            found = found.unionByName(new).checkpoint()
    return found
