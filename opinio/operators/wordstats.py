"""Label distributions and word statistics (A5-A10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.functions import text as T
from opinio.functions.arrays import explode_rows
from opinio.operators.arrowcounts import pair_counts, run_word_counts


def label_counts(df: DataFrame, label_col: str) -> DataFrame:
    """A5: ``value_counts`` -- nulls dropped, count descending, label asc."""
    return (df.filter(F.col(label_col).isNotNull()).groupBy(label_col)
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(label_col)))


def label_share(df: DataFrame, label_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Percentage of each label to one decimal.

    The window runs over the already aggregated ``(by, label, n)`` table --
    at most (groups x labels) rows -- never over the input rows.
    """
    counts = (df.filter(F.col(label_col).isNotNull()).groupBy(*by, label_col)
              .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return counts.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(w), 1))


def label_counts_fixed(df: DataFrame, label_col: str, domain: Sequence[str]) -> DataFrame:
    """Counts for a fixed label domain, zero when absent, others ignored."""
    spark = df.sparkSession
    dom = spark.createDataFrame([(x,) for x in domain], f"{label_col} string")
    counts = df.filter(F.col(label_col).isin(list(domain))).groupBy(label_col).agg(
        F.count(F.lit(1)).alias("n"))
    return (F.broadcast(dom).join(counts, on=label_col, how="left")
            .select(label_col, F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def word_counts(df: DataFrame, ws_col: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by, word, n)`` with map-side partial counts -- a word holding a third
    of all tokens is one row per task before the shuffle."""
    return (explode_rows(df, ws_col, "word", *by).groupBy(*by, "word")
            .agg(F.count(F.lit(1)).alias("n")))


def top_words(df: DataFrame, text_col: str, k: int = 10, label_col: str | None = None,
              label: str | None = None) -> DataFrame:
    """The ``k`` most frequent whitespace words (within one label when
    given); ties broken by word."""
    src = df if label_col is None else df.filter(F.col(label_col) == label)
    ws = src.select(T.split_words(T.as_text(text_col)).alias("ws"))
    return (word_counts(ws, "ws").orderBy(F.col("n").desc(), F.col("word")).limit(k))


def with_bigrams(ws_col: str) -> Column:
    """The words followed by every adjacent pair ``"w1 w2"`` (the word-cloud
    collocation option, counted as plain terms).  Built inside the row from
    the array and a copy shifted by one: no shuffle, linear in the words."""
    prev = F.concat(F.array(F.lit(None).cast("string")), F.col(ws_col))
    pairs = F.zip_with(prev, ws_col, lambda p, w: F.when(p.isNotNull() & w.isNotNull(), F.concat_ws(" ", p, w)))
    return F.concat(F.col(ws_col), F.filter(pairs, lambda x: x.isNotNull()))


def _cloud_terms(df: DataFrame, text_col: str, stopwords, min_len: int, bigrams: bool,
                 *keep: str) -> DataFrame:
    # The cleaned word array is its own column, so the pair expansion reads
    # it rather than re-running the regexes per element.
    ws = df.select(*keep, F.filter(T.clean_words(text_col, stopwords),
                                   lambda w: F.length(w) >= min_len).alias("ws"))
    return ws.select(*keep, with_bigrams("ws").alias("ws")) if bigrams else ws


def word_cloud_weights(df: DataFrame, text_col: str, label_col: str | None = None,
                       label: str | None = None, max_words: int = 200,
                       stopwords: Sequence[str] = (), min_len: int = 2,
                       bigrams: bool = False) -> DataFrame:
    """``weight = n / max n`` over the ``max_words`` most frequent cleaned
    words of at least ``min_len`` characters (and, with ``bigrams``, adjacent
    word pairs); the top-k is a bounded TakeOrderedAndProject and the max
    window then spans ``max_words`` rows."""
    src = df if label_col is None else df.filter(F.col(label_col) == label)
    ws = _cloud_terms(src, text_col, stopwords, min_len, bigrams)
    top = word_counts(ws, "ws").orderBy(F.col("n").desc(), F.col("word")).limit(max_words)
    return top.withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy()))


def group_word_weights(df: DataFrame, text_col: str, group_col: str, max_words: int = 200,
                       stopwords: Sequence[str] = (), min_len: int = 2,
                       bigrams: bool = False) -> DataFrame:
    """A10: A9 for every group in one job.  ``row_number <= k`` is planned with
    a partial WindowGroupLimit before the shuffle, so each group ships at most
    ``max_words`` candidates per task however large its vocabulary is."""
    ws = _cloud_terms(df, text_col, stopwords, min_len, bigrams, group_col)
    counts = word_counts(ws, "ws", [group_col])
    w = Window.partitionBy(group_col).orderBy(F.col("n").desc(), F.col("word"))
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_words)
    return top.withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy(group_col)))


def collocations(df: DataFrame, ws_col: str, threshold: float = 30.0) -> DataFrame:
    """A9, terms of a cloud with collocations: ``(term, n, llr)``.

    An adjacent pair of words is a term if its log-likelihood ratio -- how much likelier the
    counts are if the second word depends on the first than if it does not -- exceeds
    ``threshold``; the pair's occurrences are then taken off the counts of its two words
    (``llr`` is null for words), and words of which none is left have no row.  All counts
    combine in the tasks, and nothing is collected: the total is joined as a table of one row.
    """
    from opinio.session import checkpoint_root
    checkpoint_root(df.sparkSession)
    words = run_word_counts(df, ws_col).checkpoint()
    both = pair_counts(df, ws_col).withColumnRenamed("n", "k")
    total = F.broadcast(words.agg(F.sum("n").cast("double").alias("total")))  # one row
    counted = (both.join(words.select(F.col("word").alias("a"), F.col("n").cast("double").alias("na")), "a")
               .join(words.select(F.col("word").alias("b"), F.col("n").cast("double").alias("nb")), "b").join(total, F.lit(True)))

    def likely(k: Column, n: Column, p: Column) -> Column:
        """Log likelihood of ``k`` hits in ``n`` trials at rate ``p``; no hits or misses cost nothing."""
        term = lambda c, q: F.when(c > 0, c * F.ln(F.greatest(q, F.lit(1e-300)))).otherwise(0.0)
        return term(k, p) + term(n - k, 1 - p)

    k, na, nb, t = F.col("k").cast("double"), F.col("na"), F.col("nb"), F.col("total")
    rest, other = F.greatest(nb - k, F.lit(0.0)), F.greatest(t - na, F.lit(1.0))
    llr = 2 * (likely(k, na, k / na) + likely(rest, other, rest / other) - likely(k, na, nb / t) - likely(rest, other, nb / t))
    kept = counted.select("a", "b", "k", llr.alias("llr")).where(F.col("llr") > threshold).checkpoint()
    taken = kept.select(F.col("a").alias("word"), "k").unionByName(kept.select(F.col("b").alias("word"), "k")).groupBy("word").agg(F.sum("k").alias("k"))
    left = (words.join(taken, "word", "left").select("word", (F.col("n") - F.coalesce("k", F.lit(0))).alias("n")).where("n > 0"))
    return (left.select(F.col("word").alias("term"), "n", F.lit(None).cast("double").alias("llr"))
            .unionByName(kept.select(F.concat_ws(" ", "a", "b").alias("term"), F.col("k").alias("n"), "llr")))
