"""Operator 1: mix sources to target weights with hash-threshold histograms.

Each document gets a deterministic 60-bit hash.  A source is mixed to its target by
taking whole copies of everything plus those documents whose hash lies under a
threshold.  The threshold is found without sorting documents: words are summed by
(source, hash bucket), a running sum over the buckets finds the bucket in which the
budget ends, and only the documents of that bucket are histogrammed again by the next
hash bits, until the bucket is one hash value.  Thresholds of growing budgets nest: a
document taken for a small budget is taken for each larger one.

Everything here is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opinio.llm.common import WORD, broadcast_if_small, column, settle

#: Hash bits of one histogram level and number of levels: 5 x 12 = 60 bits.
LEVEL_BITS, LEVELS = 12, 5
HASH_BITS = LEVEL_BITS * LEVELS

#: Production mix: weights repeat over the sources in code-point order, null last.
WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_REPEATS = 2


def word_count(text: Column) -> Column:
    """Number of words (null text: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 digest of id and text: the same on every run and engine."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows.

    The budget ``budget_share * all words`` is shared by weight; no target exceeds
    ``max_repeats`` times its source, and what is above goes to the others by weight
    until none is above.  That fixed point has one level: targets are
    ``min(cap, level * weight)``.  With the sources in order of ``cap / weight`` the
    capped ones come first, so the level is the first at which the next source is not
    above its cap.  One row per source passes these windows.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per_source.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_rank") % len(weights) + 1)
    capped = ranked.select("source", "source_size", weight.alias("_w"),
                           (F.col("source_size") * F.lit(float(max_repeats))).alias("_cap"))
    everything = W.partitionBy()
    by_ratio = W.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.col("_all_w") - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    levelled = (capped
                .withColumn("_ratio", F.col("_cap") / F.col("_w"))
                .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(budget_share)))
                .withColumn("_all_w", F.sum("_w").over(everything))
                .withColumn("_level", level)
                .withColumn("_open", F.when(F.col("_ratio") >= F.col("_level"), F.col("_ratio"))))
    chosen = F.min(F.when(F.col("_open").isNotNull(), F.struct("_ratio", "_level"))).over(everything)
    return (levelled.withColumn("_chosen", chosen)
            .select("source", "source_size",
                    F.when(F.col("_chosen").isNull() | (F.col("_ratio") < F.col("_chosen._level")), F.col("_cap"))
                    .otherwise(F.col("_chosen._level") * F.col("_w")).alias("target")))


def mix_thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, source_size, target, copies, cut)``: each document of the source is
    taken ``copies`` times, and once more if its hash is under ``cut``.

    ``sized`` has ``source, size, h``.  The budget left after whole copies ends inside
    one hash bucket per source and level; only that bucket is summed again by the next
    bits.  The last bucket is one hash value, taken if that brings the sum nearer.
    """
    goal = targets.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        .cast("long").alias("copies"))
    edge = goal.withColumn("_rest", F.col("target") - F.col("copies") * F.col("source_size")) \
        .withColumn("_prefix", F.lit(0).cast("long"))
    docs = sized.select(F.col("source").alias("_s"), "size", "h")
    for lvl in range(1, LEVELS + 1):
        shift = HASH_BITS - LEVEL_BITS * lvl
        inside = docs if lvl == 1 else docs.join(
            edge.select("source", "_prefix"),
            docs["_s"].eqNullSafe(edge["source"]) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("_prefix")),
            "left_semi")
        hist = (inside.groupBy("_s", F.shiftright("h", shift).alias("_bucket")).agg(F.sum("size").alias("_words")))
        run = hist.withColumn("_upto", F.sum("_words").over(
            W.partitionBy("_s").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)))
        found = (run.join(edge, F.col("_s").eqNullSafe(F.col("source")))
                 .where(F.col("_upto") > F.col("_rest"))
                 .groupBy("source")
                 .agg(F.min(F.struct("_bucket", "_upto", "_words", "_rest")).alias("_hit")))
        edge = settle(found.select(
            "source", F.col("_hit._bucket").alias("_prefix"), F.col("_hit._words").alias("_last"),
            (F.col("_hit._rest") - (F.col("_hit._upto") - F.col("_hit._words"))).alias("_rest")))
    nearer = (F.col("_last") - F.col("_rest") < F.col("_rest")).cast("long")
    cuts = edge.select(F.col("source").alias("_s"), (F.col("_prefix") + nearer).alias("cut"))
    return goal.join(cuts, goal["source"].eqNullSafe(cuts["_s"]), "left").select(
        "source", "source_size", "target", "copies", F.coalesce("cut", F.lit(0)).alias("cut"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                keep: tuple[str, ...] = (), **policy) -> DataFrame:
    """One row per document: ``keep`` columns plus ``size, source_size, target, taken``.

    Null text has size 0; the null source is a source like any other; documents with
    equal id and text share one hash, so they are taken or left together.  An empty
    table gives an empty result.  ``keep`` names columns of ``docs`` to carry; the four
    result names win over equally named ones.
    """
    out = ("size", "source_size", "target", "taken")
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in keep if c not in out]
    base = docs.select(
        *kept, F.struct(column(docs, source_col).alias("source")).alias("__mix"),
        word_count(column(docs, text_col)).alias("size"),
        mix_hash(column(docs, id_col), column(docs, text_col)).alias("__h"))
    sized = base.select(F.col("__mix.source").alias("source"), "size", F.col("__h").alias("h"))
    if set(keep) <= {id_col}:  # narrow enough to be written once and used for both passes
        base = settle(base)
        sized = base.select(F.col("__mix.source").alias("source"), "size", F.col("__h").alias("h"))
    else:
        sized = settle(sized)
    targets = settle(source_targets(sized, **policy))
    plan = settle(mix_thresholds(sized, targets)).select(
        F.struct("source", "source_size", "target", "copies", "cut").alias("__plan"))
    plan = broadcast_if_small(plan, F.lit(64) + F.coalesce(F.octet_length("__plan.source"), F.lit(0)))
    joined = base.join(plan, F.col("__mix.source").eqNullSafe(F.col("__plan.source")))
    times = F.col("__plan.copies") + (F.col("__h") < F.col("__plan.cut")).cast("long")
    return joined.select(*[c for c in keep if c not in out], "size", F.col("__plan.source_size").alias("source_size"),
                         F.col("__plan.target").alias("target"), (F.col("size") * times).alias("taken"))
