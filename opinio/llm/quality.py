"""Operator 6: quality rules kept as a bitmask ledger.

Every rule is evaluated once per document.  The ledger stores the measurements and one
integer whose bits say which rules failed; a policy is a mask over those bits, so a new
policy version or an ablation is bit arithmetic on the ledger, never another pass over
the texts.

Everything here is DataFrame expressions, one row at a time: no shuffle at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import WORD, column, let

SYMBOLS = "#*$%&|<>"
MARKS = "!?"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks")

#: Rules in bit order: name and failing condition over the measurements.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("shouting", "100 * n_marks > 50 * n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named version of which rules reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_trigrams"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", tuple(BITS)))}
PRODUCTION = POLICIES["v1"]


def _positions_in_repeats(packed: Column, bits: Column) -> Column:
    """Of sorted ``digest | position`` values those whose digest part has an equal neighbour."""
    same = lambda a, b: F.call_function("shiftright", a.bitwiseXOR(b), bits) == 0
    return F.filter(packed, lambda x, i: same(x, F.get(packed, i - 1)) | same(x, F.get(packed, i + 1)))


def _covered(positions: Column) -> Column:
    """Words inside three-word windows that start at these sorted positions."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("n"),
                                   p.alias("last"))
    return F.aggregate(positions, start, step, lambda acc: acc["n"])


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns plus the measurements of each whole text (null: empty).

    Repeated three-word windows are found by sorting one long per word: the window's
    64-bit digest with its low bits replaced by the window's position (as many bits as
    the text needs).  Windows that are equal only in the bits that are left are told apart
    by their whole digest: such a text, if any, is measured again on (digest, position)
    pairs.  Work per text is O(n log n) in its words.
    """
    kept = [c for c in keep if c not in MEASURES]
    text = F.coalesce(column(docs, text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    only = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")
    df = docs.select(*kept, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__w"),
                     only(SYMBOLS).alias("n_symbols"), only(MARKS).alias("n_marks"), lines.alias("__lines"))
    df = df.select(*kept, "n_symbols", "n_marks",
                   F.size("__w").cast("long").alias("n_words"),
                   F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
                   F.size("__lines").cast("long").alias("n_lines"),
                   (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
                   F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"))
    # position bits of this text: enough for every window start
    df = df.withColumn("__bits", F.length(F.bin(F.col("n_words"))))
    df = df.withColumn("__mask", F.expr("shiftleft(1L, __bits) - 1"))
    df = df.withColumn("__high", F.bitwise_not(F.col("__mask")))
    digest = lambda i: F.xxhash64(F.get("__h", i), F.get("__h", i + 1), F.get("__h", i + 2))
    packed = F.transform("__h", lambda x, i: F.xxhash64(x, F.get("__h", i + 1), F.get("__h", i + 2))
                         .bitwiseAND(F.col("__high")).bitwiseOR(i))
    # the last two words start no window
    df = df.withColumn("__packed", F.sort_array(F.slice(packed, F.lit(1), F.greatest(F.lit(0), F.size("__h") - 2))))
    df = df.withColumn("__hits", _positions_in_repeats(F.col("__packed"), F.col("__bits")))
    at = lambda x: x.bitwiseAND(F.col("__mask"))
    whole = lambda x: digest(at(x).cast("int"))
    clash = F.exists(
        F.when(F.size("__hits") > 1, F.sequence(F.lit(1), F.size("__hits") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.get("__hits", i).bitwiseXOR(F.get("__hits", i - 1)).between(F.lit(0), F.col("__mask"))
        & (whole(F.get("__hits", i)) != whole(F.get("__hits", i - 1))))
    pairs = F.array_sort(F.transform("__hits", lambda x: F.struct(whole(x).alias("d"), at(x).alias("p"))))
    exact = let(pairs, lambda a: F.sort_array(F.transform(
        F.filter(a, lambda x, i: F.coalesce((F.get(a, i - 1)["d"] == x["d"]) & (i > 0), F.lit(False))
                 | F.coalesce(F.get(a, i + 1)["d"] == x["d"], F.lit(False))), lambda x: x["p"])))
    df = df.withColumn("__clash", clash).withColumn(
        "__at", F.when(F.col("__clash"), exact).otherwise(F.sort_array(F.transform("__hits", at))))
    return df.withColumn("n_repeat_words", _covered(F.col("__at"))).select(*kept, *MEASURES)


def ledger(measured: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Measurements plus ``failed``: bit ``i`` is set where rule ``i`` of RULES fails."""
    failed = None
    for name, broken in RULES:
        bit = F.when(F.expr(broken), F.lit(BITS[name])).otherwise(0)
        failed = bit if failed is None else failed.bitwiseOR(bit)
    return measured.select(*[c for c in keep if c not in MEASURES], *MEASURES, failed.cast("long").alias("failed"))


def passes(policy: Policy, failed: Column | None = None) -> Column:
    """True where no rule of the policy failed."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(book: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """Per rule of a policy, from one aggregation over the ledger: documents that fail it,
    that fail nothing else of the policy, and that the policy would keep without it."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    inside = F.col("failed").bitwiseAND(F.lit(policy.mask))
    aggs = [F.struct(F.lit(r).alias("rule"), count(inside.bitwiseAND(BITS[r]) != 0).alias("n_failed"),
                     count(inside == BITS[r]).alias("n_only"),
                     count(inside.bitwiseAND(F.lit(policy.mask & ~BITS[r])) == 0).alias("n_kept_without"))
            for r in policy.rules]
    return book.agg(F.array(*aggs).alias("_rows")).select(F.explode("_rows").alias("_r")).select(
        F.lit(policy.version).alias("version"), "_r.*")
