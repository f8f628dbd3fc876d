"""Comment cleaning pipelines and word-level lookups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.functions import text as T
from opinio.functions.arrays import explode_rows
from opinio.operators.dedup import keep_first
from opinio.sources.tables import bounded_broadcast


def _words(ws_col: str):
    """Word arrays of every form below: a null array has no words."""
    return F.coalesce(F.col(ws_col), F.expr("CAST(array() AS array<string>)"))


def explode_words(df: DataFrame, ws_col: str, row_id: str = "row_id",
                  keep: Sequence[str] = ()) -> DataFrame:
    """``(row_id, *keep, pos, word)``; rows with no words keep one row with
    ``pos`` null so they survive a later regroup."""
    return df.select(row_id, *keep, F.posexplode_outer(ws_col).alias("pos", "word"))


def regroup_words(long: DataFrame, row_id: str = "row_id", keep: Sequence[str] = (),
                  word_col: str = "word", out: str = "words") -> DataFrame:
    """Inverse of :func:`explode_words`: one shuffle on the row key, words back
    in position order (``collect_list`` combines partially map-side)."""
    agg = long.groupBy(row_id, *keep).agg(
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(),
                                           F.struct("pos", F.col(word_col).alias("w"))))).alias("_ws"))
    return agg.select(row_id, *keep, F.transform("_ws", lambda s: s["w"]).alias(out))


def remove_stopwords(df: DataFrame, ws_col: str, stopwords, out: str | None = None,
                     row_id: str = "row_id") -> DataFrame:
    """Drop stopwords from a word array column, keeping repeats and order.

    ``stopwords`` is a list (array filter with a hash-set lookup, no shuffle)
    or a one-column DataFrame ``word`` (exploded join for lists too big to
    inline; broadcast only when its size is measured small).  Both give an
    empty array for a null one.  Only row key, position and word are exploded;
    the other columns are joined back once by the row key.
    """
    out = out or ws_col
    if not isinstance(stopwords, DataFrame):
        return df.withColumn(out, T.drop_words(_words(ws_col), list(stopwords)))
    from opinio.session import checkpoint_root
    checkpoint_root(df.sparkSession)
    long = explode_words(df, ws_col, row_id)
    stop = bounded_broadcast(stopwords.select("word").distinct().checkpoint()).withColumn("_stop", F.lit(True))
    # A left join with a flag (not an anti join) so a row whose words are all
    # stopwords still comes back, with an empty array.
    flagged = (long.join(stop, on="word", how="left")
               .withColumn("pos", F.when(F.col("_stop").isNull(), F.col("pos"))))
    return _join_back(df, regroup_words(flagged, row_id, out="_kept"), row_id, out)


def _join_back(df: DataFrame, words: DataFrame, row_id: str, out: str) -> DataFrame:
    """``df`` with column ``out`` replaced by (or added from) ``words._kept``."""
    cols = [c for c in df.columns if c != out]
    joined = df.join(words.select(row_id, "_kept"), row_id, "left").withColumn("_kept", _words("_kept"))
    order = df.columns if out in df.columns else [*df.columns, out]
    return joined.select(*cols, F.col("_kept").alias(out)).select(*order)


def affix_stems(vocab: DataFrame, prefixes: Sequence[str], suffixes: Sequence[str],
                min_root: int = 3) -> DataFrame:
    """T8 (vocabulary job): ``(word, stem)`` for every distinct word.

    Candidates are the word with one suffix removed, one prefix removed, or
    both, tried in that priority (list order inside each group).  A candidate
    is accepted only if it is itself a word of the vocabulary (the root guard)
    and has at least ``min_root`` characters; otherwise the word is its own
    stem.  Each distinct word is stemmed once; the result is joined back to
    the tokens, so the cost is independent of how often a word repeats.
    """
    w = F.col("word")
    cands = []
    prio = 0
    for s in suffixes:
        cands.append(F.struct(F.lit(prio).alias("prio"),
                              F.when(w.endswith(s), F.expr(f"substring(word, 1, length(word) - {len(s)})")).alias("cand")))
        prio += 1
    for p in prefixes:
        cands.append(F.struct(F.lit(prio).alias("prio"),
                              F.when(w.startswith(p), F.expr(f"substring(word, {len(p) + 1})")).alias("cand")))
        prio += 1
    for p in prefixes:
        for s in suffixes:
            cands.append(F.struct(F.lit(prio).alias("prio"), F.when(
                w.startswith(p) & w.endswith(s) & (F.length(w) > len(p) + len(s)),
                F.expr(f"substring(word, {len(p) + 1}, length(word) - {len(p) + len(s)})")).alias("cand")))
            prio += 1
    # The vocabulary feeds three branches (words, root guard, fallback); it is
    # written once to the shared checkpoint folder instead of being re-derived
    # from the corpus three times.
    from opinio.session import checkpoint_root
    checkpoint_root(vocab.sparkSession)
    words = vocab.select("word").distinct().checkpoint()
    # Only candidates that exist and are long enough leave the projection.
    live = F.filter(F.array(*cands), lambda c: c["cand"].isNotNull() & (F.length(c["cand"]) >= min_root))
    exploded = explode_rows(words, live, "c", "word").select("word", "c.prio", "c.cand")
    roots = words.select(F.col("word").alias("cand"))
    accepted = exploded.join(roots, on="cand", how="left_semi")
    best = accepted.groupBy("word").agg(F.min(F.struct("prio", "cand")).alias("b"))
    return (words.join(best, on="word", how="left")
            .select("word", F.coalesce(F.col("b.cand"), F.col("word")).alias("stem")))


# Spark looks keys up in a literal map by linear scan, so only small maps are
# inlined; larger ones go through a (size-checked) broadcast hash join.
INLINE_MAP_MAX = 64


def apply_word_map(df: DataFrame, ws_col: str, table: DataFrame, key: str = "word",
                   value: str = "stem", row_id: str = "row_id", keep: Sequence[str] = (),
                   out: str | None = None, inline_max: int = INLINE_MAP_MAX) -> DataFrame:
    """Replace each word by ``table[value]`` where present (T8 join-back, T9
    for a table-sized synonym list).

    Only entries that change a word matter.  When at most ``inline_max`` of
    them exist (checked), they are inlined as a map literal and applied with
    ``transform`` -- no shuffle.  Otherwise: explode (row key, position, word),
    hash join (broadcast when the map is measured small, else a shuffle join
    whose hot-word partitions AQE splits), regroup by row key; the regroup
    combines inside each task first, and the ``keep`` columns are joined back once.

    Both forms agree: a null word array gives an empty one, and of a key's
    several values the least counts.
    """
    from opinio.session import checkpoint_root
    out = out or ws_col
    changes = (table.groupBy(F.col(key).alias("word")).agg(F.min(value).alias("_v"))
               .filter(F.col("_v").isNotNull() & (F.col("_v") != F.col("word"))))
    # The map is usually derived (a stemming vocabulary job): it is written
    # once to the shared checkpoint folder, so the size check and the join
    # read the result instead of re-running the job.  One bounded count
    # picks the strategy.
    checkpoint_root(df.sparkSession)
    changes = changes.checkpoint()
    if changes.limit(inline_max + 1).count() <= inline_max:
        mapping = {r["word"]: r["_v"] for r in changes.collect()}
        return df.select(row_id, *keep, T.map_words(_words(ws_col), mapping).alias(out))
    long = explode_words(df, ws_col, row_id)
    mapped = long.join(bounded_broadcast(changes), on="word", how="left").withColumn("word", F.coalesce("_v", "word"))
    words = regroup_words(mapped, row_id, out="_kept")
    return _join_back(df.select(row_id, *keep), words, row_id, out).select(row_id, *keep, out)


def vocabulary(df: DataFrame, ws_col: str) -> DataFrame:
    """Distinct words of an array column (partial aggregation per task)."""
    return explode_rows(df, ws_col, "word").distinct()


def replace_synonyms(df: DataFrame, ws_col: str, mapping: Mapping[str, str],
                     out: str | None = None) -> DataFrame:
    """T9 for a literal dictionary (inlined map, no shuffle)."""
    return df.withColumn(out or ws_col, T.map_words(ws_col, mapping))


def first_aspect(df: DataFrame, text_col: str, aspects: Iterable[str],
                 out: str = "aspect") -> DataFrame:
    """First word of the text found in an aspect-noun list (matched
    case-insensitively, returned as written); null when none."""
    words = [a.lower() for a in aspects]
    ws = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(T.WORD_RE), 0)
    return df.withColumn(out, F.try_element_at(F.filter(ws, lambda w: F.lower(w).isin(words)), F.lit(1)))


def sentiment_aspect(df: DataFrame, text_col: str, lexicon, aspects: Iterable[str]) -> DataFrame:
    """Per comment its ``sentiment`` (lexicon label) and first ``aspect``."""
    from opinio.operators.lexicon import score_comments
    return first_aspect(score_comments(df, lexicon, text_col, "_score", "sentiment").drop("_score"), text_col, aspects)


# Word-array steps of the cleaning chain, in the original notebook's order:
# stopwords, then stems, then synonyms (so a slang negation mapped to a
# stopword comes back after stopword removal).
DEFAULT_STEPS = ("stopwords", "stems", "synonyms")


def clean_comments(df: DataFrame, text_col: str = "comment", label_col: str | None = "label",
                   row_id: str = "row_id", stopwords: Iterable[str] = (),
                   stem_table: DataFrame | None = None, synonyms: Mapping[str, str] | None = None,
                   steps: Sequence[str] = DEFAULT_STEPS) -> DataFrame:
    """C10, the intended chain: drop null text, keep the first row per raw
    text, lower text and label, strip punctuation, trim, then the word steps
    in ``steps`` order -- ``stopwords`` (remove), ``stems`` (when a
    ``(word, stem)`` table is given), ``synonyms`` (when a map is given) --
    and rejoin with single spaces.
    """
    unknown = set(steps) - set(DEFAULT_STEPS)
    if unknown:
        raise ValueError(f"unknown cleaning steps {sorted(unknown)}")
    base = df.dropna(subset=[text_col])
    base = keep_first(base, [text_col], row_id)
    cols = {text_col: T.normalize(text_col)}
    if label_col:
        cols[label_col] = F.lower(label_col)
    base = base.withColumns(cols).withColumn("_ws", T.split_words(text_col))
    stopwords = list(stopwords)
    for step in steps:
        if step == "stopwords" and stopwords:
            base = base.withColumn("_ws", T.drop_words("_ws", stopwords))
        elif step == "stems" and stem_table is not None:
            keep = [c for c in base.columns if c not in (row_id, "_ws", text_col)]
            base = apply_word_map(base, "_ws", stem_table, row_id=row_id, keep=keep)
        elif step == "synonyms" and synonyms:
            base = base.withColumn("_ws", T.map_words("_ws", synonyms))
    return base.withColumn(text_col, T.join_words("_ws")).select(*df.columns)


def clean_comments_observed(df: DataFrame, text_col: str = "comment", label_col: str | None = "label",
                            row_id: str = "row_id") -> DataFrame:
    """C11, what the original per-split cleaning cells actually produce: each
    step restarts from the raw frame, so the net effect is keep-first per raw
    text (null texts form one kept group), text trimmed, label lower-cased."""
    out = keep_first(df, [text_col], row_id).withColumn(text_col, T.strip_ends(text_col))
    if label_col:
        out = out.withColumn(label_col, F.lower(label_col))
    return out
