"""Operator 5: removal of repeated multi-line chunks with content-defined borders.

Each line is hashed; a rolling hash over the last lines decides where a chunk ends.  The
borders depend on nearby lines only, so a passage shared by many documents is cut alike
whatever stands around it, and lines inserted before it shift nothing.  A chunk of two or
more lines, or of enough words, that occurs more than once in the corpus stays where it
occurs first and goes elsewhere.  Digests only propose: texts of proposed chunks are
compared byte by byte (grouped by the text itself) before anything is removed.

A chunk at either end of a passage also holds lines of its surroundings, so chunks alone
miss ends of passages and short passages (``dedup_lines``).  ``dedup_passages``, which the
query and the pipeline use, proposes overlapping runs of lines besides the chunks and removes
every repeated run of whole lines from ``LONG_LINE_WORDS`` words on.

Everything here is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinio.llm.common import WORD, broadcast_if_small, column, let, release_shuffles, settle

#: Lines under the rolling hash; a border where its first two hex digits are below BORDER
#: (0x55 of 0x100: after every third line on average).
ROLL_LINES = 2
BORDER = "55"
#: A chunk of a single line counts as a passage from so many words on.
LONG_LINE_WORDS = 25
#: Order of a document without id: after all others.
NO_ID = (1 << 63) - 1


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, rid, pos, first, n_lines, chunk, h``: the chunks of every text, in order.

    Borders: after line ``i`` if the rolling hash of lines ``i - 1, i`` is under BORDER, and
    around blank lines.  ``first`` is the chunk's first line (from 0), ``rid`` is
    ``xxhash64(id, text)``.  Null and empty texts have no chunk.
    """
    doc, text = column(docs, id_col).cast("long"), column(docs, text_col)
    df = docs.select(F.coalesce(doc, F.lit(NO_ID)).alias("doc"), F.xxhash64(doc, text).alias("rid"),
                     F.split(text, "\n", -1).alias("lines"))
    df = df.select("doc", "rid", "lines", F.transform("lines", lambda x: F.when(_has_word(x), F.md5(x.cast("binary")))).alias("hs"))
    rolled = lambda i: F.md5(F.concat_ws("", *[F.get("hs", i - k) for k in range(ROLL_LINES - 1, -1, -1)]).cast("binary"))
    ends = F.filter(
        F.transform("hs", lambda x, i: F.when(
            x.isNull() | F.get("hs", i + 1).isNull() | (F.substring(rolled(i), 1, 2) < BORDER), i)),
        lambda i: i.isNotNull())
    df = df.select("doc", "rid", "lines", ends.alias("ends"))
    spans = F.transform("ends", lambda e, k: F.struct(
        F.coalesce(F.when(k > 0, F.get("ends", k - 1) + 1), F.lit(0)).alias("first"), e.alias("last")))
    each = df.select("doc", "rid", "lines", F.posexplode_outer(spans).alias("pos", "at")).where("at IS NOT NULL")
    cut = F.slice("lines", F.col("at.first") + 1, F.col("at.last") - F.col("at.first") + 1)
    return each.select("doc", "rid", "pos", F.col("at.first").alias("first"),
                       (F.col("at.last") - F.col("at.first") + 1).alias("n_lines"), F.array_join(cut, "\n").alias("chunk"))


def _counts(chunk: Column, n_lines: Column) -> Column:
    """Whether a chunk may be removed: several lines, or one long line."""
    return (n_lines > 1) | (F.regexp_count(chunk, F.lit(WORD)) >= LONG_LINE_WORDS)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, rid, first, n_lines, chunk``: overlapping runs of lines of every text.

    From each line with a word on, and up to each, the shortest run of lines that reaches
    ``LONG_LINE_WORDS`` words.  Such a run depends on its own lines only: of a passage with so
    many words, wherever it stands, the same runs are proposed, and together they cover it.
    """
    doc, text = column(docs, id_col).cast("long"), column(docs, text_col)
    df = docs.select(F.coalesce(doc, F.lit(NO_ID)).alias("doc"), F.xxhash64(doc, text).alias("rid"),
                     F.split(text, "\n", -1).alias("lines"))
    # Each line in ``ws`` has a word, so a run has at most LONG_LINE_WORDS of them.
    most = LONG_LINE_WORDS

    def reach(run: Column) -> Column:
        """How many lines of ``run`` reach the words, null if all do not."""
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("m"))
        return F.aggregate(run, start, lambda a, s: F.when(
            a["n"] < most, F.struct((a["n"] + s["n"]).alias("n"), (a["m"] + 1).alias("m"))).otherwise(a),
            lambda a: F.when(a["n"] >= most, a["m"]))

    def reaches(ws: Column) -> Column:
        """Per line of ``ws`` the lengths of its run ahead and of that back."""
        long = lambda s, m: F.when(s["n"] >= most, F.lit(1)).otherwise(m)
        back = lambda k: F.reverse(F.slice(ws, F.greatest(k + 2 - most, F.lit(1)), F.least(k + 1, F.lit(most))))
        return F.transform(ws, lambda s, k: F.struct(
            long(s, reach(F.slice(ws, k + 1, most))).alias("ahead"), long(s, reach(back(k))).alias("back")))

    def both(ws: Column, ms: Column) -> Column:
        span = lambda a, b: F.struct(F.get(ws, a)["i"].alias("first"), F.get(ws, b)["i"].alias("last"))
        ahead = F.transform(ms, lambda m, k: F.when(m["ahead"].isNotNull(), span(k, k + m["ahead"] - 1)))
        # A run back that some line proposes ahead is there already.
        new = lambda m, k: m["back"].isNotNull() & ~F.get(ms, k - m["back"] + 1)["ahead"].eqNullSafe(m["back"])
        back = F.transform(ms, lambda m, k: F.when(new(m, k), span(k - m["back"] + 1, k)))
        return F.filter(F.concat(ahead, back), lambda s: s.isNotNull())

    sizes = F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    spans = let(F.filter(sizes, lambda s: s["n"] > 0), lambda ws: let(reaches(ws), lambda ms: both(ws, ms)))
    # Outer, as in ``chunks``: else Spark would work out the runs once more to filter by their number.
    each = df.select("doc", "rid", "lines", F.explode_outer(spans).alias("at")).where("at IS NOT NULL")
    n_lines = F.col("at.last") - F.col("at.first") + 1
    return each.select("doc", "rid", F.col("at.first").alias("first"), n_lines.alias("n_lines"),
                       F.array_join(F.slice("lines", F.col("at.first") + 1, n_lines), "\n").alias("chunk"))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, rid, drop``: per text with any, the places ``(first, n_lines)`` of chunks that occur
    earlier: in a smaller document, or further up in the same one.

    Rows that repeat an id and text are one document; rows without id come last, in order
    of ``rid``.
    """
    found = chunks(docs, id_col, text_col).where(_counts(F.col("chunk"), F.col("n_lines")))
    return (_later(found, "pos").groupBy("doc", "rid")
            .agg(F.sort_array(F.collect_set(F.struct("first", "n_lines"))).alias("drop")))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, rid, drop`` as ``repeated_chunks``, for chunks and ``passages`` together: places that
    overlap or touch are one.

    A removed line has an equal one at a smaller place, so the first of equal lines stays.
    """
    found = chunks(docs, id_col, text_col).where(_counts(F.col("chunk"), F.col("n_lines"))) \
        .select("doc", "rid", "first", "n_lines", "chunk").unionByName(passages(docs, id_col, text_col))
    later = _later(found, "first").select("doc", "rid", "first", (F.col("first") + F.col("n_lines")).alias("end")).distinct()
    in_order = Window.partitionBy("doc", "rid").orderBy("first", "end")
    reached = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("first") > reached, F.lit(True)).cast("int")
    joined = (later.withColumn("opens", opens).withColumn("k", F.sum("opens").over(in_order)).groupBy("doc", "rid", "k")
              .agg(F.min("first").alias("first"), F.max("end").alias("end")))
    return joined.groupBy("doc", "rid").agg(F.sort_array(F.collect_list(
        F.struct("first", (F.col("end") - F.col("first")).alias("n_lines")))).alias("drop"))


def _later(found: DataFrame, order: str) -> DataFrame:
    """Rows of ``found`` whose chunk occurs at a smaller place ``doc, rid, order``."""
    spark = found.sparkSession
    digest = F.xxhash64("chunk")
    place = F.struct("doc", "rid", order)
    # Digests propose: one small row per chunk, combined in the tasks before the shuffle.
    proposed = settle(found.select(digest.alias("h"), place.alias("p")).groupBy("h")
                      .agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo != hi").select("h"))
    release_shuffles(spark)
    proposed = broadcast_if_small(proposed, F.lit(16))
    again = found.withColumn("h", digest).join(proposed, "h", "left_semi")
    # Byte comparison: the text itself is the grouping key; only distinct texts per task move.
    kept_at = (again.groupBy("h", "chunk").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
               .where("lo != hi").select(F.col("h").alias("same_h"), F.col("chunk").alias("same"), "lo"))
    kept_at = settle(kept_at)
    release_shuffles(spark)
    small = broadcast_if_small(kept_at, F.lit(64) + F.octet_length("same"))
    return (again.join(small, (F.col("h") == F.col("same_h")) & (F.col("chunk") == F.col("same")))
            .where(place != F.col("lo")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, its text without repeated chunks, plus ``n_lines_removed``.

    Lines that stay keep their order and line ends; null text stays null; a text whose
    every line goes becomes empty.  A column already named ``n_lines_removed`` is replaced.
    """
    return _without(docs, repeated_chunks(docs, id_col, text_col), id_col, text_col)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``dedup_lines``, without any repeated run of whole lines from LONG_LINE_WORDS words on."""
    return _without(docs, repeated_passages(docs, id_col, text_col), id_col, text_col)


def _without(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str) -> DataFrame:
    drops = settle(drops)
    drops = broadcast_if_small(drops.select(F.col("doc").alias("__of"), F.col("rid").alias("__rid"), F.col("drop").alias("__drop")),
                               F.lit(64) + F.lit(24) * F.size("__drop"))
    names = [c for c in docs.columns if c != "n_lines_removed"]
    doc, text = column(docs, id_col).cast("long"), column(docs, text_col)
    df = docs.select(*[column(docs, c) for c in names], F.coalesce(doc, F.lit(NO_ID)).alias("__doc"),
                     F.xxhash64(doc, text).alias("__key"))
    df = df.join(drops, (F.col("__doc") == F.col("__of")) & (F.col("__key") == F.col("__rid")), "left")
    removed = F.coalesce(F.aggregate("__drop", F.lit(0), lambda n, d: n + d["n_lines"]), F.lit(0)).cast("long")
    # Runs of kept lines between the removed places, in order.
    lines = F.split(column(df, text_col), "\n", -1)
    edges = F.concat(F.col("__drop"), F.array(F.struct(F.size("__lines").alias("first"), F.lit(0).alias("n_lines"))))
    df = df.withColumn("__lines", F.when(F.col("__drop").isNotNull(), lines)).withColumn("__edges", edges)
    runs = F.transform("__edges", lambda d, i: F.struct(
        F.when(i > 0, F.get("__edges", i - 1)["first"] + F.get("__edges", i - 1)["n_lines"]).otherwise(0).alias("a"),
        d["first"].alias("b")))
    kept = F.flatten(F.transform(runs, lambda r: F.slice("__lines", r["a"] + 1, r["b"] - r["a"])))
    out = {text_col: F.when(F.col("__drop").isNull(), column(df, text_col)).otherwise(F.array_join(kept, "\n"))}
    return df.select(*[out[c].alias(c) if c in out else column(df, c) for c in names], removed.alias("n_lines_removed"))
