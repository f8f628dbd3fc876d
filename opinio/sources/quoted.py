"""Quoted CSV with embedded line breaks, read by many tasks per file (S1, S6, ST2).

Spark's own multi-line CSV reader gives each file to one task, since a line break may lie
inside a quoted field and only the text before it tells.  Here files are read as plain lines,
which split anywhere.  A first pass runs through each split twice at once, as if it began
outside and inside a quoted field, and keeps the two states it would end in.  These are
composed in the order of the splits (windows over one small row per split), so each split's
true state is known, and a second pass cuts the lines into records.  A record that crosses
splits comes as fragments and is put together by place.  Records are then parsed by Spark's
CSV parser.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits that begin inside a quoted field are broadcast as 8 bytes each, up to so many:
#: 128 MB splits of 2 PB, were all of them to.
MAX_INSIDE = 1 << 24
WHOLE, HEAD, MIDDLE, TAIL = 0, 1, 2, 3
#: Lines of a batch that are Python strings at once, and characters of the records that leave
#: a task together (a longer single record leaves alone).
LINES, RECORD_CHARS = 256, 1 << 20


def ends_inside(line: str, inside: bool, sep: str = ",", quote: str = '"') -> bool:
    """Whether the text after ``line`` is inside a quoted field, given how the line begins.

    A quote opens a field only as its first character, and is doubled inside one; after a
    closing quote the field lasts until the separator.
    """
    at = 0
    while True:
        if inside:
            close = line.find(quote, at)
            if close < 0:
                return True
            if line.startswith(quote, close + 1):
                at = close + 2
                continue
            inside, at = False, close + 1
        elif line.startswith(quote, at):
            inside, at = True, at + 1
            continue
        comma = line.find(sep, at)
        if comma < 0:
            return False
        at = comma + 1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """``(file, block), first, end`` of the rows of each split in a batch, in order."""
    n = batch.num_rows
    file, block = batch.column("file"), batch.column("block")
    cuts = [0]
    if n > 1:
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
        cuts += [i + 1 for i in pc.indices_nonzero(new).to_pylist()]
    for a, b in zip(cuts, [*cuts[1:], n], strict=True):
        if b > a:
            yield (file[a].as_py(), block[a].as_py()), a, b


class Ends:
    """First pass: per split the state after it, had it begun outside and inside."""

    def __init__(self, sep: str, quote: str):
        self.sep, self.quote = sep, quote

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, out, inside = None, False, True
        for batch in batches:
            lines = batch.column("value")
            quoted = pc.indices_nonzero(pc.match_substring(lines, self.quote)).to_numpy()
            for key, a, b in _runs(batch):
                if key != split:
                    if split:
                        yield self.row(split, out, inside)
                    split, out, inside = key, False, True
                for i in quoted[(quoted >= a) & (quoted < b)].tolist():
                    line = lines[i].as_py()
                    before = out
                    out = ends_inside(line, out, self.sep, self.quote)
                    inside = out if inside == before else ends_inside(line, inside, self.sep, self.quote)
        if split:
            yield self.row(split, out, inside)

    @staticmethod
    def row(split: tuple[str, int], out: bool, inside: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [split[0]], "block": pa.array([split[1]], pa.int64()),
                                           "after_out": [out], "after_in": [inside]})


class Records:
    """Second pass: lines to records and fragments of records."""

    def __init__(self, sep: str, quote: str, inside):
        self.sep, self.quote, self.inside = sep, quote, inside

    def __call__(self, batches):
        starts_inside, split, held, part, n, state = self.inside.value, None, [], WHOLE, 0, False

        def row(key, rows):
            place, parts, texts = zip(*rows, strict=True)
            count = len(rows)
            return pa.RecordBatch.from_pydict({
                "file": pa.array([key[0]] * count), "block": pa.array([key[1]] * count, pa.int64()),
                "n": pa.array(place, pa.int64()), "part": pa.array(parts, pa.int32()), "record": pa.array(texts, pa.string())})

        for batch in batches:
            lines, at = batch.column("value"), batch.column("at")
            for key, a, b in _runs(batch):
                rows, size = [], 0
                if key != split:
                    if held:  # the last record of the split before goes on in the next
                        yield row(split, [(n, MIDDLE if part == HEAD else TAIL, "\n".join(held))])
                    split, held, n, state = key, [], 0, at[a].as_py() in starts_inside
                    part = HEAD if state else WHOLE
                for line in (x for i in range(a, b, LINES) for x in lines.slice(i, min(LINES, b - i)).to_pylist()):
                    if size >= RECORD_CHARS:
                        yield row(key, rows)
                        rows, size = [], 0
                    if not held and not state and self.quote not in line:
                        rows.append((n, WHOLE, line))
                        size += len(line)
                        n += 1
                        continue
                    held.append(line)
                    if self.quote in line:
                        state = ends_inside(line, state, self.sep, self.quote)
                    if not state:
                        rows.append((n, part, "\n".join(held)))
                        size += len(rows[-1][2])
                        held, part, n = [], WHOLE, n + 1
                if rows:
                    yield row(key, rows)
        if held:
            yield row(split, [(n, MIDDLE if part == HEAD else TAIL, "\n".join(held))])


def lines_of(reader) -> DataFrame:
    """``value, file, block, at`` of a text reader's lines; ``at`` names the split."""
    lines = reader.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.withColumn("at", F.xxhash64("file", "block"))


def states(lines: DataFrame, sep: str = ",", quote: str = '"') -> DataFrame:
    """``file, block, inside``: whether each split begins inside a quoted field."""
    from opinio.session import checkpoint_root
    checkpoint_root(lines.sparkSession)
    ends = lines.select("value", "file", "block").mapInArrow(
        Ends(sep, quote), "file string, block long, after_out boolean, after_in boolean").checkpoint()
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # A split either ends in one state whatever the start, or keeps the state, or turns it.
    fixed = F.col("after_out") == F.col("after_in")
    last_fixed = F.last(F.when(fixed, F.col("after_out")), ignorenulls=True).over(earlier)
    turned = (~fixed & F.col("after_out")).cast("long")
    ends = ends.withColumn("turns", F.coalesce(F.sum(turned).over(earlier), F.lit(0))).withColumn("from", last_fixed)
    at_fixed = F.coalesce(F.last(F.when(fixed, F.col("turns")), ignorenulls=True).over(earlier), F.lit(0))
    return ends.withColumn("since", F.col("turns") - at_fixed).select(
        "file", "block", ((F.col("since") + F.coalesce("from", F.lit(False)).cast("long")) % 2 == 1).alias("inside"))


def records(lines: DataFrame, sep: str = ",", quote: str = '"') -> DataFrame:
    """``file, block, n, record``: the records of CSV files given as :func:`lines_of`.

    ``block`` is the offset of the split in which a record begins and ``n`` its number there.
    A quoted field left open at the end of a file ends there.
    """
    spark = lines.sparkSession
    begun = states(lines, sep, quote).where("inside").select(F.xxhash64("file", "block").alias("at"))
    inside = [r["at"] for r in begun.limit(MAX_INSIDE + 1).collect()]
    if len(inside) > MAX_INSIDE:
        raise ValueError(f"more than {MAX_INSIDE} splits begin inside a quoted field: raise spark.sql.files.maxPartitionBytes")
    cut = lines.mapInArrow(Records(sep, quote, spark.sparkContext.broadcast(frozenset(inside))),
                           "file string, block long, n long, part int, record string")
    whole = cut.where(F.col("part") == WHOLE).drop("part")
    if not inside:  # a field left open is open in the last split only
        return cut.drop("part")
    # At most two fragments a split: what was begun before it and what it leaves open.
    order = Window.partitionBy("file").orderBy("block", "part")
    pieces = cut.where(F.col("part") != WHOLE).withColumn("k", F.sum((F.col("part") == TAIL).cast("int")).over(order))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("block", "part", "record"))), lambda s: s["record"])
    joined = pieces.groupBy("file", "k").agg(F.min(F.struct("block", "part", "n")).alias("first"), F.array_join(texts, "\n").alias("record"))
    return whole.unionByName(joined.select("file", "first.block", "first.n", "record"))


def parse(found: DataFrame, schema: str, header: bool = True, corrupt_col: str | None = None,
          sep: str = ",", quote: str = '"') -> DataFrame:
    """Records to the columns of ``schema``, next to ``file, block, n``.

    Blank records are skipped and, with ``header``, the first record of each file.
    """
    text = F.regexp_replace("record", "\r$", "")
    kept = found.where(~((F.col("block") == 0) & (F.col("n") == 0))) if header else found
    options = {"sep": sep, "quote": quote, "escape": quote, "multiLine": "true", "mode": "PERMISSIVE"}
    if corrupt_col:
        options["columnNameOfCorruptRecord"] = corrupt_col
    return (kept.select("file", "block", "n", text.alias("record")).where("record != ''")
            .select("file", "block", "n", F.from_csv("record", schema, options).alias("row"))
            .select("file", "block", "n", "row.*"))


def read_quoted(spark: SparkSession, path: str, schema: str, header: bool = True,
                corrupt_col: str | None = None) -> DataFrame:
    """CSV files with quotes and embedded line breaks, each read by as many tasks as it has
    splits: ``file, block, n`` (the row's place) and the columns of ``schema``."""
    lines = lines_of(spark.read.option("lineSep", "\n").text(path))
    return parse(records(lines), schema, header, corrupt_col)
