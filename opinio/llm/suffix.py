"""Operator 10: removal of byte strings that also start in a smaller document.

The method is content-sampled windows, not prefix doubling over all positions: ranking every
byte position of the corpus would shuffle many times the input (README, with figures).  What is
kept of doubling is that positions are ranked by longer prefixes round by round, and only those
whose rank is shared go on.  The first ranks are taken at positions chosen by content: a
50-byte window is represented by the least-hashed 20-byte string inside it, which equal
windows choose alike.

1. length 20: the digest of each chosen string is its rank.  Ranks that occur in one
   document only are dropped, with all windows they represent.
2. up to 80 bytes: the consecutive windows with one representative are a segment; the pair
   (rank, digest of the segment) is the next rank.  An occurrence whose pair also occurs in
   a smaller document is removed whole.
3. length 50, every position, only where a rank of round 1 splits into several pairs of
   round 2 (around the ends of copies): the windows of the segments in each pair's smallest
   document are compared, and those with an equal window in a smaller document are removed.
   The segments of one rank meet in one task; a rank with very many is dealt by window.

Digests stand for sort ranks: only their equality matters here.  The numpy kernels work
inside Arrow tasks; all grouping is Spark's, with partial aggregation, and joins leave hot
ranks to Spark's skew splitting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.llm import tokens
from opinio.llm.common import Scratch, broadcast_if_small, column, release_shuffles, settle

#: Length of repeated strings, and of the strings that represent them.
LENGTH, GRAM = 50, 20
#: Bytes worked on at once: its 8-byte arrays stay in a processor cache.
SLICE = 256 << 10
#: Different segments of one rank that are compared in one place; more go window by window.
GROUP = 2000
#: Windows of one segment at most; a longer run of windows is several segments.
RUN = 256
#: Order of a document without id: after all others.
NO_ID = (1 << 63) - 1

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(31337))
_TABLES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64) | _U(1)
_BASES = [int(x) | 1 for x in _RNG.integers(1, 1 << 62, 2, dtype=np.uint64)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(n, SLICE + 4 * LENGTH)
        base, inverse = np.full(size, _U(_BASES[which])), np.full(size, _U(pow(_BASES[which], -1, 1 << 64)))
        base[0] = inverse[0] = 1
        _POWERS[which] = np.cumprod(base, dtype=_U), np.cumprod(inverse, dtype=_U)
    return _POWERS[which]


class Rolling:
    """Digests of any byte range of a buffer from one running sum."""

    def __init__(self, data: np.ndarray, which: int = 0):
        powers, self.inverse = _powers(which, len(data) + 1)
        self.total = np.zeros(len(data) + 1, _U)
        np.cumsum(_TABLES[which][data] * powers[:len(data)], out=self.total[1:])

    def every(self, n: int) -> np.ndarray:
        """Digest of the ``n`` bytes from each position."""
        out = self.total[n:] - self.total[:-n]
        out *= self.inverse[:len(out)]
        out ^= out >> _U(29)
        out *= _U(0xBF58476D1CE4E5B9)
        out ^= out >> _U(32)
        return out

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tokens.mix64((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(_U))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out, n = x, 1
    while 2 * n <= w:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    return np.minimum(out[:len(x) - w + 1], out[w - n:]) if n < w else out


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """``(first row, last row + 1, from byte, to byte)``: rows together up to SLICE bytes;
    a longer text in pieces that overlap by a window."""
    for lo, hi in tokens.slices(offsets, SLICE):
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= 2 * SLICE:
            yield lo, hi, a, b
        else:
            for p in range(a, b, SLICE):
                yield lo, hi, p, min(b, p + SLICE + LENGTH - 1)
                if p + SLICE + LENGTH - 1 >= b:
                    break


def segments(raw: np.ndarray, offsets: np.ndarray, with_digest: bool) -> Iterator[tuple]:
    """``rank, row, first window, number of windows[, digest]`` arrays, piece by piece.

    A segment that a piece border cuts becomes two; cut places depend on the text's own
    bytes only (pieces of a long text start at its start).
    """
    for lo, hi, a, b in _pieces(offsets):
        n = b - a - LENGTH + 1
        if n <= 0:
            continue
        data = raw[a:b]
        rolling = Rolling(data)
        least = _sliding_min(rolling.every(GRAM), LENGTH - GRAM + 1)
        bounds = offsets[lo:hi + 1] - a
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        inside = np.ones(n, bool)
        for edge in bounds[1:-1].tolist():  # windows that run over the end of a text
            inside[max(0, edge - LENGTH + 1):edge] = False
            if edge < n:
                new[edge] = True
        new[1:] |= inside[1:] != inside[:-1]
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, n))
        real = inside[start]
        start, count = start[real], count[real]
        parts = -(-count // RUN)
        if parts.max(initial=0) > 1:  # periodic bytes: one representative for a long way
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start, left = np.repeat(start, parts) + nth * RUN, np.repeat(count, parts) - nth * RUN
            count = np.minimum(left, RUN)
        row = np.searchsorted(bounds, start, "right") - 1
        out = (least[start].view(np.int64), row + lo, start + a - offsets[row + lo], count)
        if with_digest:  # 56 bits of the content's digest and 8 of the number of windows
            digest = rolling.ranges(start, start + count + LENGTH - 1)
            out += ((digest & _U(~0xFF & (1 << 64) - 1) | (count - 1).astype(_U)).view(np.int64),)
        yield out


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = tokens.text_bytes(batch.column("__text"))
        doc = np.asarray(batch.column("doc"))
        for rank, row, _, _ in segments(raw, offsets, False):
            yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(doc[row])], ["rank", "doc"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = tokens.text_bytes(batch.column("__text"))
        doc, rid = np.asarray(batch.column("doc")), np.asarray(batch.column("rid"))
        for rank, row, start, _, digest in segments(raw, offsets, True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (rank, digest, doc[row], rid[row], start)],
                ["rank", "digest", "doc", "rid", "start"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed segments of each text."""
    for batch in batches:
        raw, offsets = tokens.text_bytes(batch.column("__text"))
        for i, places in enumerate(batch.column("places").to_pylist()):
            text, rows = raw[offsets[i]:offsets[i + 1]], []
            doc, rid = batch.column("doc")[i].as_py(), batch.column("rid")[i].as_py()
            for p in places:
                content = text[p["start"]:p["start"] + p["n"] + LENGTH - 1].tobytes()
                rows.append((p["rank"], p["large"], doc, rid, p["start"], content))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CONTENT, strict=True)],
                    ["rank", "large", "doc", "rid", "start", "bytes"])


_CONTENT = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of segments that come in order of rank and document: those already seen in a
    smaller document of their rank, as runs of bytes."""
    rank, first = None, {}
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("rank", "doc", "rid", "start", "bytes")]
        out: list[tuple[int, int, int]] = []
        for r, doc, rid, start, content in zip(*cols, strict=True):
            if r != rank:
                rank, first = r, {}
            run = None
            for i in range(len(content) - LENGTH + 1):
                if first.setdefault(content[i:i + LENGTH], doc) < doc:
                    if run is not None and i <= run[1]:
                        run[1] = i + LENGTH
                    else:
                        if run is not None:
                            out.append((rid, start + run[0], start + run[1]))
                        run = [i, i + LENGTH]
            if run is not None:
                out.append((rid, start + run[0], start + run[1]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ()))],
                                         ["rid", "start", "end"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each segment, under two digests."""
    for batch in batches:
        for doc, rid, start, content in zip(*(batch.column(c) for c in ("doc", "rid", "start", "bytes")), strict=True):
            data = np.frombuffer(content.as_py(), np.uint8)
            at = np.arange(len(data) - LENGTH + 1)
            one, two = (Rolling(data, k).ranges(at, at + LENGTH).view(np.int64) for k in (0, 1))
            same = [np.full(len(at), x.as_py(), np.int64) for x in (doc, rid)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one, two, *same, at + start.as_py())],
                                             ["w1", "w2", "doc", "rid", "start"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = tokens.text_bytes(batch.column("__text"))
        spans = batch.column("spans").to_pylist()
        n, removed, sha = [], [], []
        for i, cuts in enumerate(spans):
            text = raw[offsets[i]:offsets[i + 1]]
            digest, at = hashlib.sha256(), 0
            for s in cuts or ():
                digest.update(text[at:s["start"]])
                at = s["end"]
            digest.update(text[at:])
            n.append(len(text))
            removed.append(sum(s["end"] - s["start"] for s in cuts or ()))
            sha.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
             pa.array([len(s or ()) for s in spans], pa.int64()), pa.array(sha, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc, text = column(docs, id_col).cast("long"), F.coalesce(column(docs, text_col), F.lit(""))
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(doc, text).alias("rid"), text.alias("__text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rid, spans``: per text with any, its maximal runs of bytes to remove, in order.

    ``rid`` is ``xxhash64(id, text)``: rows that repeat id and text share their spans.
    Intermediates are written to the shared folder and removed on the way.
    """
    with Scratch(docs.sparkSession, "suffix") as scratch:
        return settle(_spans(_keyed(docs, id_col, text_col), scratch))


def _spans(texts: DataFrame, scratch: Scratch) -> DataFrame:
    spark = texts.sparkSession
    shared = scratch.table(texts.select("doc", "__text").mapInArrow(_ranks, "rank long, doc long")
                           .groupBy("rank").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
                           .where("lo < hi").select("rank"))
    release_shuffles(spark)
    hits = scratch.table(texts.select("doc", "rid", "__text").mapInArrow(
        _occurrences, "rank long, digest long, doc long, rid long, start long").join(shared.hint("shuffle_hash"), "rank"))
    release_shuffles(spark)

    # Per pair (rank, digest) its smallest document; ranks with several such are split.
    pairs = scratch.table(hits.groupBy("rank", "digest").agg(F.min("doc").alias("lo"), F.max("doc").alias("last")))
    split = (pairs.groupBy("rank").agg(F.min("lo").alias("a"), F.max("lo").alias("b"), F.count(F.lit(1)).alias("k"))
             .where("a < b").select("rank", (F.col("k") > GROUP).alias("large")))
    wanted = (pairs.join(split, "rank", "left").where("lo < last OR large IS NOT NULL")
              .select("rank", "digest", "lo", "large"))
    placed = scratch.table(hits.join(wanted, ["rank", "digest"]).where("doc > lo OR large IS NOT NULL")
                           .select("rid", "start", (F.col("digest").bitwiseAND(RUN - 1) + 1).alias("n"), "rank", "large",
                                   (F.col("doc") > F.col("lo")).alias("later")))
    for done in (hits, pairs, shared):
        scratch.drop(done)
    release_shuffles(spark)
    whole = placed.where("later").select("rid", "start", (F.col("start") + F.col("n") + (LENGTH - 1)).alias("end"))
    by_text = (placed.where("NOT later").groupBy("rid")
               .agg(F.collect_set(F.struct("start", "n", "rank", "large")).alias("places")))
    contents = scratch.table(texts.join(by_text, "rid").select("doc", "rid", "places", "__text")
                             .mapInArrow(_contents, "rank long, large boolean, doc long, rid long, start long, bytes binary"))
    release_shuffles(spark)
    # Usual ranks: their few segments meet in one place, window by window.
    few = (contents.where("NOT large").select("rank", "doc", "rid", "start", "bytes").repartition("rank")
           .sortWithinPartitions("rank", "doc").mapInArrow(_compare, "rid long, start long, end long"))
    # Ranks with very many different segments: every window is its own key.
    windows = (contents.where("large").select("doc", "rid", "start", "bytes")
               .mapInArrow(_windows, "w1 long, w2 long, doc long, rid long, start long"))
    ranked = (windows.groupBy("w1", "w2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
              .where("lo < hi").select("w1", "w2", "lo"))
    many = (windows.join(ranked.hint("shuffle_hash"), ["w1", "w2"]).where("doc > lo")
            .select("rid", "start", (F.col("start") + LENGTH).alias("end")))
    cut = whole.union(few).union(many).groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("found"))
    return cut.select("rid", _union(F.col("found")).alias("spans"))


def _union(found):
    """Maximal runs covered by sorted intervals."""
    runs = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")
    start = F.struct(runs.alias("runs"), F.lit(-1).cast("long").alias("s"), F.lit(-1).cast("long").alias("e"))

    def step(acc, x):
        joins = (acc["s"] >= 0) & (x["start"] <= acc["e"])
        done = F.when(joins | (acc["s"] < 0), acc["runs"]).otherwise(
            F.concat(acc["runs"], F.array(F.struct(acc["s"].alias("start"), acc["e"].alias("end")))))
        return F.struct(done.alias("runs"), F.when(joins, acc["s"]).otherwise(x["start"]).alias("s"),
                        F.when(joins, F.greatest(acc["e"], x["end"])).otherwise(x["end"]).alias("e"))

    return F.aggregate(found, start, step, lambda acc: F.concat(
        acc["runs"], F.array(F.struct(acc["s"].alias("start"), acc["e"].alias("end")))))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    Each byte covered by a 50-byte string that also starts in a document with a smaller id
    goes; strings are judged on the input.  Null text is empty; texts under 50 bytes lose
    nothing; strings repeated inside one document, or among rows with one id, stay; rows
    without id come after all others and do not remove from each other.
    """
    texts = _keyed(docs, id_col, text_col)
    spans = repeated_spans(docs, id_col, text_col)
    spans = broadcast_if_small(spans, F.lit(32) + F.lit(24) * F.size("spans"))
    return (texts.select("doc_id", "rid", "__text").join(spans, "rid", "left").select("doc_id", "spans", "__text")
            .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
