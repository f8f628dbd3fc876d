"""Operator 11: hard negatives by best-first search in STR-packed R-trees.

Vectors are scaled to integers, so scores (inner products) are exact.  Equal vectors of one
label are one point, with the smallest ids that any top list can need.  Points are dealt to
tiles by STR cuts fitted on a bounded sample, and each tile becomes one packed tree, written
once.  Queries (the distinct anchors) are broadcast in blocks of bounded size; a task searches
its trees one after the other for all queries of the block and keeps, over all its trees, the
best ``k`` of each query.  First the positives are searched, then, with their scores, the
windows of the negatives: a node is opened only if its interval of inner products meets a
window and is not strictly below the k-th score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinio.llm.common import Scratch, broadcast_if_small, column, partitions_of
from opinio.llm.rtree import Tree, slicing, tile_of
from opinio.llm.vectors import matrix, scaled_floor, usable

#: A component ``x`` becomes ``floor(SCALE * x)``, at most MOST in size (sums stay longs).
SCALE, MOST = 256.0, 1 << 24
#: Positives of an anchor, negatives of a positive; window of a negative's score, in percent
#: of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Points of a tree; points that the cuts are fitted on, at most about so many; queries of a block.
TILE_ROWS, SAMPLE_ROWS, QUERY_BLOCK = 1024, 16_384, 8192
#: Order of a row without id: after all others.
NO_ID = (1 << 63) - 1


class Pack:
    """Vectors to their integers, as bytes (equal vectors are equal bytes)."""

    def __init__(self, width: int, scale: float):
        self.width, self.scale = width, scale

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = scaled_floor(matrix(b.column("vector"), self.width), self.scale, MOST).astype("<i4")
            vec = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], vec], [*b.schema.names[:-1], "vec"])


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), width).astype(np.int64)


class Tile:
    """Points to their tile of the nested cuts."""

    def __init__(self, width: int, cuts: tuple | None):
        self.width, self.cuts = width, cuts

    def __call__(self, batches):
        for b in batches:
            points = np.column_stack([b.column("label").to_numpy(), unpacked(b.column("vec"), self.width)])
            tile = pa.array(tile_of(self.cuts, points), pa.int64())
            yield pa.RecordBatch.from_arrays([tile, *b.columns], ["tile", *b.schema.names])


class Plant:
    """Points sorted by tile to rows of at most TILE_ROWS points of one tile."""

    def __call__(self, batches):
        held, tile = [], None
        for b in batches:
            for t, label, vec, ids in zip(*[b.column(c).to_pylist() for c in ("tile", "label", "vec", "ids")], strict=True):
                if held and (t != tile or len(held) == TILE_ROWS):
                    yield self.row(held)
                    held = []
                tile = t
                held.append((label, vec, ids))
        if held:
            yield self.row(held)

    @staticmethod
    def row(held: list) -> pa.RecordBatch:
        labels, vecs, ids = zip(*held, strict=True)
        return pa.RecordBatch.from_pydict({
            "labels": pa.array([list(labels)], pa.list_(pa.int64())), "vecs": pa.array([b"".join(vecs)], pa.binary()),
            "ids": pa.array([[list(i) for i in ids]], pa.list_(pa.list_(pa.int64())))})


class Windows:
    """Best ``k`` ``(score, id)`` of one query in each of its score windows."""

    __slots__ = ("k", "lo", "hi", "best", "kth")

    def __init__(self, spans: list[tuple[int, int]], k: int):
        self.k = k
        self.lo, self.hi = [s[0] for s in spans], [s[1] for s in spans]
        self.best: list[list] = [[] for _ in spans]
        #: Scores strictly below these are of no use.
        self.kth = list(self.lo)

    def needs(self, lo: float, hi: float) -> bool:
        return any(hi >= t and lo <= m for t, m in zip(self.kth, self.hi, strict=True))

    def take(self, scores: np.ndarray, allowed: np.ndarray, ids: list[list[int]], rows: np.ndarray) -> None:
        for w, (kth, most) in enumerate(zip(self.kth, self.hi, strict=True)):
            hit = np.flatnonzero(allowed & (scores >= kth) & (scores <= most))
            if len(hit):
                found = [(-int(scores[h]), i) for h in hit for i in ids[rows[h]]]
                self.best[w] = sorted(self.best[w] + found)[:self.k]
                if len(self.best[w]) == self.k:
                    self.kth[w] = max(kth, -self.best[w][-1][0])


class Search:
    """Trees to the best points of each query over all trees of the task."""

    def __init__(self, block, width: int, same_label: bool, k: int):
        self.block, self.width, self.same, self.k = block, width, same_label, k

    def __call__(self, batches):
        keys, labels, vecs, spans = self.block.value
        queries = np.frombuffer(b"".join(vecs), "<i4").reshape(len(vecs), self.width).astype(np.int64)
        state = [Windows(s, self.k) for s in spans]
        for b in batches:
            for row in range(b.num_rows):
                ids = b.column("ids")[row].as_py()
                points = np.frombuffer(b.column("vecs")[row].as_py(), "<i4").reshape(-1, self.width).astype(np.int64)
                self.search(Tree(points, np.array(b.column("labels")[row].as_py(), np.int64)), ids, queries, labels, state)
        out = [(keys[q], w, score, i) for q, s in enumerate(state) for w, best in enumerate(s.best) for score, i in best]
        if out:
            key, window, score, found = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"ck": pa.array(key, pa.string()), "span": pa.array(window, pa.int32()),
                                              "score": pa.array([-s for s in score], pa.int64()), "id": pa.array(found, pa.int64())})

    def search(self, tree: Tree, ids: list, queries: np.ndarray, labels: list[int], state: list[Windows]) -> None:
        root = slice(len(tree.below) - 1, None)
        wanted = (lambda own: lambda lo, hi: lo <= own <= hi) if self.same else (lambda own: lambda lo, hi: not lo == hi == own)
        least, greatest = tree.intervals(queries, root)
        live = [q for q in range(len(queries)) if state[q].needs(least[q, 0], greatest[q, 0])
                and wanted(labels[q])(tree.label_lo[-1], tree.label_hi[-1])]
        least, greatest = tree.intervals(queries[live], slice(None))
        kind = least.dtype
        points = tree.points.astype(kind)
        for n, q in enumerate(live):
            own, windows = labels[q], state[q]

            def leaf(scores, there, rows, own=own, windows=windows):
                windows.take(scores, (there == own) == self.same, ids, rows)
            tree.search(queries[q].astype(kind), points, least[n], greatest[n], wanted(own), windows.needs, leaf)


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``keys, best``: the first ``k`` ``(score, id)`` over the tasks, as an ordered array."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    first = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    ordered = F.sort_array(F.collect_list(F.struct("n", "score", "id")))
    return first.groupBy(*keys).agg(F.transform(ordered, lambda x: F.struct(x["score"], x["id"])).alias("best"))


def _planted(classes: DataFrame, n: int, width: int, scratch: Scratch) -> DataFrame:
    """The trees' tiles, one row each: STR cuts of a sample, then all points by tile."""
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    drawn = classes.where(F.pmod(F.xxhash64("label", "vec"), F.lit(1 << 30)) < int(share * (1 << 30))).select("label", "vec").collect()
    sample = np.array([[r.label, *np.frombuffer(r.vec, "<i4")] for r in drawn], np.int64).reshape(len(drawn), width + 1)
    cuts = slicing(sample, -(-n // TILE_ROWS))
    tiled = classes.mapInArrow(Tile(width, cuts), "tile long, label long, vec binary, ids array<long>")
    dealt = tiled.repartition(partitions_of(classes.sparkSession), "tile").sortWithinPartitions("tile")
    return scratch.table(dealt.mapInArrow(Plant(), "labels array<long>, vecs binary, ids array<array<long>>"))


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str | Column = "label",
         vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, scale: float = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows with an id for which ``anchor`` holds.  An anchor's positives are its
    first other rows of the same label by falling score, then id; each positive's negatives
    are the first rows of other labels with ``low * positive_score <= 100 * negative_score <=
    high * positive_score``.  Rows with a null label, a null vector or a null or non-finite
    component take no part.  A row without id is no anchor and comes last among equal scores;
    rows that repeat id, label and vector are one row, and rows with the anchor's own id are not
    among its positives.  Vectors shorter than the longest count as filled up with zeros.  A
    positive without a negative in its window has no row; an empty table gives no rows.  The
    label is cast to a long.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("needs 0 <= low <= high <= 100")
    spark = vectors.sparkSession
    label = column(vectors, label_col) if isinstance(label_col, str) else label_col
    vector = column(vectors, vector_col)
    given = column(vectors, id_col).cast("long")
    own = vectors.select(F.coalesce(given, F.lit(NO_ID)).alias("id"), label.cast("long").alias("label"),
                         (given.isNotNull() & F.coalesce(anchor, F.lit(False))).alias("anchor"), vector.alias("vector"))
    own = own.where(F.col("label").isNotNull() & usable(F.col("vector")))
    width = own.agg(F.max(F.size("vector"))).first()[0] or 0
    scratch = Scratch(spark, "hardneg")
    if not width:  # nothing, or empty vectors: one component of zero
        own, width = own.withColumn("vector", F.array(F.lit(0.0))), 1
    # Written once: points and queries are both read from it.
    packed = scratch.table(own.mapInArrow(Pack(width, scale), "id long, label long, anchor boolean, vec binary")
                           .groupBy("id", "label", "vec").agg(F.max("anchor").alias("anchor")))
    ck = F.sha2(F.concat_ws(":", F.col("label").cast("string"), F.hex("vec")), 256).alias("ck")
    first = Window.partitionBy("label", "vec").orderBy("id")
    most = max(positives + 1, negatives)
    classes = scratch.table(packed.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
                            .groupBy("label", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n = classes.count()
    trees = _planted(classes, n, width, scratch)
    anchors = scratch.table(packed.where("anchor").select(F.col("id").alias("anchor_id"), ck, "label", "vec"))
    queries = scratch.table(anchors.groupBy("ck").agg(F.any_value("label").alias("label"), F.any_value("vec").alias("vec")))
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    found, against = [], []
    for b in range(blocks):  # one block at a time is on the driver
        block = queries.where(F.pmod(F.xxhash64("ck"), F.lit(blocks)) == b).collect()
        positive = scratch.table(_top(_searched(trees, block, None, width, True, positives + 1), ["ck"], positives + 1))
        windows = {r.ck: _windows(r.best, low, high) for r in positive.collect()}
        negative = _searched(trees, block, windows, width, False, negatives)
        spans = [(c, i, p) for c, w in windows.items() for i, (_, _, p) in enumerate(w)]
        of = spark.createDataFrame(spans, "of string, at int, positive_score long")
        scored = negative.join(F.broadcast(of), (F.col("ck") == F.col("of")) & (F.col("span") == F.col("at")))
        found.append(positive)
        against.append(scratch.table(_top(scored, ["ck", "positive_score"], negatives)))
    for table in (packed, classes, trees, queries):
        scratch.drop(table)
    every = lambda tables: tables[0] if len(tables) == 1 else tables[0].unionByName(every(tables[1:]))
    best = broadcast_if_small(every(found), F.lit(64) + F.lit(16) * F.size("best"))
    pairs = (anchors.select("anchor_id", "ck").join(best, "ck")
             .select("anchor_id", "ck", F.slice(F.filter("best", lambda x: x["id"] != F.col("anchor_id")), 1, positives).alias("best"))
             .select("anchor_id", "ck", F.explode("best").alias("p"))
             .select("anchor_id", "ck", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score")))
    hard = broadcast_if_small(every(against), F.lit(64) + F.lit(16) * F.size("best"))
    mined = pairs.join(hard, ["ck", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("rank", "n"))
    there = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return mined.select("anchor_id", there("positive_id").alias("positive_id"), (F.col("rank") + 1).alias("rank"),
                        there("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))


def _windows(best: list, low: int, high: int) -> list[tuple[int, int, int]]:
    """``(least, greatest, positive score)`` of each different score that leaves a window."""
    each = [(-(-low * s // 100), high * s // 100, s) for s in sorted({x.score for x in best}, reverse=True)]
    return [w for w in each if w[0] <= w[1]]


def _searched(trees: DataFrame, block: list, windows: dict | None, width: int, same_label: bool, k: int) -> DataFrame:
    whole = [(-(1 << 62), 1 << 62)]
    spans = [whole if windows is None else [(lo, hi) for lo, hi, _ in windows.get(r.ck, [])] for r in block]
    sent = trees.sparkSession.sparkContext.broadcast(
        ([r.ck for r in block], [r.label for r in block], [bytes(r.vec) for r in block], spans))
    return trees.mapInArrow(Search(sent, width, same_label, k), "ck string, span int, score long, id long")
