"""Counts of words and of neighbouring words, made from word arrays in Arrow batches.

A task cuts its rows into runs of about a million words, numbers the words of a run and counts
numbers instead of strings; what leaves it is one row per distinct word or pair of a run (or of a
row of the table), which the caller adds up by key as usual.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that are numbered together; bounds a task's memory.
RUN_WORDS = 1 << 20
#: Rows of a batch that leaves a task.
OUT_ROWS = 1 << 16


def _numbered(own: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and number of each word (-1: null), and the words by number."""
    row = np.repeat(np.arange(len(own)), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    coded = own.flatten().dictionary_encode()
    return row, coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _runs(batches: Iterator[pa.RecordBatch], col: str) -> Iterator[pa.RecordBatch]:
    """Batches put together, or cut by rows, to runs of about ``RUN_WORDS`` words."""
    held, words = [], 0
    for batch in batches:
        ends = np.cumsum(batch.column(col).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + RUN_WORDS - words, side="right")))
            held.append(batch.slice(at, stop - at))
            words += int(ends[stop - 1] - before)
            at = stop
            if words >= RUN_WORDS or at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, words = [], 0
    if words:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _out(columns: dict) -> Iterator[pa.RecordBatch]:
    yield from pa.table(columns).to_batches(max_chunksize=OUT_ROWS)


def run_word_counts(df: DataFrame, ws_col: str) -> DataFrame:
    """``(word, n)``: how often a word stands in the table; null words are passed over."""

    def count(batches):
        for run in _runs(batches, ws_col):
            _, word, names = _numbered(run.column(ws_col))
            n = np.bincount(word[word >= 0], minlength=len(names))
            yield from _out({"word": names, "n": pa.array(n, pa.int64())})

    return df.select(ws_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(df: DataFrame, ws_col: str, window: int = 1, either_way: bool = False, known: DataFrame | None = None) -> DataFrame:
    """``(a, b, n)``: how often ``b`` stands at most ``window`` words after ``a`` in a row.

    With ``either_way`` a pair counts in either order and is given once, the word that is less
    in bytes first.  A null word is in no pair but keeps its place.  Pairs with a word that
    is not in ``known(word)``, if given, are dropped before the shuffle.
    """

    def count(batches):
        for run in _runs(batches, ws_col):
            row, word, names = _numbered(run.column(ws_col))
            if not len(names):
                continue
            size = len(names)
            if either_way:  # numbers in the order of the words' bytes
                by_bytes = np.empty(size, np.int64)
                order = pa.compute.sort_indices(names.cast(pa.binary())).to_numpy()
                by_bytes[order] = np.arange(size)
                word = np.where(word < 0, -1, by_bytes[word])
                names = names.take(pa.array(order))
            keys = []
            for k in range(1, window + 1):
                a, b = word[:-k], word[k:]
                there = (row[:-k] == row[k:]) & (a >= 0) & (b >= 0)
                a, b = a[there], b[there]
                keys.append(np.minimum(a, b) * size + np.maximum(a, b) if either_way else a * size + b)
            pairs, n = np.unique(np.concatenate(keys), return_counts=True)
            for at in range(0, len(pairs), OUT_ROWS):
                some = pairs[at:at + OUT_ROWS]
                yield from _out({"a": names.take(pa.array(some // size)), "b": names.take(pa.array(some % size)),
                                 "n": pa.array(n[at:at + OUT_ROWS], pa.int64())})

    made = df.select(ws_col).mapInArrow(count, "a string, b string, n long")
    if known is not None:
        made = made.join(known.select(F.col("word").alias("a")), "a", "left_semi").join(known.select(F.col("word").alias("b")), "b", "left_semi")
    return made.groupBy("a", "b").agg(F.sum("n").alias("n"))


def row_word_counts(df: DataFrame, ws_col: str, key: str) -> DataFrame:
    """``(key, word, n)``: how often a word stands in a row; no shuffle.  Rows with equal keys
    are counted each for itself; null words are passed over."""
    kind = df.schema[key].dataType.simpleString()

    def count(batches):
        for run in _runs(batches, ws_col):
            row, word, names = _numbered(run.column(ws_col))
            size = len(names)
            if not size:
                continue
            pairs, n = np.unique((row * size + word)[word >= 0], return_counts=True)
            for at in range(0, len(pairs), OUT_ROWS):
                some = pairs[at:at + OUT_ROWS]
                yield from _out({key: run.column(key).take(pa.array(some // size)), "word": names.take(pa.array(some % size)),
                                 "n": pa.array(n[at:at + OUT_ROWS], pa.int64())})

    return df.select(key, ws_col).mapInArrow(count, f"`{key}` {kind}, word string, n long")
