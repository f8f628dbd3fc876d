"""Operator 9: benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are runs of 13 words of benchmark items (an item with fewer words is one
pattern).  For each pattern length a block shift table tells, from the last two words
under a text position, how far the next possible match is; where the shift is 0, a
suffix-hash bucket selects the patterns that end in these two words; word digests and then
the words' bytes are compared directly.

The search skips through a batch of texts in lock step: texts are dealt into segments, one
cursor each, and every step moves all cursors by their shifts at once in numpy.  There is
no shuffle; texts stay in their tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.llm import tokens
from opinio.llm.common import column

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
HIT_SHARE = 20
#: Benchmark text broadcast at once; more is searched in blocks of this size, one pass each.
BLOCK_BYTES = 32_000_000
#: Words of a text that one cursor walks.
SEGMENT = 256


class WuManber:
    """Patterns of one length ``m`` (in words) and their tables."""

    def __init__(self, m: int, patterns: dict[bytes, set[str]], digests: dict[bytes, np.ndarray]):
        self.m, self.b = m, min(2, m)
        self.texts = list(patterns)
        self.items = [sorted(patterns[t]) for t in self.texts]
        self.words = np.array([digests[t] for t in self.texts], np.uint64).reshape(len(self.texts), m)
        blocks = [self.block(self.words, j) for j in range(self.b - 1, m)]
        bits = max(16, int(np.ceil(np.log2(16 * len(self.texts) * len(blocks) + 1))))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, m - self.b + 1, np.uint16)
        for j, block in enumerate(blocks):
            np.minimum.at(self.shift, (block & self.mask).astype(np.int64), m - self.b - j)
        # suffix-hash buckets: pattern numbers in order of their last block
        self.order = np.argsort(blocks[-1], kind="stable")
        self.suffix = blocks[-1][self.order]

    def block(self, words: np.ndarray, end: int) -> np.ndarray:
        """Hash of the block of each row of ``words`` that ends at column ``end``."""
        return self.hash(words[..., end - 1] if self.b == 2 else None, words[..., end])

    @staticmethod
    def hash(before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        return tokens.mix64(last if before is None else last + before * np.uint64(0x9E3779B97F4A7C15))

    def find(self, words: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
        """Confirmed occurrences: first word and pattern number of each."""
        ends = self._ends(words)
        if not len(ends):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        d = words.digest
        block = self.hash(d[ends - 1] if self.b == 2 else None, d[ends])
        lo, hi = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        starts, numbers = [], []
        k = 0
        while len(ends):
            left = lo + k < hi
            ends, lo, hi = ends[left], lo[left], hi[left]
            number = self.order[lo + k]
            same = np.ones(len(ends), bool)
            for j in range(self.m):
                same &= d[ends - self.m + 1 + j] == self.words[number, j]
            for end, n in zip(ends[same].tolist(), number[same].tolist(), strict=True):
                if words.text(end - self.m + 1, self.m) == self.texts[n]:
                    starts.append(end - self.m + 1)
                    numbers.append(n)
            k += 1
        return np.array(starts, np.int64), np.array(numbers, np.int64)

    def _ends(self, words: tokens.Words) -> np.ndarray:
        """Positions whose block has shift 0: the last words of possible matches."""
        first, last = words.first[:-1] + self.m - 1, words.first[1:]
        n = np.maximum(0, -(-(last - first) // SEGMENT))
        if not n.sum():
            return np.zeros(0, np.int64)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cur = np.repeat(first, n) + within * SEGMENT
        stop = np.minimum(np.repeat(last, n), cur + SEGMENT)
        d, found = words.digest, []
        while len(cur):
            block = self.hash(d[cur - 1] if self.b == 2 else None, d[cur])
            shift = self.shift[(block & self.mask).astype(np.int64)]
            hit = shift == 0
            if hit.any():
                found.append(cur[hit])
            cur = cur + np.maximum(shift, 1)
            on = cur < stop
            cur, stop = cur[on], stop[on]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def build(items: list[tuple[str, str]], window: int = WINDOW) -> list[WuManber]:
    """One matcher per pattern length from ``(item id, text)`` pairs."""
    patterns: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
    digests: dict[bytes, np.ndarray] = {}
    raw, offsets = tokens.text_bytes(pa.array([t for _, t in items], pa.string()))
    for lo, hi in tokens.slices(offsets):
        words = tokens.Words(raw, offsets, lo, hi, tokens.alphanumeric())
        for r in range(hi - lo):
            a, b = int(words.first[r]), int(words.first[r + 1])
            m = min(window, b - a)
            for i in range(a, b - m + 1 if m else a):
                key = words.text(i, m)
                patterns[m][key].add(items[lo + r][0])
                digests[key] = words.digest[i:i + m]
    return [WuManber(m, p, digests) for m, p in sorted(patterns.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Search:
    """Arrow mapper: adds the hits of one benchmark block to ``n_words, hits, items``."""

    def __init__(self, matchers, last: bool):
        self.matchers, self.last = matchers, last

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers, is_word = self.matchers.value, tokens.alphanumeric()
        for batch in batches:
            names = batch.schema.names
            raw, offsets = tokens.text_bytes(batch.column("__text"))
            spans = [[(s["start"], s["end"]) for s in v] for v in batch.column("hits").to_pylist()]
            items = [set(v) for v in batch.column("items").to_pylist()]
            n_words = np.zeros(batch.num_rows, np.int64)
            for lo, hi in tokens.slices(offsets):
                words = tokens.Words(raw, offsets, lo, hi, is_word)
                n_words[lo:hi] = np.diff(words.first)
                for matcher in matchers:
                    starts, numbers = matcher.find(words)
                    rows = words.row[starts] if len(starts) else starts
                    for s, n, r in zip((starts - words.first[rows]).tolist(), numbers.tolist(), rows.tolist(), strict=True):
                        spans[lo + r].append((s, s + matcher.m))
                        items[lo + r].update(matcher.items[n])
            new = {"n_words": pa.array(n_words), "hits": pa.array(
                [[{"start": a, "end": b} for a, b in merged(s)] for s in spans], _SPANS),
                "items": pa.array([sorted(i) for i in items], pa.list_(pa.string()))}
            keep = [n for n in names if not (self.last and n == "__text")]
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in keep], keep)


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in blocks of about ``block_bytes`` of text.

    The size is measured first; only one block at a time is on the driver.
    """
    slim = benchmark.select(F.coalesce(column(benchmark, id_col).cast("string"), F.lit("")).alias("id"),
                            column(benchmark, text_col).alias("text")).where("text IS NOT NULL")
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for k in range(blocks):
        part = slim if blocks == 1 else slim.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        yield [(r.id, r.text) for r in part.collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, hit_share: int = HIT_SHARE,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns plus ``n_words, hits, items, n_hit, contaminated`` per document.

    ``hits`` are word intervals (end exclusive) inside occurrences of benchmark windows,
    ``items`` the ids of the items that occur, as sorted strings.  Null and empty texts
    have no words and are clean; an item without id is listed as the empty string; repeated
    items count once; an empty benchmark leaves everything clean.
    """
    own = ("n_words", "hits", "items", "n_hit", "contaminated")
    kept = [c for c in keep if c not in own]
    df = docs.select(*[column(docs, c) for c in kept], F.lit(0).cast("long").alias("n_words"),
                     F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)").alias("hits"),
                     F.expr("CAST(array() AS array<string>)").alias("items"), column(docs, text_col).alias("__text"))
    sc = docs.sparkSession.sparkContext
    blocks = benchmark_blocks(benchmark, item_id_col, item_text_col, block_bytes)
    held = next(blocks)
    while held is not None:
        following = next(blocks, None)
        schema = (df if following is not None else df.drop("__text")).schema
        df = df.mapInArrow(Search(sc.broadcast(build(held, window)), following is None), schema)
        held = following
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    df = df.withColumn("n_hit", n_hit)
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * hit_share >= F.col("n_words")))
