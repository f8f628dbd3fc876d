"""Operator 4: near-duplicate documents by MinHash with sequential Bayesian verification.

Documents with equal shingle sets form one class.  Class signatures are cut into bands;
classes that share a band are candidates.  A candidate pair is verified in sequence:
batches of signature positions are compared, and after each batch the pair is dropped if the
posterior probability that its similarity reaches the threshold (uniform prior, binomial
matches) is under the chosen miss probability.  Survivors are verified exactly on their
full shingle sets.

Only what decides the components is compared.  Inside a bucket every class is first
compared with one hub, its most central member; linked classes merge.  Then, round by round with other hubs, only
classes of different components meet, as long as a round merges much; last, all pairs of a
bucket that are still in different components are compared.  So a group of
thousands of copies costs a few comparisons per member, and no link between components is
lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.llm import tokens
from opinio.llm.common import Scratch, broadcast_if_small, column, release_shuffles, settle

SHINGLE_WORDS = 5
#: Similarity threshold in hundredths.
THRESHOLD = 75
#: 32 bands of 4: a pair at the threshold shares none with probability 5e-6.
BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
#: Signature positions compared before each pruning decision, and the chosen miss probability.
BATCH = 16
MISS = 1e-6
#: Hub rounds go on while a round links at least this share of the candidate classes, and at
#: most so many; then the remaining pairs are compared directly.
LEAST_MERGED = 0.02
#: Members of a bucket that one comparison task holds on either side.
BLOCK = 2048
MAX_ROUNDS = 8

_RNG = np.random.Generator(np.random.PCG64(977))
_XOR = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)


def shingle_sets(words: tokens.Words, n: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle digests of each text; fewer than ``n`` words are one shingle."""
    runs, out = tokens.windows(words.digest, n), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a:b - n + 1]))
        else:
            out.append(tokens.windows(words.digest[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures (rows) of non-empty sets."""
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat((low ^ _XOR[j]) * _ODD[j], at)
    return out


def set_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _each_set(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    raw, offsets = tokens.text_bytes(batch.column("__text"))
    is_word = tokens.white_space()
    for lo, hi in tokens.slices(offsets):
        yield lo, shingle_sets(tokens.Words(raw, offsets, lo, hi, is_word))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, ids, sigs = [], [], []
        for _, sets in _each_set(batch):
            full = [s for s in sets if len(s)]
            signed = iter(signatures(full) if full else ())
            n += [len(s) for s in sets]
            ids += [set_id(s) if len(s) else None for s in sets]
            sigs += [next(signed).tobytes() if len(s) else None for s in sets]
        own = [c for c in batch.schema.names if c != "__text"]
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, own), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())],
            [*own, "n_shingles", "set_id", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, sets in _each_set(batch):
            full = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in full], pa.binary()), pa.array([s.tobytes() for s in full], pa.binary())],
                ["set_id", "shingles"])


def least_matches(hashes: int = HASHES, batch: int = BATCH, threshold: int = THRESHOLD, miss: float = MISS) -> list[int]:
    """After each batch, the fewest matches at which a pair stays.

    With ``k`` matches among ``m`` and a uniform prior the similarity is Beta(k + 1,
    m - k + 1), and P(similarity >= t) = P(Binomial(m + 1, t) <= k).
    """
    t, out = threshold / 100, []
    for m in range(batch, hashes + 1, batch):
        below, k = 0.0, -1
        while below < miss:
            k += 1
            below += comb(m + 1, k) * t ** k * (1 - t) ** (m + 1 - k)
        out.append(k)
    return out


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least = least_matches()
    for batch in batches:
        a, b = (np.array([np.frombuffer(x, np.uint32) for x in batch.column(c).to_pylist()]).reshape(-1, HASHES)
                for c in ("sig_a", "sig_b"))
        left, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for k, need in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches[left] += (a[left, part] == b[left, part]).sum(1)
            left = left[matches[left] >= need]
        keep = pa.array(left)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])


def _across(block: pa.Table) -> pa.Table:
    """Links that join components within one block pair of a bucket.

    A pair is looked at in the first band that it shares only; pairs of components that
    are one by now are skipped; what signatures cannot rule out is compared on full sets.
    """
    least = least_matches()
    band, same_block = block.column("band")[0].as_py(), block.column("i")[0] == block.column("j")[0]
    ids, own = block.column("set_id").to_pylist(), block.column("own").to_numpy()
    comps = np.unique(block.column("comp").to_numpy(zero_copy_only=False), return_inverse=True)[1]
    sigs = np.array([np.frombuffer(s, np.uint32) for s in block.column("sig").to_pylist()])
    sets = [np.frombuffer(s, np.uint64) for s in block.column("shingles").to_pylist()]
    out = []
    for x in range(len(ids)):
        ys = np.arange(x + 1, len(ids))
        ys = ys[(comps[ys] != comps[x]) & (same_block or own[ys] != own[x])]
        matches = np.zeros(len(ys), np.int64)
        for k, need in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches += (sigs[ys, part] == sigs[x, part]).sum(1)
            ys, matches = ys[matches >= need], matches[matches >= need]
        if band and len(ys):
            earlier = (sigs[ys, :BAND_ROWS * band] == sigs[x, :BAND_ROWS * band]).reshape(len(ys), band, BAND_ROWS)
            ys, matches = ys[~earlier.all(2).any(1)], matches[~earlier.all(2).any(1)]
        for y in ys[np.argsort(-matches, kind="stable")].tolist():  # the likeliest first
            if comps[y] != comps[x] and _linked(sets[x], sets[y]):
                out.append((ids[x], ids[y]))
                comps[comps == comps[y]] = comps[x]
    return pa.table({"a": pa.array([p[0] for p in out], pa.binary()), "b": pa.array([p[1] for p in out], pa.binary())})


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= THRESHOLD * (len(x) + len(y) - common)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [i for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True))
                if _linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64))]
        keep = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])


def verify(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose similarity reaches the threshold: pruned by signature, then
    confirmed on full sets."""
    side = lambda df, key, value: df.select(F.col("set_id").alias(key), F.col(value[0]).alias(value[1]))
    signed = (pairs.join(side(classes, "a", ("sig", "sig_a")), "a")
              .join(side(classes, "b", ("sig", "sig_b")), "b").select("a", "b", "sig_a", "sig_b"))
    left = signed.mapInArrow(_prune, "a binary, b binary")
    full = (left.join(side(sets, "a", ("shingles", "set_a")), "a")
            .join(side(sets, "b", ("shingles", "set_b")), "b").select("a", "b", "set_a", "set_b"))
    return full.mapInArrow(_confirm, "a binary, b binary")


def merge_components(components: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components ``(set_id, comp)`` after merging along ``links`` ``(a, b)``.

    Links are contracted to links between components; each component takes the least label
    around it, and labels are followed to their own labels (pointer jumping), until
    nothing changes.  Only components that a link touches take part.
    """
    of = lambda name, to: components.select(F.col("set_id").alias(name), F.col("comp").alias(to))
    edges = links.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x != y").select("x", "y")
    both = scratch.table(edges.union(edges.select(F.col("y"), F.col("x"))).distinct())
    label = scratch.table(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("l")))
    while True:
        near = both.join(label.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("m"))
        step = label.join(near, "x").select("x", "l", F.least("l", "m").alias("to"))
        jump = label.select(F.col("x").alias("to"), F.col("l").alias("far"))
        step = scratch.table(step.join(jump, "to", "left").select("x", "l", F.least("to", "far").alias("new")))
        label = step.select("x", F.col("new").alias("l"))
        if step.where("new != l").isEmpty():
            break
    return (components.join(label.select(F.col("x").alias("comp"), "l"), "comp", "left")
            .select("set_id", F.coalesce("l", "comp").alias("comp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Null, empty and white-space texts have no shingles and are linked with nothing.  The
    component is the least id reachable over links; a row is kept if that is its own id.
    Rows that repeat an id and text share their result.  A null id is after all others: such
    a row is kept only if no row with an id is in its component.

    ``keyed`` adds what tells rows and components apart where ids are null or repeated:
    ``text_key``, the xxhash64 of the text, and ``comp``, one value per component (null
    without shingles).
    """
    text = docs.select(column(docs, id_col).cast("long").alias("doc_id"),
                       *[F.xxhash64(column(docs, text_col)).alias("text_key")] * keyed, column(docs, text_col).alias("__text"))
    with Scratch(docs.sparkSession, "minhash") as scratch:
        return settle(_components(text, scratch, keyed))


def _components(text: DataFrame, scratch: Scratch, keyed: bool) -> DataFrame:
    spark = text.sparkSession
    own = "doc_id long, text_key long" if keyed else "doc_id long"
    signed = scratch.table(text.mapInArrow(_sign, f"{own}, n_shingles long, set_id binary, sig binary"))
    classes = scratch.table(signed.where("set_id IS NOT NULL").groupBy("set_id")
                            .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 4 * BAND_ROWS * i + 1, 4 * BAND_ROWS)) for i in range(BANDS)])
    bands = classes.select("set_id", F.explode(keys).alias("key"))
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.table(bands.join(sizes, "key"))
    release_shuffles(spark)

    # Full sets of the classes that are candidates at all, once.
    wanted = scratch.table(members.select("set_id").distinct().join(classes, "set_id"))
    reps = wanted.select("rep").distinct()
    reps = broadcast_if_small(reps, F.lit(16))
    sets = (text.join(reps, text["doc_id"].eqNullSafe(reps["rep"]), "left_semi").mapInArrow(_sets, "set_id binary, shingles binary")
            .dropDuplicates(["set_id"]).join(wanted.select("set_id"), "set_id", "left_semi"))
    sets = scratch.table(sets)
    release_shuffles(spark)

    components = wanted.select("set_id", F.col("set_id").alias("comp"))
    # The hub of a bucket is its member that meets most others over all its buckets: of a
    # text and its edited copies that is the text itself, which is near to all of them.
    central = members.groupBy("set_id").agg(F.sum("n").alias("met"))
    members = scratch.table(members.select("key", "set_id").join(central, "set_id"))
    hubs = members.groupBy("key").agg(F.max(F.struct("met", "set_id")).alias("h"))
    pairs = (members.join(hubs, "key").where(F.col("set_id") != F.col("h.set_id"))
             .select(F.least("set_id", "h.set_id").alias("a"), F.greatest("set_id", "h.set_id").alias("b")).distinct())
    enough = LEAST_MERGED * wanted.count()
    for turn in range(1, MAX_ROUNDS + 1):
        pairs = scratch.table(pairs)
        links = scratch.table(verify(pairs, wanted, sets))
        n = links.count()
        if n:
            components = scratch.table(merge_components(components, links, scratch))
        if n <= enough:  # hubs find little more: compare what is left
            break
        open_members = scratch.table(_open(members, components))
        order = F.xxhash64("set_id", F.lit(turn))
        hubs = open_members.groupBy("key").agg(F.min(F.struct(order.alias("o"), "set_id", "comp")).alias("h"))
        pairs = (open_members.join(hubs, "key").where(F.col("comp") != F.col("h.comp"))
                 .select(F.least("set_id", "h.set_id").alias("a"), F.greatest("set_id", "h.set_id").alias("b")).distinct())
    # Whatever still shares a bucket across components is compared inside tasks, block by block;
    # only links that join components leave them.
    left = scratch.table(_open(members, components))
    dealt = left.join(left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n")), "key")
    dealt = (dealt.join(wanted.select("set_id", "sig"), "set_id").join(sets, "set_id")
             .withColumn("own", F.pmod(F.xxhash64("set_id", F.lit(0)), F.col("n")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
             .withColumn("band", F.array_position(keys, F.col("key")) - 1)
             .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band",
                     "set_id", "comp", "sig", "shingles"))
    links = scratch.table(dealt.groupBy("key", "i", "j").applyInArrow(_across, "a binary, b binary"))
    if not links.isEmpty():
        components = merge_components(components, links, scratch)
    release_shuffles(spark)
    return _result(signed, classes, components, keyed)


def _open(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    placed = members.select("key", "set_id").join(components, "set_id")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo != _hi")
    return placed.join(mixed.select("key"), "key", "left_semi").select("key", "set_id", "comp")


def _result(signed: DataFrame, classes: DataFrame, components: DataFrame, keyed: bool) -> DataFrame:
    placed = classes.select("set_id", "rep").join(components, "set_id", "left") \
        .select("set_id", "rep", F.coalesce("comp", "set_id").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("rep").alias("component"))
    of_class = placed.join(least, "comp").select("set_id", "component", *["comp"] * keyed)
    key = ["text_key"] * keyed
    out = signed.select("doc_id", *key, "n_shingles", "set_id").join(of_class, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), *key, *["comp"] * keyed)
