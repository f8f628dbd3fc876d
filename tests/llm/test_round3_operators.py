"""Operators 11 to 13 against brute-force versions on small tables with odd rows."""

import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinio.llm import chat, hardneg, queries, rtree, tokencount, toxicity, warc, whitening

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType()),
                        # names that operators use for their own results
                        *[T.StructField(c, T.StringType()) for c in ("id", "vec", "vector", "n", "rank", "tile", "component", "anchor")]])


@pytest.fixture
def vectors_of(spark):
    def make(rows):
        return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], VECTORS)
    return make


def vector_rows(seed, n, dims=6, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        v = (centres[label] * .7 + rng.normal(size=dims)).astype(np.float32).round(1)
        rows.append((i, [float(x) for x in v], label))
    same = rows[0][1]
    rows += [(n + i, same, i % labels) for i in range(30)]  # one vector of many ids and labels
    rows += [rows[3], rows[3], (3, rows[5][1], rows[3][2])]  # repeated rows, an id with two vectors
    rows += [(n + 40, None, 1), (n + 41, [1.0] * dims, None), (n + 42, [math.nan] * dims, 1), (n + 43, [math.inf] + [0.0] * (dims - 1), 2),
             (n + 44, [None] + [0.0] * (dims - 1), 2), (None, rows[1][1], rows[1][2]), (n + 45, [0.0] * dims, 0), (n + 50, [0.5], 1), (n + 51, [], 2)]
    return rows


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


# ---- 11 hard negatives

def brute_hard(rows, is_anchor, k_pos=5, k_neg=5, low=80):
    width = max((len(r[1]) for r in usable(rows)), default=0)
    scaled = {(i, tuple(math.floor(256 * x) for x in [*v, *[0.0] * (width - len(v))]), y) for i, v, y in usable(rows) if y is not None}
    out = set()
    last = lambda i: (i is None, i or 0)
    for i, a, y in scaled:
        if i is None or not is_anchor(i):
            continue
        scores = [(sum(p * q for p, q in zip(a, v, strict=True)), j, z) for j, v, z in scaled]
        mates = sorted((s for s in scores if s[2] == y and s[1] != i), key=lambda s: (-s[0], last(s[1])))[:k_pos]
        for p, j, _ in mates:
            foes = sorted((s for s in scores if s[2] != y and low * p <= 100 * s[0] <= 100 * p), key=lambda s: (-s[0], last(s[1])))
            out |= {(i, j, r, f[1], p, f[0]) for r, f in enumerate(foes[:k_neg], 1)}
    return out


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_match_brute_force(vectors_of, monkeypatch, seed):
    for name, value in (("TILE_ROWS", 40), ("SAMPLE_ROWS", 100), ("QUERY_BLOCK", 7)):  # many trees and blocks
        monkeypatch.setattr(hardneg, name, value)
    monkeypatch.setattr(rtree, "LEAF", 8)
    rows = vector_rows(seed, 260)
    got = hardneg.mine(vectors_of(rows), F.col("vec_id") % 9 == 0)
    found = [tuple(r[c] for c in COLUMNS) for r in got.collect()]
    want = brute_hard(rows, lambda i: i % 9 == 0)
    assert len(want) > 100 and len(found) == len(set(found)) and set(found) == want


def test_hard_negatives_without_rows(vectors_of):
    for rows in ([], [(100, None, 1)], [(100, [1.0], 1)], [(100, [], 1), (200, [], 1), (300, [], 2)]):
        got = [tuple(r[c] for c in COLUMNS) for r in hardneg.mine(vectors_of(rows), F.col("vec_id") % 100 == 0).collect()]
        assert set(got) == brute_hard(rows, lambda i: i % 100 == 0)


def test_tree_bounds_hold_every_inner_product():
    rng = np.random.default_rng(7)
    points, labels = rng.integers(-300, 300, (700, 5)), rng.integers(0, 9, 700)
    tree = rtree.Tree(points, labels)
    assert sorted(tree.rows) == list(range(700))
    query = rng.integers(-300, 300, (3, 5))
    lo, hi = tree.intervals(query, slice(None))
    for node, (a, b) in enumerate(tree.below):
        if node < tree.leaves:
            exact = query @ tree.points[a:b].T
            assert (lo[:, node] <= exact.min(axis=1)).all() and (hi[:, node] >= exact.max(axis=1)).all()
        else:  # a parent's interval holds its children's
            assert (lo[:, node, None] <= lo[:, a:b]).all() and (hi[:, node, None] >= hi[:, a:b]).all()


def test_best_first_opens_few_leaves_where_boxes_tell_apart():
    """Points on far clusters: the nearest leaf and its ties are opened, the others pruned."""
    centres = np.arange(16) * 1000
    points = np.concatenate([np.column_stack([np.full(128, c), np.arange(128)]) for c in centres])
    tree, opened = rtree.Tree(points, np.zeros(len(points), np.int64)), []
    windows = hardneg.Windows([(-(1 << 62), 1 << 62)], 3)

    def leaf(scores, labels, rows):
        opened.append(len(scores))
        windows.take(scores, labels == 0, [[i] for i in range(len(points))], rows)
    query = np.array([[1, 0]])
    lo, hi = tree.intervals(query, slice(None))
    tree.search(query[0].astype(lo.dtype), tree.points.astype(lo.dtype), lo[0], hi[0], lambda a, b: True, windows.needs, leaf)
    assert [-s for s, _ in windows.best[0]] == [15000] * 3 and sum(opened) <= 2 * rtree.LEAF


def test_str_cuts_deal_all_points():
    rng = np.random.default_rng(3)
    points = np.column_stack([rng.integers(0, 3, 4000), rng.normal(0, 100, (4000, 4)).astype(np.int64)])
    cuts = rtree.slicing(points[::4], 20)
    tiles = rtree.tile_of(cuts, points)
    sizes = np.bincount(tiles, minlength=rtree.count(cuts))
    assert tiles.max() < rtree.count(cuts) and sizes.sum() == 4000 and sizes.max() < 4000 / 20 * 4


# ---- 12 token counts

def texts_for_tokens():
    rng = random.Random(5)
    parts = ["word", " the", "  ", "\n", "é", "é", " 漢字", "😀", "<|endoftext|>", "'s", "'re", " 12", "!!", " ", "A", " İ", "́", " a"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 900)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, rows[0][1]), (None, None), rows[1], rows[1], (102, rows[1][1]), (103, "x" * 9000), (104, " " * 5000),
             (105, "plain words " * 400), (106, "plain words " * 400), (107, "<|endoftext|>" * 200), (108, "ab" * 700 + " end " * 300)]
    return rows


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(docs_of, name):
    path, rows = public_tokenizers.path(name), texts_for_tokens()
    lib = tokencount.load(name.rpartition(".")[2], tokencount.read_file(path))
    got = tokencount.count_tokens(docs_of(rows), path, keep=("doc_id", "text", "h"), chunk=300, overlap=120).collect()
    assert len(got) == len(rows) and {r.h for r in got} == {"x"}
    for r in got:
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), lib.counts([r.text or ""])[0]), r.text[:50]


def test_equal_pieces_are_encoded_once():
    lib = tokencount.load("json", tokencount.read_file(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(11)
    parts = ["word", " ", " ", "  ", "\n", "\u00a0", "\u3000", "é", "e\u0301", "<|endoftext|>", "'s", "'", ",", "12", "漢", "x y", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(3000)] + ["", " ", " a", "a "]
    want = lib.counts(texts)
    assert tokencount.whole_counts(lib, pa.array(texts)).tolist() == want
    given = []
    lib.counts = lambda held, real=lib.counts: (given.extend(held), real(held))[1]
    tokencount.whole_counts(lib, pa.array(["plain words " * 400] * 5))
    assert len(given) < 10 and set(given) >= {"plain", " plain", " words"}


def test_widening_reaches_runs_without_borders(docs_of, monkeypatch):
    rounds = []
    real = tokencount.Cut.__init__
    monkeypatch.setattr(tokencount.Cut, "__init__", lambda self, kind, data, chunk, overlap: (rounds.append(overlap), real(self, kind, data, chunk, overlap))[0])
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokencount.count_tokens(docs_of([(1, "x" * 9000), (2, "a b " * 500)]), path, keep=("doc_id",), chunk=300, overlap=100).collect()
    assert rounds[:3] == [100, 400, 1600] and len(rounds) < 8
    rounds.clear()
    tokencount.count_tokens(docs_of([(2, "a b " * 500)]), path, keep=("doc_id",), chunk=300, overlap=100).collect()
    assert rounds == [100]


def test_token_counts_of_an_empty_table(docs_of):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokencount.count_tokens(docs_of([]), path, keep=("doc_id",)).collect() == []


def test_op12_equals_whole_texts(spark):
    lib = tokencount.load("json", tokencount.read_file(public_tokenizers.path("byte_bpe_50k.json")))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.QUERIES["op12_tokens"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        n = lib.counts([docs[r.doc_id]])[0]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


# ---- 13 whitening

def check_whitened(got, rows, k=8):
    kept = usable(rows)
    width = max(len(r[1]) for r in kept)
    x = [[math.floor(1024 * c) + 100_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v, _ in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    a = np.array([[v * n - s for v, s in zip(r, sums, strict=True)] for r in x], dtype=float) / n
    values, axes = np.linalg.eigh(a.T @ a / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, width)
    assert len(got) == n * k and {r.n for r in got} == {n}
    want = {}
    for (i, _, _), row, exact in zip(kept, a @ axes, x, strict=True):
        deviation = sum((n * v - s) ** 2 for v, s in zip(exact, sums, strict=True))
        for c in range(k):
            want.setdefault((i, c + 1), []).append((deviation, row[c] / math.sqrt(values[c])))
    signs = {}
    for r in got:
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-9 * r.explained and r.identity_error < 1e-9
        close = [w for w in want[r.vec_id, r.component] if w[0] == r.deviation and abs(abs(w[1]) - abs(r.whitened)) < 1e-6]
        assert close
        if abs(r.whitened) > 1e-3 and len(want[r.vec_id, r.component]) == 1:
            signs.setdefault(r.component, set()).add(r.whitened * close[0][1] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_matches_the_eigenvectors(vectors_of):
    rows = vector_rows(4, 150, dims=12)
    check_whitened(whitening.whiten(vectors_of(rows).repartition(5)).collect(), rows)


def test_whitening_of_badly_conditioned_rows(vectors_of):
    """Scales from 1 to 10**6: the covariance's condition number is 10**12."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5) * [1000, 100, 10, 1, .01]], 0) for i in range(300)]
    check_whitened(whitening.whiten(vectors_of(rows), components=3).collect(), rows, 3)


def test_whitening_without_variance_or_rows(vectors_of):
    assert whitening.whiten(vectors_of([])).collect() == []
    assert whitening.whiten(vectors_of([(1, None, 1), (2, [math.nan], 1), (3, [], 1)])).collect() == []
    one = whitening.whiten(vectors_of([(1, [0.5, 2.0], 1)])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, c, 1, 0, None, None) for c in (1, 2)]
    flat = whitening.whiten(vectors_of([(i, [float(i), float(2 * i), 1.0], 1) for i in range(20)])).collect()  # one direction
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True), (3, True)}
    assert {r.identity_error < 1e-9 for r in flat} == {True}
    big = whitening.whiten(vectors_of([(i, [3e38 * (i % 2), 1.0], 1) for i in range(4)])).collect()
    assert {r.deviation for r in big} == {None} and all(abs(abs(r.whitened) - 1) < 1e-9 for r in big if r.component == 1)


# ---- 8 reply trees with odd links

NODES = "tree string, node long, parent long, role string, text string, score double"


def told(spark, rows, per_tree=100):
    made = chat.conversations(spark.createDataFrame(rows, NODES), per_tree)
    return {(r.tree, r.leaf): "".join(t.text for t in r.p) for r in
            made.select("tree", "leaf", chat.parse(F.col("formatted")).alias("p")).collect()}


def test_nodes_are_their_trees_own(spark):
    rows = [("t", 1, None, "user", "a", 1.0), ("u", 1, None, "user", "b", 1.0), ("u", 2, 1, "user", "c", 1.0), (None, 1, None, "user", "d", 1.0),
            ("t", 7, 2, "user", "e", None)]
    assert told(spark, rows) == {("t", 1): "a", ("u", 2): "bc", (None, 1): "d", ("t", 7): "e"}


def test_repeated_nodes_and_circles(spark):
    rows = [("t", 1, None, "user", "low", 0.1), ("t", 1, None, "user", "high", 0.9), ("t", 1, None, "user", "high", 0.9), ("t", 2, 1, "user", "-x", 0.5),
            ("c", 3, 5, "user", "c", 0.0), ("c", 4, 3, "user", "d", 0.0), ("c", 5, 4, "user", "e", 0.0), ("c", 6, 4, "user", "f", 0.0),
            ("s", 8, 8, "user", "self", 0.0), ("s", 9, 8, "user", "-y", 0.0), ("n", None, None, "user", "none", 0.0)]
    assert told(spark, rows) == {("t", 2): "high-x", ("c", 5): "cde", ("c", 6): "cdf", ("s", 9): "self-y", ("n", None): "none"}


def test_ranking_adds_up_scores_without_paths(spark):
    rng = random.Random(12)
    parent = {i: None if i == 0 else (i - 1 if i < 150 or rng.random() < .8 else rng.randrange(i)) for i in range(400)}
    score = {i: rng.randrange(8) / 8 for i in parent}
    rows = [("t", i, p, "user", f"{i},", score[i]) for i, p in parent.items()]
    up = lambda i: [] if i is None else [*up(parent[i]), i]
    leaves = set(parent) - set(parent.values())
    path = {i: up(i) for i in leaves}
    mean = lambda i: sum(score[x] for x in path[i]) / len(path[i])
    best = sorted(leaves, key=lambda i: (-mean(i), -len(path[i]), f"1:t/{len(str(i))}:{i}"))[:3]
    assert told(spark, rows, 3) == {("t", i): "".join(f"{x}," for x in path[i]) for i in best}


# ---- 7 and 3: layouts and odd ids

def test_toxicity_does_not_depend_on_the_layout(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    named = docs.withColumn("toxic", F.lit("x")).withColumn("_id", F.lit(1)).withColumn("w", F.lit(2)).withColumn("k", F.lit(3))
    one, two = toxicity.learn(docs, labels), toxicity.learn(named.repartition(7), labels.repartition(3))
    assert one.terms == two.terms and one.seen == two.seen and (one.weights, one.intercept) == (two.weights, two.intercept)


def test_archives_of_any_page_id(spark, tmp_path):
    ids = [0, 5, 10 ** 13, 2 ** 63 - 1, -2 ** 63, -1, 253402300800, None]
    pages = spark.createDataFrame([(i, f"http://x.org/{n % 2}", f"<p>{n}</p>") for n, i in enumerate(ids)], "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(pages), str(tmp_path / "a"))
    read = warc.merge_index(warc.read_archives(spark, str(tmp_path / "a")), rows=len(ids))
    got = read.select("page_id", "url_key", "captured", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")).collect()
    assert sorted((r.page_id is None, r.page_id or 0) for r in got) == sorted((i is None, i or 0) for i in ids)
    order = [(r.url_key, r.captured, r.page_id is None, r.page_id or 0) for r in sorted(got, key=lambda r: r["at"])]
    assert order == sorted(order)
