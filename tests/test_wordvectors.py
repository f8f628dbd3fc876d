"""Learned word vectors, mined aspects and requests that are answered once."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinio.operators import wordvectors as WV
from opinio.resources import REFERENCE_LEXICON
from opinio.session import work_dir
from opinio.streaming import scoring as SS


def corpus(seed=3):
    """Two topics; within each, the two planted words of a pair stand in the same places."""
    rng = random.Random(seed)
    topics = [(["kulit", "wajah"], ["cerah", "lembut", "halus", "segar"]), (["paket", "kiriman"], ["cepat", "lambat", "aman", "sampai"])]
    rows = []
    for i in range(400):
        nouns, others = topics[i % 2]
        rows.append((i, [w for _ in range(4) for w in (rng.choice(nouns), *rng.sample(others, 2))]))
    return rows + [(1000, []), (1001, None), (1002, ["rare", "words", "rare"])]


def test_ppmi_counts_every_window(spark):
    rows = corpus()[:40] + corpus()[-3:]
    got = {(r.word, r.ctx): (r.n, r.x) for r in WV.ppmi(spark.createDataFrame(rows, "row_id long, ws array<string>"), "ws", 2, 2).collect()}
    said = Counter(w for _, ws in rows for w in ws or [])
    pairs = Counter()
    for _, ws in rows:
        for i, a in enumerate(ws or []):
            for b in ws[i + 1:i + 3]:
                pairs.update([(a, b), (b, a)])
    pairs = {p: n for p, n in pairs.items() if min(said[p[0]], said[p[1]]) >= 2}
    own = Counter()
    for (a, _), n in pairs.items():
        own[a] += n
    total = sum(own.values())
    want = {p: (n, math.log(n * total / (own[p[0]] * own[p[1]]))) for p, n in pairs.items()}
    want = {p: v for p, v in want.items() if v[1] > 1e-12}
    assert {p for p, v in got.items() if v[1] > 1e-12} == set(want) and all(got[p][0] == n and abs(got[p][1] - x) < 1e-9 for p, (n, x) in want.items())


def test_planted_words_are_nearest_neighbours(spark):
    df = spark.createDataFrame(corpus(), "row_id long, ws array<string>")
    vectors, values = WV.word_vectors(WV.ppmi(df, "ws", 2, 5), size=4, iterations=8)
    v = {r.word: np.array(r.vector) for r in vectors.collect()}
    assert "rare" not in v and len(v) == 12 and values == sorted(values, key=lambda x: -abs(x))
    near = lambda w: max((o for o in v if o != w), key=lambda o: v[o] @ v[w] / np.linalg.norm(v[o]) / np.linalg.norm(v[w]))
    for a, b in (("kulit", "wajah"), ("paket", "kiriman")):
        assert near(a) == b and near(b) == a
    means = {r.row_id: r.sentence_vector for r in WV.sentence_means(df, "ws", "row_id", vectors).collect()}
    assert means[1000] is None and means[1001] is None and means[1002] is None
    first = dict(corpus())[0]
    assert np.allclose(means[0], np.mean([v[w] for w in first], axis=0))


def test_vectors_are_the_leading_eigenvectors(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(9, 9))
    m = m + m.T
    rows = [(f"w{i}", f"w{j}", float(m[i, j])) for i in range(9) for j in range(9)]
    vectors, values = WV.word_vectors(spark.createDataFrame(rows, "word string, ctx string, x double"), size=9, iterations=2)
    assert np.allclose(sorted(values), np.linalg.eigvalsh(m), atol=1e-8)
    got = {r.word: np.array(r.vector) for r in vectors.collect()}
    b = np.array([got[f"w{i}"] for i in range(9)])
    assert np.allclose(b @ np.diag(np.sign(values)) @ b.T, m, atol=1e-8)
    empty, none = WV.word_vectors(spark.createDataFrame([], "word string, ctx string, x double"))
    assert empty.count() == 0 and none == []


def test_planted_aspects_are_found(spark):
    """``bagus`` is known; ``pelayanan`` stands next to it, ``ramah`` next to ``pelayanan``, ``kurir`` next to ``ramah``."""
    rows = [(i, ws) for i, ws in enumerate([["pelayanan", "bagus"]] * 3 + [["pelayanan", "ramah"]] * 3 + [["kurir", "ramah"]] * 3
                                           + [["dan", "bagus"]] * 9 + [["sering", "bagus"]] * 3 + [["sering", "sekali"]] * 90 + [["langka", "bagus"]])]
    df = spark.createDataFrame(rows, "row_id long, ws array<string>")
    known = spark.createDataFrame([("bagus",), ("jelek",)], "word string")
    stop = spark.createDataFrame([("dan",)], "word string")
    got = {r.word: (r.kind, r.round, r.hits) for r in WV.mine_aspects(df, "ws", known, stop).collect()}
    assert got == {"bagus": ("opinion", 0, 0), "jelek": ("opinion", 0, 0), "pelayanan": ("aspect", 1, 3), "ramah": ("opinion", 1, 3),
                   "kurir": ("aspect", 2, 3)}


@pytest.fixture
def folder(spark):
    path = work_dir(spark, "t-once")
    os.makedirs(os.path.join(path, "in"))
    return path


def drop(path, name, *lines):
    with open(os.path.join(path, "in", name), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_resent_requests_are_answered_once(spark, folder):
    score = lambda r: SS.score_requests(r, REFERENCE_LEXICON)
    run = lambda: SS.run_requests(spark, os.path.join(folder, "in"), score, os.path.join(folder, "out"), files_per_batch=1)
    drop(folder, "a", '{"id": 1, "text": "bagus"}', '{"id": 1, "text": "bagus"}', '{"id": 2, "text": 5}', "no json", '{"text": "puas"}')
    good, bad = run()
    assert sorted((r.id, r.prediction) for r in good.where("id IS NOT NULL").collect()) == [(1, "positif")]
    assert good.where("id IS NULL").count() == 1 and sorted((r.id is None, r.id) for r in bad.collect()) == [(False, 2), (True, None)]
    # The same again, and something new: only the new id is answered.
    drop(folder, "b", '{"id": 1, "text": "bagus"}', '{"id": 3, "text": "jelek"}', '{"id": 2, "text": 5}')
    good, bad = run()
    assert sorted(r.id for r in good.where("id IS NOT NULL").collect()) == [1, 3] and bad.count() == 2
    before = sorted(map(tuple, good.collect()), key=str)
    good, _ = run()  # nothing new
    assert sorted(map(tuple, good.collect()), key=str) == before


def test_replayed_batch_changes_nothing(spark, folder):
    """The batch's commit is lost after its tables were written: it is run again."""
    score = lambda r: SS.score_requests(r, REFERENCE_LEXICON)
    drop(folder, "a", '{"id": 1, "text": "bagus"}', '{"id": 2, "text": ""}')
    run = lambda: SS.run_requests(spark, os.path.join(folder, "in"), score, os.path.join(folder, "out"))
    first = [sorted(map(tuple, t.collect()), key=str) for t in run()]
    commits = os.path.join(folder, "out", "checkpoint", "commits")
    for name in os.listdir(commits):
        os.rename(os.path.join(commits, name), os.path.join(folder, name))
    assert [sorted(map(tuple, t.collect()), key=str) for t in run()] == first
    assert spark.read.parquet(os.path.join(folder, "out", "answers")).select(F.countDistinct("batch_id")).first()[0] == 1
