"""Nearest centroids and subword pieces against plain versions."""


import numpy as np
import public_tokenizers
import pytest

from opinio.operators import models as MO
from opinio.operators import subwords as SW


@pytest.mark.parametrize("bytes_each", [1 << 26, 8 * 5 * 700])
def test_nearest_of_many_centroids(spark, monkeypatch, bytes_each):
    """Several runs and blocks, ties, equal centroids, odd vectors: as a full comparison says."""
    monkeypatch.setattr(MO, "CENTROID_BYTES", bytes_each)
    monkeypatch.setattr(MO, "NEAR_CENTROIDS", 64)
    rng = np.random.default_rng(3)
    c = np.concatenate([rng.normal(size=(1500, 5)) * rng.choice([1, 10, 100], (1500, 1)), np.zeros((2, 5)), [[1, 0, 0, 0, 0], [-1, 0, 0, 0, 0]]]).round(2)
    c = np.concatenate([c, c[:40]])
    ids = rng.permutation(len(c))
    x = np.concatenate([rng.normal(size=(300, 5)) * 20, c[:50], np.zeros((3, 5))]).round(2)
    cents = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, c, strict=True)], "class long, v array<double>")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [1.0]), (903, [])]
    df = spark.createDataFrame(rows, "row_id long, v array<double>")
    got = {r.row_id: r.cluster for r in MO.assign_nearest(df, "v", cents).collect()}
    for i, v in enumerate(x):
        d = ((c - v) ** 2).sum(axis=1)
        assert got[i] == min(ids[np.flatnonzero(d == d.min())])
    assert [got[i] for i in (900, 901, 902, 903)] == [None] * 4
    assert {r.cluster for r in MO.assign_nearest(df, "v", cents.limit(0)).collect()} == {None}


def test_plan_does_not_grow_with_the_centroids(spark):
    plan = lambda n: MO.assign_nearest(spark.createDataFrame([(1, [0.0, 1.0])], "row_id long, v array<double>"), "v", spark.createDataFrame(
        [(i, [float(i), 1.0]) for i in range(n)], "class long, v array<double>"))._jdf.queryExecution().analyzed().toString()
    assert abs(len(plan(10_000)) - len(plan(10))) < 200


def greedy(word, pieces):
    """Longest prefix first, by trying every length."""
    ids, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        ids.append(-1 if end is None else pieces[word[at:end]])
        at = end or at + 1
    return ids


def test_pieces_are_the_longest_that_fit(spark):
    pieces = SW.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(SW.ALPHABET) == 256 == len(set(SW.ALPHABET)) and all(c in pieces for c in SW.ALPHABET)
    rows = [(1, ["pelayanan", "sangat", "memuaskan", "é", "漢字", "😀", "unbelievably"]), (2, []), (3, None), (4, ["x" * 3000, None, ""]), (5, ["a"] * 400)]
    df = spark.createDataFrame(rows, "row_id long, ws array<string>")
    got = {r.row_id: list(r.ids) for r in SW.subword_ids(df, "ws", pieces, ["row_id"]).collect()}
    spelled = lambda w: SW.SPACE + "".join(SW.ALPHABET[b] for b in w.encode())
    assert got == {i: [n for w in ws or [] if w is not None for n in greedy(spelled(w), pieces)] for i, ws in rows}
    few = {k: i for i, k in enumerate([SW.SPACE, SW.SPACE + "a", "b", "ab", "abb"])}
    words = [["abab", "abba", "c", "acb"]]
    got = SW.subword_ids(spark.createDataFrame([(1, words[0])], "row_id long, ws array<string>"), "ws", few, ["row_id"]).first().ids
    assert list(got) == [n for w in words[0] for n in greedy(SW.SPACE + w, few)] and -1 in got
    vocabulary = spark.createDataFrame([(p, i) for p, i in pieces.items()], "piece string, id int")
    text = {r.row_id: r.text for r in SW.decode("ids", vocabulary, SW.subword_ids(df, "ws", pieces, ["row_id"]), "row_id").collect()}
    assert text == {i: "".join(f" {w}" for w in ws or [] if w is not None) for i, ws in rows}


def test_sequences_have_marks_and_padding(spark):
    pieces = {SW.SPACE: 0, SW.SPACE + "a": 1, "b": 2}
    df = spark.createDataFrame([(1, ["ab", "b"]), (2, None), (3, ["a"] * 9)], "row_id long, ws array<string>")
    got = {r.row_id: (list(r.input_ids), list(r.attention_mask)) for r in SW.encode_subwords(df, "ws", "row_id", pieces, 6, 99, -1, 7, 8).collect()}
    assert got == {1: ([7, 1, 2, 0, 2, 8], [1] * 6), 2: ([7, 8, 99, 99, 99, 99], [1, 1, 0, 0, 0, 0]), 3: ([7, 1, 1, 1, 1, 8], [1] * 6)}
    with pytest.raises(ValueError, match="no room"):
        SW.encode_subwords(df, "ws", "row_id", pieces, 1, begin_id=7, end_id=8)


def test_label_codes_as_a_table(spark):
    from opinio.operators import features as FE
    names = [f"l{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(i, names[i * 7 % 3000]) for i in range(5000)] + [(9000, None)], "row_id long, label string")
    codes = FE.label_codes(df, "label")
    coded = FE.encode_labels(df, "label", codes)
    got = {r.row_id: r.label_index for r in coded.collect()}
    assert got == {**{i: i * 7 % 3000 for i in range(5000)}, 9000: None}
    back = {r.row_id: r.again for r in FE.decode_labels(coded, "label_index", codes, "again").collect()}
    assert back[10] == names[70] and back[9000] is None
    with pytest.raises(Exception, match="unseen label: new"):
        FE.encode_labels(spark.createDataFrame([(1, "new")], "row_id long, label string"), "label", codes).collect()
