"""Operators whose cost has to grow no faster than the input, against brute force."""

import math
import os
from collections import Counter

from pyspark.sql import functions as F

from opinio.operators import models as MO
from opinio.session import checkpoint_root

ROWS = [(i, [f"w{(i * j) % 7}" for j in range(1, 9)] + ["the"] * (i % 3) + [f"only{i}"]) for i in range(12)] + [(12, []), (13, None)]


def folder_bytes(root):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(root) for f in files)


def test_lda_keeps_the_tables_of_one_sweep(spark, monkeypatch):
    df = spark.createDataFrame(ROWS * 1, "row_id long, ws array<string>").cache()
    root = checkpoint_root(spark).removeprefix("file:")
    spark._jvm.System.gc()

    def grown(sweeps):
        before = folder_bytes(root)
        found = MO.lda_fit(df, "ws", k=2, max_iter=sweeps, row_id="row_id", partitions=2)
        most = folder_bytes(root) - before
        return most, {(r.topic, r.word): (r.weight, r.n) for r in found.collect()}

    few, many = grown(1), grown(8)
    assert many[0] < 2 * few[0]
    monkeypatch.setattr(MO, "FREQUENT_WORDS", 3)  # all other words are joined by a shuffle
    rest = grown(8)[1]
    assert rest.keys() == many[1].keys() and all(math.isclose(rest[w][0], many[1][w][0], rel_tol=1e-9) for w in rest)


def test_lda_is_the_plain_sweep(spark):
    df = spark.createDataFrame(ROWS, "row_id long, ws array<string>")
    tokens = {(i, w): n for i, ws in ROWS for w, n in Counter(ws or ()).items()}
    start = df.select("row_id", F.explode("ws").alias("word")).distinct().select(
        "row_id", "word", *[(1 + F.pmod(F.xxhash64(F.lit(42), F.lit(t), "row_id", "word"), F.lit(1000)) / 1000).alias(f"s{t}") for t in range(2)])
    share = {(r.row_id, r.word): [r.s0, r.s1] for r in start.collect()}
    words = {w for _, w in tokens}
    for sweep in range(4):
        c = {key: [n * s / sum(share[key]) for s in share[key]] for key, n in tokens.items()}
        w = {x: [sum(v[t] for (_, y), v in c.items() if y == x) for t in range(2)] for x in words}
        d = {i: [sum(v[t] for (j, _), v in c.items() if j == i) for t in range(2)] for i, _ in tokens}
        whole = [sum(v[t] for v in w.values()) for t in range(2)]
        share = {(i, x): [(d[i][t] + 0.1) * (w[x][t] + 0.01) / (whole[t] + len(words) * 0.01) for t in range(2)] for i, x in tokens}
    got = {(r.topic, r.word): r.n for r in MO.lda_fit(df, "ws", k=2, max_iter=3, row_id="row_id").collect()}
    assert got.keys() == {(t, x) for t in range(2) for x in words}
    assert all(math.isclose(got[t, x], w[x][t], rel_tol=1e-9) for t, x in got)


def test_pairs_are_counted_in_runs(spark, monkeypatch):
    """By the words' numbers, in runs that end inside the table, with nulls and rows without words."""
    from opinio.operators import arrowcounts as AC
    monkeypatch.setattr(AC, "OUT_ROWS", 5)
    data = [(1, ["b", "a", None, "a", "b", "b"]), (2, None), (3, []), (4, [None]), (5, ["é", "z", "é"]), (5, ["a"])]
    df = spark.createDataFrame(data, "row_id long, ws array<string>").coalesce(1)
    plain, either = Counter(), Counter()
    for _, ws in data:
        for k in (1, 2):
            for a, b in zip(ws or [], (ws or [])[k:]):
                if a is not None and b is not None:
                    plain[a, b] += 1
                    either[tuple(sorted((a, b), key=str.encode))] += 1
    for words in (2, 1 << 20):
        monkeypatch.setattr(AC, "RUN_WORDS", words)
        assert {(r.a, r.b): r.n for r in AC.pair_counts(df, "ws", 2).collect()} == plain
        assert {(r.a, r.b): r.n for r in AC.pair_counts(df, "ws", 2, either_way=True).collect()} == either
        known = spark.createDataFrame([("a",), ("b",)], "word string")
        assert {(r.a, r.b): r.n for r in AC.pair_counts(df, "ws", 2, True, known).collect()} == {p: n for p, n in either.items() if set(p) <= {"a", "b"}}
        assert {r.word: r.n for r in AC.run_word_counts(df, "ws").collect()} == Counter(w for _, ws in data for w in ws or [] if w is not None)
        got = Counter({(r.row_id, r.word): r.n for r in AC.row_word_counts(df, "ws", "row_id").collect()})
        assert got == Counter((i, w) for i, ws in data for w in ws or [] if w is not None)


def test_pairs_leave_a_task_counted(spark):
    """What the tasks send is counted over runs of words, not a row for each place in the text."""
    from opinio.operators import wordvectors as WV
    df = spark.createDataFrame([(["a", "b"] * 50,)] * 40, "ws array<string>").coalesce(2)
    once = WV._once(df, "ws", 2)
    assert "zip_with" not in once._jdf.queryExecution().toString() and "MapInArrow" in once._jdf.queryExecution().toString()
    assert {(r.word, r.ctx): r.n for r in WV.cooccurrences(df, "ws", 1).collect()} == {("a", "b"): 40 * 99, ("b", "a"): 40 * 99}


def test_pieces_are_put_together_without_a_row_for_each(spark):
    from opinio.operators import subwords as SW
    pieces = {**{c: i for i, c in enumerate(SW.ALPHABET)}, SW.SPACE + "ab": 300, "ab": 301, "cd": 302}
    data = [(1, ["ab", "abcd", None, "é"]), (2, None), (3, []), (4, [None]), (5, ["xab"] * 3)]
    df = spark.createDataFrame(data, "row_id long, ws array<string>").coalesce(1)
    trie = SW.Trie(pieces)
    plain = {i: [x for w in ws or () if w is not None for x in trie.encode(SW.SPACE + "".join(SW.ALPHABET[b] for b in w.encode()), -1)] for i, ws in data}
    ids = SW.subword_ids(df, "ws", pieces, ["row_id"])
    assert {r.row_id: r.ids for r in ids.collect()} == plain
    for most in (0, 1, 3):
        assert {r.row_id: r.ids for r in SW.subword_ids(df, "ws", pieces, ["row_id"], most=most).collect()} == {i: x[:most] for i, x in plain.items()}
    text = SW.decode("ids", spark.createDataFrame(list(pieces.items()), "piece string, id int"), ids, "row_id")
    assert {r.row_id: r.text for r in text.collect()} == {i: "".join(" " + w for w in ws or () if w is not None) for i, ws in data}
    assert "Generate" not in text._jdf.queryExecution().toString()
