"""Features and models against brute force on small fixtures; ML stages on
separable literal data."""

import math

import numpy as np
from pyspark.sql import functions as F

from opinio.functions import text as T
from opinio.operators import features as FE
from opinio.operators import metrics as ME
from opinio.operators import models as MO


def test_tfidf_matches_bruteforce(spark):
    docs = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "a"), (4, "cat cat dog")]
    df = spark.createDataFrame(docs, "row_id long, t string").withColumn("ws", T.word_tokens("t", 2))
    vocab = FE.fit_tfidf(df, "ws", "row_id", max_features=4)
    toks = {i: [w for w in t.lower().split() if len(w) >= 2] for i, t in docs}
    cf = {}
    dfreq = {}
    for ws in toks.values():
        for w in ws:
            cf[w] = cf.get(w, 0) + 1
        for w in set(ws):
            dfreq[w] = dfreq.get(w, 0) + 1
    top = sorted(cf, key=lambda w: (-cf[w], w))[:4]
    assert list(vocab.words) == top
    n = len(docs)
    got = {(r.row_id, r.word): r.weight for r in FE.tfidf_weights(df, "ws", "row_id", vocab).collect()}
    for i, ws in toks.items():
        raw = {w: ws.count(w) * (math.log((1 + n) / (1 + dfreq[w])) + 1) for w in set(ws) if w in top}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for w, v in raw.items():
            assert abs(got[(i, w)] - v / norm) < 1e-9
    vec = {r.row_id: r.features.toArray() for r in FE.tfidf_vectors(df, "ws", vocab).collect()}
    assert np.allclose(vec[3], 0.0)
    for (i, w), v in got.items():
        assert abs(vec[i][top.index(w)] - v) < 1e-9


def test_sequence_encoding(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "z"]), (2, []), (3, ["b"] * 5)], "row_id long, ws array<string>")
    vocab = FE.sequence_vocab(df, "ws", 2)
    assert dict(vocab.collect()) == {"b": 2, "a": 3}
    enc = {r.row_id: (list(r.input_ids), list(r.attention_mask))
           for r in FE.encode_sequences(df, "ws", "row_id", vocab, max_len=4).collect()}
    assert enc[1] == ([3, 2, 3, 1], [1, 1, 1, 1])
    assert enc[2] == ([0, 0, 0, 0], [0, 0, 0, 0])
    assert enc[3] == ([2, 2, 2, 2], [1, 1, 1, 1])
    # padding=True: pad to the longest row after truncation (here 5, under max_len 9)
    longest = {r.row_id: list(r.input_ids)
               for r in FE.encode_sequences(df, "ws", "row_id", vocab, max_len=9, pad_to="longest").collect()}
    assert longest[1] == [3, 2, 3, 1, 0] and longest[2] == [0] * 5 and longest[3] == [2] * 5


def test_softmax_and_argmax(spark):
    from opinio.functions.labels import argmax_index, argmax_label
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [5.0, 5.0, 1.0])], "row_id long, z array<double>")
    p = {r.row_id: r.p for r in MO.softmax_probs(df, "z", "p").collect()}
    e = np.exp([1.0, 2.0, 3.0])
    assert np.allclose(p[1], e / e.sum()) and abs(sum(p[2]) - 1) < 1e-12
    got = {r.row_id: (r.i, r.l) for r in df.select(
        "row_id", argmax_index("z").alias("i"), argmax_label("z", ["negatif", "netral", "positif"]).alias("l")).collect()}
    assert got == {1: (2, "positif"), 2: (0, "negatif")}


def test_nearest_centroid_and_kmeans(spark):
    from pyspark.ml.linalg import Vectors
    pts = [(i, [0.0 + i * 0.01, 0.0]) for i in range(10)] + [(100 + i, [10.0, 10.0 + i * 0.01]) for i in range(10)]
    df = spark.createDataFrame(pts, "row_id long, v array<double>")
    cents = MO.class_centroids(df.withColumn("c", (F.col("row_id") >= 100).cast("int")), "v", "c")
    got = dict(MO.assign_nearest(df, "v", cents).select("row_id", "cluster").collect())
    assert all(got[i] == 0 for i in range(10)) and all(got[100 + i] == 1 for i in range(10))
    vdf = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in pts], ["row_id", "features"])
    model = MO.fit_kmeans(vdf, "features", k=2, n_init=3)
    lab = dict(model.transform(vdf).select("row_id", "cluster").collect())
    assert len({lab[i] for i in range(10)}) == 1 and lab[0] != lab[100]


def test_classifier_on_separable_fixture(spark):
    rows = [(i, "sangat bagus suka", "positif") for i in range(20)] + \
           [(100 + i, "jelek kecewa buruk", "negatif") for i in range(20)] + \
           [(200 + i, "biasa saja", "netral") for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, t string, label string").withColumn("ws", T.word_tokens("t", 2))
    model = MO.train_classifier(df, "ws", "label")
    pred = MO.predict_labels(model, df)
    assert ME.accuracy(pred, "predicted_label", "label").first()[0] == 1.0


def test_dense_index_and_epoch_metrics(spark):
    keys = [5, 17, 2, 40, 41, 1 << 60, -(1 << 60)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = dict(ME.dense_index(df, "k", "i", partitions=3).select("k", "i").collect())
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    probs = [(i, [0.7, 0.2, 0.1] if i % 2 else [0.1, 0.1, 0.8], i % 3) for i in range(10)]
    pdf = spark.createDataFrame(probs, "k long, p array<double>, label int")
    m = ME.epoch_metrics(pdf, "k", "p", "label", batch_size=4).first()
    losses = [-math.log(p[lab]) for _, p, lab in probs]
    batches = [losses[0:4], losses[4:8], losses[8:10]]
    assert abs(m.batch_loss - np.mean([np.mean(b) for b in batches])) < 1e-12
    assert abs(m.row_loss - np.mean(losses)) < 1e-12 and m.n_batches == 3


def test_early_stop_rows(spark):
    """Patience 3: stop at the third epoch in a row without a new best (worked out by hand)."""
    runs = {
        "stops": [1.0, 0.9, 0.95, 0.92, 0.91, 0.85, 0.5],     # epochs 2, 3, 4 bring nothing
        "late": [1.0, 0.9, 0.95, 0.92, 0.8, 0.9, 0.9, 0.9],   # best 4, stop 7
        "never": [3.0, 2.0, 1.0, 1.5],
        "ties": [1.0, 1.0, 1.0, 1.0],                          # an equal loss is no new best
        "one": [0.4],
    }
    want = {"stops": (1, 4, 0.9), "late": (4, 7, 0.8), "never": (2, None, 1.0), "ties": (0, 3, 1.0), "one": (0, None, 0.4)}
    df = spark.createDataFrame([(k, i, v) for k, vs in runs.items() for i, v in enumerate(vs)], "run string, epoch int, loss double")
    got = {r.run: (r.best_epoch, r.stop_epoch, r.best_loss) for r in MO.early_stop(df, "run", "epoch", "loss", 3).collect()}
    assert got == want


def test_linear_attribution_sums(spark):
    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", 1.0)], "row_id long, word string, x double")
    coefs = spark.createDataFrame([(0, "a", 2.0), (0, "b", -1.0), (0, "c", 3.0)], "class int, word string, coef double")
    means = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3)], "word string, mean double")
    out = MO.linear_attribution(w, coefs, means).collect()
    total = sum(r.attribution for r in out)
    # f(x) - f(mean) for the linear score
    fx = 2.0 * 0.5 + -1.0 * 1.0 + 3.0 * 0.0
    fm = 2.0 * 0.1 + -1.0 * 0.2 + 3.0 * 0.3
    assert abs(total - (fx - fm)) < 1e-12


def test_user_model_hook(spark):
    import numpy as np

    def make_fn():
        # Stand-in for an exported network: counts of two marker words.
        def predict(texts):
            out = []
            for t in texts:
                ws = str(t).lower().split()
                out.append([ws.count("jelek"), 0.5, ws.count("bagus")])
            return np.array(out, dtype=np.float32)
        return predict

    df = spark.createDataFrame([(1, "bagus bagus"), (2, "jelek"), (3, "biasa"), (4, None)],
                               "row_id long, comment string")
    got = dict(MO.predict_with_model(df, "comment", make_fn, ["negatif", "netral", "positif"])
               .select("row_id", "predicted_label").collect())
    assert got == {1: "positif", 2: "negatif", 3: "netral", 4: "netral"}


def test_sentence_vectors_keep_every_word(spark):
    import hashlib
    rows = [(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["rare"])]
    df = spark.createDataFrame(rows, "row_id long, ws array<string>")
    got = {r.row_id: list(r.sentence_vector) for r in FE.sentence_vectors(df, "ws", size=8).collect()}

    def signs(w):
        bits = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        return np.array([2 * (bits >> i & 1) - 1 for i in range(8)], float)
    for i, ws in rows:
        assert np.allclose(got[i], np.mean([signs(w) for w in ws], 0) if ws else np.zeros(8))


def test_physical_forms_agree_on_odd_rows(spark):
    """Null and empty arrays, duplicate keys, inline and joined."""
    from opinio.operators import clean as C
    df = spark.createDataFrame([(1, ["a", "b", "a", "z"], "x"), (2, [], None), (3, None, "y")], "row_id long, ws array<string>, other string")
    stop = spark.createDataFrame([("a",), ("a",), ("q",)], "word string")
    rows = lambda d: sorted((r.row_id, r.ws, r.other) for r in d.collect())
    assert rows(C.remove_stopwords(df, "ws", ["a", "q"])) == rows(C.remove_stopwords(df, "ws", stop)) \
        == [(1, ["b", "z"], "x"), (2, [], None), (3, [], "y")]
    stems = spark.createDataFrame([("a", "r"), ("a", "s"), ("b", "b")], "word string, stem string")
    two = [rows(C.apply_word_map(df, "ws", stems, keep=["other"], inline_max=n)) for n in (64, 0)]
    assert two[0] == two[1] == [(1, ["r", "b", "r", "z"], "x"), (2, [], None), (3, [], "y")]
    vocab = spark.createDataFrame([("a", 5), ("a", 3), ("b", 2)], "word string, id int")
    codes = [sorted((r.row_id, list(r.input_ids), list(r.attention_mask))
                    for r in FE.encode_sequences(df, "ws", "row_id", vocab, max_len=3, inline_max=n).collect()) for n in (64, 0)]
    assert codes[0] == codes[1] == [(1, [3, 2, 3], [1, 1, 1]), (2, [0, 0, 0], [0, 0, 0]), (3, [0, 0, 0], [0, 0, 0])]


def test_nearest_centroid_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "row_id long, v array<double>")
    cents = spark.createDataFrame([(c, [3.0 * c, 0.0]) for c in range(7)], "class int, v array<double>")
    whole = dict(MO.assign_nearest(df, "v", cents).select("row_id", "cluster").collect())
    monkeypatch.setattr(MO, "CENTROID_BYTES", 2 * 8 * len(cents.first().v))
    assert dict(MO.assign_nearest(df, "v", cents).select("row_id", "cluster").collect()) == whole
    assert all(whole[i] == min(range(7), key=lambda c: (abs(3 * c - i), c)) for i in range(20))


def test_classifier_attribution_adds_up(spark):
    from pyspark.ml.functions import vector_to_array
    rows = [(i, ["good", "fine", f"w{i}"] if i % 2 else ["bad", "poor", f"w{i}"], "p" if i % 2 else "n") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, ws array<string>, label string")
    model = MO.train_classifier(df, "ws", "label", n_features=1 << 10)
    sums = {r.row_id: r.s for r in MO.classifier_attribution(model, df, "ws").groupBy("row_id").agg(F.sum("attribution").alias("s")).collect()}
    margin = {r.row_id: r.m for r in MO.predict_labels(model, df).select(
        "row_id", F.array_max(vector_to_array("rawPrediction")).alias("m")).collect()}
    assert all(abs(sums[i] - margin[i]) < 1e-9 for i in margin)


def test_select_model_reports_every_candidate(spark):
    rows = [(i, "sangat bagus suka", "positif") for i in range(30)] + \
           [(100 + i, "jelek kecewa buruk", "negatif") for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, t string, label string").withColumn("ws", T.word_tokens("t", 2))
    sel = MO.select_model(df, "ws", "label", "row_id", reg_params=(0.0, 0.5))
    assert len(sel.log_losses) == 2 and all(x >= 0 for x in sel.log_losses)
    # the unregularised fit separates the fixture better
    assert sel.best_index == 0
    pred = MO.predict_labels(sel.best_model, df)
    assert ME.accuracy(pred, "predicted_label", "label").first()[0] == 1.0


def test_corpus_stats_brute_force(spark):
    from collections import Counter
    from opinio.operators.features import corpus_stats
    docs = [["a", "b", "a"], [], ["b", "c"], ["a", "a", "a"], None]
    df = spark.createDataFrame([(d,) for d in docs], "ws array<string>")
    got = {r.word: (r.cf, r.df) for r in corpus_stats(df, "ws").collect()}
    cf = Counter(w for d in docs if d for w in d)
    dfc = Counter(w for d in docs if d for w in set(d))
    assert got == {w: (cf[w], dfc[w]) for w in cf}


def test_linear_attribution_baseline_for_rows_without_words(spark):
    w = spark.createDataFrame([(1, "a", 0.5)], "row_id long, word string, x double")
    coefs = spark.createDataFrame([(0, "a", 2.0), (0, "b", -1.0)], "class int, word string, coef double")
    means = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "word string, mean double")
    rows = spark.createDataFrame([(1, 0), (2, 0)], "row_id long, class int")
    out = MO.linear_attribution(w, coefs, means, rows=rows).collect()
    per_row = {}
    for r in out:
        per_row[r.row_id] = per_row.get(r.row_id, 0.0) + r.attribution
    # f(x) - f(mean) for each row of the linear score 2a - b
    assert abs(per_row[1] - ((2.0 * 0.5) - (2.0 * 0.1 - 0.2))) < 1e-12
    assert abs(per_row[2] - (0.0 - (2.0 * 0.1 - 0.2))) < 1e-12
    assert sum(1 for r in out if r.word is None) == 2


def test_lda_fits_the_whole_vocabulary(spark):
    """More words than 1 << 18, each once, and one that is frequent: all are terms of each topic."""
    n, per = (1 << 18) + 4_000, 2_000
    rows = [(["common"] + [f"w{i}" for i in range(a, min(n, a + per))],) for a in range(0, n, per)]
    df = spark.createDataFrame(rows, "ws array<string>")
    all_terms = MO.lda_topics(df, "ws", k=2, max_iter=1, top_terms=n + 1)
    got = all_terms.groupBy("topic").agg(F.countDistinct("word").alias("words"), F.sum("weight").alias("weight")).collect()
    assert [r.words for r in got] == [n + 1] * 2 and all(abs(r.weight - 1) < 1e-6 for r in got)
    assert {r.word for r in MO.lda_topics(df, "ws", k=2, max_iter=1, vocab_size=1, top_terms=5).collect()} == {"common"}
