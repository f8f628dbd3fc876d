"""Epoch training, sampled Shapley values, topics, word vectors' plan: against plain Python."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from opinio.functions import text as T
from opinio.operators import epochs as EP
from opinio.operators import features as FE
from opinio.operators import models as MO
from opinio.operators import shapley as SH
from opinio.operators.lexicon import score_comments
from opinio.resources import REFERENCE_LEXICON


def plain_share(key, seed):
    return int(hashlib.md5(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:7], 16)


def plain_fit(rows, n_classes, width, epochs, batch_rows, rate, decay, patience, seed, valid_share):
    """The same training, row by row."""
    kept = [(k, v, int(y)) for k, v, y in rows if v is not None and y is not None]
    valid = [r for r in kept if plain_share(r[0], seed) < int(valid_share * (1 << 28))]
    train = [r for r in kept if r not in valid]
    nb, nc = -(-len(train) // batch_rows), -(-len(valid) // batch_rows)
    w = np.zeros((n_classes, width + 1))
    m, v2, t, table, best, best_w, stop = np.zeros_like(w), np.zeros_like(w), 0, [], None, w, None

    def one(w, part):
        loss = hits = 0
        grad = np.zeros_like(w)
        for _, x, y in part:
            x = np.append(x.toArray(), 1.0)
            z = w @ x
            p = np.exp(z - z.max())
            p /= p.sum()
            loss -= math.log(max(p[y], 1e-15))
            hits += int(p.argmax() == y)
            p[y] -= 1
            grad += np.outer(p, x)
        return loss / len(part), hits, grad / len(part)
    for epoch in range(epochs):
        losses, hits = [], 0
        for b in np.random.default_rng([seed, epoch]).permutation(nb):
            part = [r for r in train if plain_share(r[0], seed + 1) % nb == b]
            if not part:
                continue
            loss, h, g = one(w, part)
            losses.append(loss)
            hits += h
            t += 1
            m, v2 = .9 * m + .1 * g, .999 * v2 + .001 * g * g
            w = w * (1 - rate * decay) - rate * (m / (1 - .9 ** t)) / (np.sqrt(v2 / (1 - .999 ** t)) + 1e-8)
        checked = [one(w, p) for p in ([r for r in valid if plain_share(r[0], seed + 1) % nc == b] for b in range(nc)) if p]
        loss = np.mean([c[0] for c in checked])
        table.append((epoch, np.mean(losses), hits / len(train), loss, sum(c[1] for c in checked) / len(valid)))
        if best is None or loss < table[best][3]:
            best, best_w = epoch, w
        elif epoch - best >= patience:
            stop = epoch
            break
    return table, best, stop, best_w


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        y = int(rng.integers(3))
        x = np.where(rng.random(12) < .5, rng.normal(size=12), 0)
        x[y] += 2 * (rng.random() < .7)
        v = Vectors.sparse(12, [(j, float(c)) for j, c in enumerate(x) if c]) if i % 4 else Vectors.dense(x.tolist())
        rows.append((i, v, float(y)))
    rows += [(200, None, 1.0), (201, rows[0][1], None), (202, Vectors.sparse(12, []), 2.0), (7, rows[3][1], 0.0), (None, rows[5][1], 1.0)]
    return rows


def frame(spark, rows):
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as ST
    schema = ST.StructType([ST.StructField("row_id", ST.LongType()), ST.StructField("x", VectorUDT()), ST.StructField("y", ST.DoubleType())])
    return spark.createDataFrame(rows, schema)


def test_epochs_equal_the_plain_training(spark, vectors):
    seen = []
    args = dict(epochs=25, batch_rows=60, rate=.15, decay=.01, patience=2, seed=5, valid_share=.25)
    fit = EP.train_epochs(frame(spark, vectors).repartition(3), "x", "y", "row_id", 3, 12, on_epoch=seen.append, **args)
    table, best, stop, weights = plain_fit(vectors, 3, 12, **args)
    assert [e["epoch"] for e in fit.epochs] == [t[0] for t in table] and list(fit.epochs) == seen
    for e, t in zip(fit.epochs, table, strict=True):
        assert np.allclose([e["train_loss"], e["train_acc"], e["valid_loss"], e["valid_acc"]], t[1:], atol=1e-9)
    assert (fit.best_epoch, fit.stop_epoch) == (best, stop) and stop is not None and best < stop == len(table) - 1
    assert np.allclose(fit.weights, weights, atol=1e-9)
    assert fit.n_train + fit.n_valid == 153 and table[best][3] < math.log(3)
    # the epoch table's own early stop agrees
    runs = spark.createDataFrame([("r", e["epoch"], float(e["valid_loss"])) for e in fit.epochs], "run string, epoch int, loss double")
    r = MO.early_stop(runs, "run", "epoch", "loss", 2).first()
    assert (r.best_epoch, r.stop_epoch) == (best, stop)
    margins = {m.row_id: list(m.margins) for m in EP.class_margins(frame(spark, vectors[:20]), "x", fit.weights).collect()}
    assert all(np.allclose(margins[k], weights @ np.append(v.toArray(), 1.0), atol=1e-9) for k, v, _ in vectors[:20])


def test_a_step_is_one_job(spark, vectors):
    def jobs(batch_rows):
        spark.sparkContext.setJobGroup(f"steps{batch_rows}", "")
        try:
            fit = EP.train_epochs(frame(spark, vectors), "x", "y", "row_id", 3, 12, epochs=1, batch_rows=batch_rows)
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"steps{batch_rows}")), -(-fit.n_train // batch_rows)

    (many, n_many), (few, n_few) = jobs(10), jobs(100)
    assert n_many > n_few + 10 and many - few == n_many - n_few


def test_epochs_without_rows(spark, vectors):
    fit = EP.train_epochs(frame(spark, vectors).where("false"), "x", "y", "row_id", 3, 12)
    assert fit.epochs == () and not fit.weights.any()
    only = EP.train_epochs(frame(spark, vectors), "x", "y", "row_id", 3, 12, epochs=2, valid_share=0.0)
    assert only.n_valid == 0 and [e["valid_loss"] == e["train_loss"] for e in only.epochs] == [True, True]


def score(df):
    return score_comments(df, REFERENCE_LEXICON, "text", "score", None)


def plain_score(words):
    pos, neg, nots = (set(x) for x in (REFERENCE_LEXICON.positive, REFERENCE_LEXICON.negative, REFERENCE_LEXICON.negators))
    return sum(((w in pos) - (w in neg)) * (-1 if i and words[i - 1] in nots else 1) for i, w in enumerate(words))


def test_shapley_values_near_the_exact_ones(spark):
    """All orders of a few words, enumerated, against a sample of 400."""
    texts = {1: "tidak bagus tidak buruk", 2: "bagus sekali saya suka", 3: "kurang puas", 4: "", 5: "tidak tidak bagus jelek tidak suka"}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(6, None)], "row_id long, comment string") \
        .withColumn("ws", T.word_tokens("comment"))
    got = {(r.row_id, r.player): r.value for r in SH.shapley_values(df, "ws", score, orders=400).collect()}
    for i, t in texts.items():
        words = t.split()
        exact = [0.0] * len(words)
        every = list(itertools.permutations(range(len(words))))
        for order in every:
            before = 0
            for step in range(len(order)):
                now = plain_score([words[j] for j in sorted(order[:step + 1])])
                exact[order[step]] += (now - before) / len(every)
                before = now
        assert len([k for k in got if k[0] == i]) == len(words) + 1 and got[i, -1] == 0
        assert abs(sum(got[i, j] for j in range(len(words))) - plain_score(words)) < 1e-9
        assert all(abs(got[i, j] - exact[j]) < 0.15 for j in range(len(words)))
    assert got[6, -1] == 0


def test_shapley_values_of_groups_add_up_for_a_pipeline(spark):
    """A fitted classifier as the model; long rows are cut into groups."""
    rows = [(i, " ".join(["bagus", "puas"] * (i % 5) + [f"w{i}"] + ["jelek"] * (i % 3) * 7), "p" if i % 5 > i % 3 * 2 else "n") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, text string, label string").withColumn("ws", T.word_tokens("text"))
    model = MO.train_classifier(df, "ws", "label", n_features=64, max_iter=10)

    def margin(d):
        from pyspark.ml.functions import vector_to_array
        scored = model.transform(d.withColumn("ws", T.word_tokens("text")))
        return scored.withColumn("score", vector_to_array("rawPrediction")[1]).select(*d.columns, "score")
    got = SH.shapley_values(df, "ws", margin, players=4, orders=2)
    sums = {r.row_id: (r.n, r.v) for r in got.groupBy("row_id").agg(F.count_if(F.col("player") >= 0).alias("n"), F.sum("value").alias("v")).collect()}
    for r in margin(df.select("row_id", "text")).collect():
        n, total = sums[r.row_id]
        assert n == min(4, len(r.text.split())) and abs(total - r.score) < 1e-9


def test_topics_share_out_every_token(spark):
    left, right = ["kulit", "cerah", "wajah"], ["kirim", "paket", "kurir"]
    rows = [(i, [(left if i % 2 else right)[(i * j) % 3] for j in range(8)]) for i in range(40)] + [(50, []), (51, None)]
    df = spark.createDataFrame(rows, "row_id long, ws array<string>")
    fit = MO.lda_fit(df, "ws", k=2, max_iter=30, row_id="row_id").collect()
    assert abs(sum(r.n for r in fit) - 320) < 1e-6
    for t in range(2):
        own = sorted((r for r in fit if r.topic == t), key=lambda r: -r.weight)
        assert abs(sum(r.weight for r in own) - 1) < 1e-9 and {r.word for r in own[:3]} in (set(left), set(right))
    assert MO.lda_topics(df.where("row_id >= 50"), "ws", k=2).count() == 0


def test_sentence_vectors_take_each_digest_once(spark):
    df = spark.createDataFrame([(1, "a b")], "row_id long, t string").withColumn("ws", T.word_tokens("t"))
    plan = FE.sentence_vectors(df, "ws")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("md5(") == 1 and plan.count("regexp_extract_all(") == 1
