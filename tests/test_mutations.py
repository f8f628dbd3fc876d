"""Each property that stands in for values must fail when its operator is broken: the mutation is
tried on the query, and what the oracle expects must then not come out."""

import functools

import pytest
from pyspark.sql import functions as F

from opinio.operators import features as FE
from opinio.operators import models as MO
from opinio.operators import subwords as SW
from opinio.operators import wordstats as WS
from opinio.operators import wordvectors as WV
from opinio.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"


def broken_softmax(df, scores_col, out="probability"):
    return ORIGINAL_SOFTMAX(df.withColumn(scores_col, F.transform(scores_col, lambda x: x * 2)), scores_col, out)


ORIGINAL_SOFTMAX = MO.softmax_probs
ORIGINAL_CLOUDS = WS.group_word_weights
ORIGINAL_LDA = MO.lda_fit
ORIGINAL_PREDICT = MO.predict_with_model
ORIGINAL_KMEANS = MO.fit_kmeans
ORIGINAL_IDS = SW.subword_ids
ORIGINAL_VECTORS = WV.word_vectors


def no_iterations(*args, **kwargs):
    return ORIGINAL_KMEANS(*args, **{**kwargs, "n_init": 1, "max_iter": 0})


def other_label(model, df, out="predicted_label"):
    return ORIGINAL_LABELS(model, df, out).withColumn(out, F.when(F.col(out) == "positif", "negatif").otherwise("positif"))


ORIGINAL_LABELS = MO.predict_labels

CASES = {
    # query: (module, name, mutation, column that must not be all true or as counted)
    "kmeans_clusters": (MO, "fit_kmeans", no_iterations, "centre_is_mean"),
    "batch_predict": (MO, "softmax_probs", broken_softmax, "softmax_agrees"),
    "train_classifier": (MO, "predict_labels", other_label, "beats_majority"),
    "cluster_word_clouds": (WS, "group_word_weights", lambda *a, **k: ORIGINAL_CLOUDS(*a, **k).where("rank > 1"), "clouds_agree"),
    "user_model_predict": (MO, "predict_with_model", lambda df, col, make, labels: ORIGINAL_PREDICT(
        df, col, lambda: (lambda v: -make()(v)), labels), "same_label"),
    "subword_encoding": (SW, "subword_ids", lambda *a, **k: (lambda d: d.withColumn(
        d.columns[-1], F.slice(d.columns[-1], 1, F.greatest(F.size(d.columns[-1]) - 1, F.lit(0)))))(ORIGINAL_IDS(*a, **k)), "restored"),
    "word_vectors": (WV, "word_vectors", lambda t, **k: (lambda v, e: (v.withColumn("vector", F.transform(
        "vector", lambda x, i: x + F.get("vector", F.lit(0)) * (i > 0).cast("int"))), e))(*ORIGINAL_VECTORS(t, **k)), "orthogonal"),
}


@pytest.mark.parametrize("name", CASES)
def test_broken_operator_is_noticed(spark, monkeypatch, name):
    module, attribute, mutation, column = CASES[name]
    monkeypatch.setattr(module, attribute, functools.wraps(getattr(module, attribute))(mutation))
    got = REGISTRY[name].fn(spark, SF).select(column).collect()
    assert got and not all(r[0] for r in got)


def test_broken_choice_of_model_is_noticed(spark, monkeypatch):
    worst = property(lambda s: max(range(len(s.log_losses)), key=lambda i: s.log_losses[i]))
    monkeypatch.setattr(MO.Selection, "best_index", worst)
    assert {r.n_chosen for r in REGISTRY["model_selection"].fn(spark, SF).collect()} == {0}


def test_lost_words_of_topics_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(MO, "lda_fit", lambda *a, **k: ORIGINAL_LDA(*a, **{**k, "vocab_size": 50, "max_iter": 1}))
    words = FE.explode_rows(spark.read.parquet(f"{SF}/documents.parquet"), F.split("text", " "), "w").count()
    assert all(r.n_words == 50 and r.all_tokens < words for r in REGISTRY["lda_topics"].fn(spark, SF).collect())
