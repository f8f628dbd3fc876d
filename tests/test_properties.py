"""Property tests over generated inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opinio.functions import text as T
from opinio.operators import dedup as D
from opinio.operators import profile as PR
from opinio.operators import wordstats as W

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

# Texts mixing words, accents, punctuation, digits, emoji and Unicode spaces.
PIECES = st.sampled_from(list("abcXYZ \u00e9\u00fc\u00df-'.,!?0123 \t\n") + ["\u00a0", "\u2003", "\U0001F600", "e\u0301"])
TEXTS = st.lists(st.one_of(st.none(), st.lists(PIECES, max_size=12).map("".join)), min_size=1, max_size=25)


@SETTINGS
@given(TEXTS)
def test_normalize_is_idempotent(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, t string")
    once = df.select("row_id", T.normalize("t").alias("a"))
    got = once.select("a", T.normalize("a").alias("b")).collect()
    assert all(r.a == r.b for r in got)


@SETTINGS
@given(TEXTS)
def test_keep_first_plus_duplicates_is_row_count(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, t string")
    kept = D.keep_first(df, ["t"], "row_id").count()
    dup = PR.duplicate_count(df, ["t"]).first()
    assert kept + dup.n_duplicates == len(texts) == dup.n_rows
    # the kept row of each key is its smallest row id
    firsts = {}
    for i, t in enumerate(texts):
        firsts.setdefault(t, i)
    assert sorted(r.row_id for r in D.keep_first(df, ["t"], "row_id").collect()) == sorted(firsts.values())


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["g1", "g2", "g3"]), st.sampled_from(["pos", "neg", "net", None])),
                min_size=1, max_size=40))
def test_shares_sum_to_100(spark, rows):
    df = spark.createDataFrame(rows, "g string, label string")
    out = W.label_share(df, "label", by=["g"]).groupBy("g").agg(
        F.sum("share").alias("total"), F.count(F.lit(1)).alias("k")).collect()
    for r in out:
        # each share is rounded to 0.1, so the sum is within 0.05 per label of 100
        assert abs(r.total - 100.0) <= 0.05 * r.k + 1e-9
