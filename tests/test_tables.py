"""Profiling, dedup, word statistics: literal fixtures with nulls and ties."""

from pyspark.sql import functions as F

from opinio.operators import dedup as D
from opinio.operators import profile as PR
from opinio.operators import wordstats as W


def fixture(spark):
    return spark.createDataFrame(
        [(1, "a", "positif"), (2, "a", "negatif"), (3, None, "netral"), (4, None, None),
         (5, "b", "positif"), (6, "c", None)], "row_id long, comment string, label string")


def test_keep_first_nulls_one_group(spark):
    out = D.keep_first(fixture(spark), ["comment"]).orderBy("row_id").collect()
    assert [r.row_id for r in out] == [1, 3, 5, 6]
    assert out[0].label == "positif"


def test_duplicate_count_counts_null_as_value(spark):
    r = PR.duplicate_count(fixture(spark), ["comment"]).first()
    assert (r.n_rows, r.n_keys, r.n_duplicates) == (6, 4, 2)


def test_null_counts_and_shape(spark):
    got = dict(PR.null_counts(fixture(spark)).collect())
    assert got == {"row_id": 0, "comment": 2, "label": 2}
    assert tuple(PR.shape(fixture(spark)).first()) == (6, 3)
    info = {r.column_name: (r.data_type, r.non_null) for r in PR.column_info(fixture(spark)).collect()}
    assert info["comment"] == ("string", 4)


def test_label_counts_share_fixed(spark):
    df = fixture(spark)
    assert [tuple(r) for r in W.label_counts(df, "label").collect()] == [
        ("positif", 2), ("negatif", 1), ("netral", 1)]
    shares = W.label_share(df, "label").collect()
    assert abs(sum(r.share for r in shares) - 100.0) < 0.2
    fixed = dict(W.label_counts_fixed(df, "label", ["negatif", "netral", "positif", "other"]).collect())
    assert fixed == {"negatif": 1, "netral": 1, "positif": 2, "other": 0}


def test_distinct_labels_first_seen(spark):
    got = [tuple(r) for r in D.distinct_labels(fixture(spark), "label").collect()]
    assert got == [("positif", 1), ("negatif", 2), ("netral", 3), (None, 4)]


def test_top_words_ties_by_word(spark):
    df = spark.createDataFrame([(1, "b a c", "x"), (2, "a b d", "x"), (3, "z z z", "y")],
                               "row_id long, comment string, label string")
    got = [tuple(r) for r in W.top_words(df, "comment", 3, "label", "x").collect()]
    assert got == [("a", 2), ("b", 2), ("c", 1)]


def test_group_word_weights_topk(spark):
    df = spark.createDataFrame([(1, "aa bb aa", "g1"), (2, "aa cc", "g1"), (3, "dd dd ee", "g2")],
                               "row_id long, comment string, g string")
    got = {(r.g, r.word): (r.n, r.weight) for r in W.group_word_weights(df, "comment", "g", 2).collect()}
    assert got == {("g1", "aa"): (3, 1.0), ("g1", "bb"): (1, 1 / 3), ("g2", "dd"): (2, 1.0), ("g2", "ee"): (1, 0.5)}


def test_set_difference_and_head(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "w string")
    b = spark.createDataFrame([("y",)], "w string")
    assert sorted(D.set_difference(a, b, "w").collect(), key=str) == sorted([(None,), ("x",)], key=str)
    assert [r.row_id for r in D.head_rows(fixture(spark), 2).collect()] == [1, 2]


def test_result_invariant_to_partitioning(spark):
    from opinio.plans.lexicon_queries import flagship
    sf = "/root/testdata/sf0.001"
    base = sorted(map(tuple, flagship(spark, sf).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        other = sorted(map(tuple, flagship(spark, sf).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert base == other


def test_with_bigrams_edges(spark):
    from opinio.operators.wordstats import with_bigrams
    rows = [(1, ["a", "b", "a", "b"]), (2, ["x"]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "k long, ws array<string>")
    got = {r.k: r.t for r in df.select("k", with_bigrams("ws").alias("t")).collect()}
    assert got[1] == ["a", "b", "a", "b", "a b", "b a", "a b"]
    assert got[2] == ["x"] and got[3] == [] and got[4] is None


def test_spread_deals_out_the_rows_of_one_row_group(spark, tmp_path):
    """The splits of a file with one row group are many, and all but one are empty."""
    from opinio.sources.tables import spread
    path, kept = str(tmp_path / "one"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.range(200_000, numPartitions=1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        read = spark.read.parquet(path)
        assert read.rdd.getNumPartitions() >= 4
        sizes = spread(read).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(sizes) == 200_000 and max(sizes) <= 2 * 200_000 / 4
        even = spark.range(200_000, numPartitions=8)
        assert spread(even) is even
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")
