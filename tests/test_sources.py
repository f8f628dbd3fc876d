"""Sources and sinks: CSV quoting round trip, NA spellings, required
columns, emptiness, split pruning."""

import os

import pytest
from pyspark.sql import functions as F

from opinio.operators.profile import is_empty
from opinio.session import work_dir
from opinio.sources import comments as S


def test_csv_round_trip_with_quotes_and_newlines(spark):
    rows = [(1, 'he said "hi"', "positif"), (2, "line one\nline two", "netral"), (3, "a, b", None),
            (4, "NA", "negatif"), (5, "", "netral")]
    df = spark.createDataFrame(rows, S.COMMENT_SCHEMA)
    path = work_dir(spark, "t-csv")
    S.write_comments_csv(df, path)
    back = {r.no: (r.comment, r.label) for r in S.read_comments(spark, path).collect()}
    assert back[1] == ('he said "hi"', "positif")
    assert back[2] == ("line one\nline two", "netral")
    assert back[3] == ("a, b", None)
    assert back[4][0] is None  # "NA" is a missing-value spelling
    assert back[5][0] is None  # so is the empty string
    raw = {r.no: r.comment for r in S.read_comments(spark, path, na_tokens=None).collect()}
    assert raw[4] == "NA"


def test_require_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "x")], "no long, comment string")
    assert S.require_columns(df, ["comment"]) is df
    with pytest.raises(ValueError, match="predicted_label"):
        S.require_columns(df, ["comment", "predicted_label"])
    assert not is_empty(df)
    assert is_empty(df.filter(F.col("no") < 0))


def test_split_pruning(spark):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "id long, split string")
    path = work_dir(spark, "t-splits")
    S.write_splits(df, path)
    sub = S.read_splits(spark, path, "train")
    assert sorted(r.id for r in sub.collect()) == [1, 3]
    plan = sub._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "train" in plan


def test_split_rename_map(spark):
    df = spark.createDataFrame([(1, "train"), (2, "validation"), (3, "test")], "id long, split string")
    path = work_dir(spark, "t-splits-renamed")
    S.write_splits(df, path, rename={"validation": "test", "test": "val"})
    got = {r.id: r.split for r in S.read_splits(spark, path).collect()}
    assert got == {1: "train", 2: "test", 3: "val"}
