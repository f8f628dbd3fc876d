"""Splittable quoted CSV: equal to the reader that gives each file to one task."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from opinio.session import work_dir
from opinio.sources import comments as S
from opinio.sources import quoted as Q

SCHEMA = "no BIGINT, comment STRING, label STRING"


def write_text(spark, name, text):
    """One file with exactly this text."""
    path = work_dir(spark, name)
    os.makedirs(path)
    with open(os.path.join(path, "drop.csv"), "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def quoted_rows(seed, n):
    rng = random.Random(seed)
    parts = ["word", " ", ",", "\n", '"', '""', "\n\n", "é", "x,y", '","', '\n"', "5\" pipe", "'"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12))), rng.choice(["positif", "netral", ""])) for i in range(n)]


def as_csv(rows, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["no", "comment", "label"])
    writer.writerows(rows)
    return out.getvalue()


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few lines, so that most records with line breaks cross one."""
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "97b")
    yield
    spark.conf.set(key, old)


def test_ends_inside_a_field():
    for line, out, inside in [("a,b", False, True), ('a,"b', True, False), ('"a""', True, False), ('x"y,z', False, False),
                              ('"', True, False), ('""', False, True), ('"a" b,"c', True, True), ("", False, True), ('a,"b,c"', False, False)]:
        assert (Q.ends_inside(line, False), Q.ends_inside(line, True)) == (out, inside), line


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_file_equals_the_whole_one(spark, tiny_splits, end):
    rows = quoted_rows(3, 300)
    path = write_text(spark, "t-quoted", as_csv(rows, end))
    lines = Q.lines_of(spark.read.option("lineSep", "\n").text(path))
    assert lines.rdd.getNumPartitions() > 20 and Q.states(lines).where("inside").count() > 5
    got = S.read_comments(spark, path, na_tokens=None).orderBy("no").collect()
    whole = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    assert [tuple(r)[:3] for r in got] == [tuple(r) for r in whole.orderBy("no").collect()]
    assert [(r.no, r.comment or "", r.label or "") for r in got] == rows


def test_rows_keep_the_order_of_the_file(spark, tiny_splits):
    rows = quoted_rows(4, 200)
    path = write_text(spark, "t-quoted-order", as_csv(rows))
    got = S.read_comments(spark, path, id_col=None, na_tokens=None).orderBy("row_id").collect()
    assert [r.no for r in got] == [i for i, _, _ in rows]


def test_odd_files(spark, tiny_splits):
    cases = {"empty": "", "header only": "no,comment,label\n", "no end": 'no,comment,label\n1,"a\nb",x',
             "blank lines": "no,comment,label\n\n1,a,x\n\n\n2,b,y\n", "open at the end": 'no,comment,label\n1,a,x\n2,"never closed\nand on',
             "long field": 'no,comment,label\n1,"' + "line\n" * 100 + '",x\n2,"' + "q\n" * 100 + '",y\n'}
    for name, text in cases.items():
        path = write_text(spark, "t-quoted-odd", text)
        got = S.read_comments(spark, path, na_tokens=None).orderBy("no").collect()
        whole = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
        assert [tuple(r)[:3] for r in got] == [tuple(r) for r in whole.orderBy("no").collect()], name


def test_quarantine_keeps_the_raw_record(spark, tiny_splits):
    rows = quoted_rows(5, 120)
    spoilt = [(f"x{i}" if i % 7 == 0 else i, c, l) for i, c, l in rows]
    path = write_text(spark, "t-quoted-bad", as_csv(spoilt))
    from pyspark.sql.types import StructType
    good, bad = S.quarantine_malformed(spark, path, StructType.fromDDL(SCHEMA))
    assert [r.no for r in good.orderBy("no").collect()] == [i for i in range(120) if i % 7]
    raw = sorted(r[S.CORRUPT_COL] for r in bad.collect())
    assert raw == sorted(as_csv([r]).partition("\n")[2][:-1] for r in spoilt if r[0] != rows[0][0] and str(r[0]).startswith("x"))


def test_many_files_of_spark(spark, tiny_splits):
    rows = quoted_rows(6, 150)
    path = work_dir(spark, "t-quoted-parts")
    S.write_comments_csv(spark.createDataFrame(rows, SCHEMA).repartition(5), path)
    got = {r.no: r.comment or "" for r in S.read_comments(spark, path, na_tokens=None).collect()}
    assert got == {i: c for i, c, _ in rows}


def test_stream_of_drops(spark, tiny_splits):
    from opinio.resources import DOCS_LEXICON
    from opinio.streaming import scoring as SS
    rows = quoted_rows(7, 100)
    path = write_text(spark, "t-quoted-stream", as_csv(rows))
    out = SS.run_csv_drops(spark, path, S.COMMENT_SCHEMA, lambda d: SS.score_csv_stream(d, DOCS_LEXICON, "comment"), work_dir(spark, "t-drops"))
    got = {r.no: r.comment or "" for r in out.collect()}
    assert got == {i: c for i, c, _ in rows}
    assert out.where(F.col("predicted_label").isNull()).count() == 0


def test_records_leave_a_task_in_small_batches():
    """A task holds a bounded number of characters of records, whatever a batch of lines holds."""
    from types import SimpleNamespace

    import pyarrow as pa

    from opinio.sources import quoted
    lines = [x for i in range(4000) for x in (f'{i},"{"a" * 500}', f'{"b" * 500}"', f"{i},{'c' * 500}")]
    batch = pa.RecordBatch.from_pydict({"value": lines, "file": ["f"] * len(lines), "block": pa.array([0] * len(lines), pa.int64()),
                                        "at": pa.array([1] * len(lines), pa.int64())})
    out = list(quoted.Records(",", '"', SimpleNamespace(value=frozenset()))(iter([batch])))
    assert max(o.nbytes for o in out) < 1.5 * quoted.RECORD_CHARS < sum(map(len, lines)) / 3
    found = [x for o in out for x in zip(o.column("n").to_pylist(), o.column("record").to_pylist(), strict=True)]
    assert [n for n, _ in found] == list(range(8000))
    assert [r for _, r in found] == [r for i in range(4000) for r in ("\n".join(lines[3 * i:3 * i + 2]), lines[3 * i + 2])]
