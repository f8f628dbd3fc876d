import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # names that operators use for their own results
                     *[T.StructField(c, T.StringType()) for c in ("size", "score", "h", "rid", "n_words", "items", "kept", "target")]])


@pytest.fixture
def docs_of(spark):
    """Builds a documents table with clashing extra columns from (id, text[, source]) rows."""
    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "a", None, *["x"] * 8) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty, white-space, ties, repeated rows, a very long text without spaces."""
    body = " ".join(f"word{i}" for i in range(60))
    return [(1, None), (2, ""), (3, " \n\t "), (4, body), (4, body), (5, body), (None, body), (None, None),
            (6, "x" * 300_000), (7, "a b"), (8, "a b"), (9, (body + "\n") * 3)]
