"""Comment-table sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from opinio.functions.text import null_if_na
from opinio.resources import PANDAS_NA_TOKENS
from opinio.sources.quoted import read_quoted

COMMENT_SCHEMA = "no BIGINT, comment STRING, label STRING"
CORRUPT_COL = "_corrupt_record"
CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""',
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _ddl(schema) -> str:
    if isinstance(schema, str):
        return schema
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _names(spark: SparkSession, schema) -> list[str]:
    return StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names


def _parsed(spark: SparkSession, path: str, schema, multiline: bool, header: bool, corrupt_col: str | None = None) -> DataFrame:
    """The rows of CSV files (RFC 4180: a quote inside a field is doubled) with ``file, block, n``,
    their place: file, offset of the split, number in the split.

    Fields may span lines, and files are split all the same (:mod:`opinio.sources.quoted`);
    with ``multiline=False`` a record is a line, whatever its quotes.
    """
    if multiline:
        return read_quoted(spark, path, _ddl(schema), header, corrupt_col)
    reader = spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", '"')
    if corrupt_col:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt_col)
    df = reader.csv(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("n"), *df.columns)


def read_comments(spark: SparkSession, path: str, schema=COMMENT_SCHEMA,
                  na_tokens: Iterable[str] | None = PANDAS_NA_TOKENS,
                  row_id: str | None = "row_id", id_col: str | None = "no",
                  multiline: bool = True) -> DataFrame:
    """S1 (+S2): CSV with header, quotes and embedded newlines, explicit schema.

    ``row_id`` is taken from ``id_col`` when present.  Otherwise it is the row's place,
    ``struct(file, block, line)`` -- file path, offset of the split in the file, number of the
    record in the split -- which orders rows as the files list them, whatever order Spark
    reads the splits in; the rows are then written once to the shared folder, so every later
    read sees the same ids.
    """
    names = _names(spark, schema)
    df = _parsed(spark, path, schema, multiline, header=True)
    place = F.struct("file", "block", F.col("n").alias("line")).alias("__place")
    df = df.select(*names, place)
    if na_tokens is not None:
        df = normalize_na(df, na_tokens)
    if row_id and id_col and id_col in names:
        return df.drop("__place").withColumn(row_id, F.col(id_col).cast("long"))
    if row_id:
        from opinio.session import checkpoint_root
        checkpoint_root(spark)
        return df.withColumnRenamed("__place", row_id).checkpoint()
    return df.drop("__place")


def normalize_na(df: DataFrame, tokens: Iterable[str] = PANDAS_NA_TOKENS,
                 cols: Sequence[str] | None = None) -> DataFrame:
    """Spellings of "missing" become null in string columns."""
    tokens = list(tokens)
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: null_if_na(c, tokens) for c in cols})


def write_comments_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, no index, null as empty field, quotes doubled, spaces at either end of a
    value kept.  No ``coalesce(1)``: every task writes its own part file."""
    df.write.mode(mode).options(**CSV_WRITE).csv(path)


def write_splits(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite",
                 rename: Mapping[str, str] | None = None) -> None:
    """Write a table partitioned by split name (parquet).

    ``rename`` maps source split names to the names written (e.g. a source
    whose ``validation`` split is to be stored as ``test``); names not in the
    map are kept.  It is a column expression, applied before partitioning.
    """
    if rename:
        m = F.create_map(*[F.lit(x) for kv in rename.items() for x in kv])
        df = df.withColumn(split_col, F.coalesce(F.try_element_at(m, F.col(split_col)), F.col(split_col)))
    df.write.mode(mode).partitionBy(split_col).parquet(path)


def read_splits(spark: SparkSession, path: str, split: str | None = None,
                split_col: str = "split") -> DataFrame:
    """S3: named splits; filtering on the split prunes whole directories."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col(split_col) == split)


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fail at plan time when a required column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")
    return df


def quarantine_malformed(spark: SparkSession, path: str, schema: StructType,
                         multiline: bool = True, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Parse permissively; return ``(good_rows, bad_rows)``.  A malformed
    record is data, not a crash: it lands in ``bad_rows`` with its raw text."""
    full = StructType(list(schema.fields) + [StructField(CORRUPT_COL, StringType(), True)])
    raw = _parsed(spark, path, full, multiline, header, CORRUPT_COL)
    # Spark fills the corrupt-record column reliably only on a materialised
    # parse (documented for raw CSV/JSON scans), so the parse is written once to
    # the shared folder, both outputs read that copy, and Spark removes it when
    # neither is referenced any more.
    from opinio.session import checkpoint_root
    checkpoint_root(spark)
    raw = raw.checkpoint()
    names = [f.name for f in schema.fields]
    good = raw.filter(F.col(CORRUPT_COL).isNull()).select(*names)
    bad = raw.filter(F.col(CORRUPT_COL).isNotNull()).select(*names, CORRUPT_COL)
    return good, bad
