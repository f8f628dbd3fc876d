"""Operator 3: WARC archives and their globally ordered capture index.

Writing: pages become WARC records (one response per distinct payload, revisits for the
others), sorted inside each file by URL key and time.  A file is plain WARC/1.1, written
by Spark's text sink with the record end as line separator, so any file system that Spark
reaches will do.  Reading: the text source splits archives at record starts, so large
archives are read in parallel.  A payload in which a record start could be mistaken is
stored base64-coded and marked so in its HTTP header.

Index: the captures of each archive split are a locally sorted run.  Runs are dealt to
key ranges (URL key, time, page id), and each range merges its run slices k-way with a
loser tree: the result is ordered globally, a capture history per URL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.llm.common import broadcast_if_small, column, partitions_of, settle

CRLF = "\r\n"
VERSION = "WARC/1.1"
RECORD_END = CRLF + CRLF
#: Time of the capture of page 0; page ids count seconds from it.
EPOCH = 1704067200
SPAN = 10 ** 11
#: Copies of a duplicated payload are dealt over so many keys where its leader is joined.
SALT = 16
#: Index rows that one merge task holds, as near as sampled key ranges come to it.
RANGE_ROWS = 200_000

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = "url_key string, captured bigint, page_id bigint, record_type string, refers_to bigint, " \
        "payload_bytes bigint, payload_digest string"


def base32(hex_digest: Column) -> Column:
    """Base32 of a 40-digit hexadecimal digest: 5 hex digits are 4 symbols."""
    part = lambda k: F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 10).cast("int")
    symbol = lambda k, s: F.substring(F.lit(ALPHABET), F.shiftright(part(k), s).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[symbol(k, s) for k in range(8) for s in (15, 10, 5, 0)])


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then the rest (null: empty)."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.when(F.length(url) > 0, key).otherwise("")


def one_line(url: Column) -> Column:
    """A URL as it stands in a header line."""
    return F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 min_bytes: int = 0) -> DataFrame:
    """Pages with digest and record type; payloads stay in their tasks.

    Only (digest, largest page id) of payloads that occur more than once are gathered.
    Equal payloads of at least ``min_bytes`` bytes have one response, that with the largest
    page id, and revisits that refer to it.  Null html is an empty payload.  A null page
    id is smaller than any other; if a group has only null ids all are responses; rows that
    repeat the largest id are responses too.
    """
    html = F.coalesce(column(pages, html_col), F.lit(""))
    df = pages.select(column(pages, id_col).cast("long").alias("page_id"), column(pages, url_col).alias("url"),
                      html.alias("payload"), F.sha1(html.cast("binary")).alias("hex"))
    df = df.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    groups = df.groupBy("hex").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("leader"),
                                   F.first("payload_bytes").alias("size"))
    leaders = settle(groups.where((F.col("n") > 1) & F.col("leader").isNotNull() & (F.col("size") >= min_bytes))
                     .select(F.col("hex").alias("_hex"), "leader"))
    small = broadcast_if_small(leaders, F.lit(64))
    if small is not leaders:
        joined = df.join(small, F.col("hex") == F.col("_hex"), "left")
    else:  # many groups: a shuffle join with each group dealt over SALT keys
        salted = leaders.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
        joined = df.join(salted, (F.col("hex") == F.col("_hex"))
                         & (F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)) == F.col("_salt")), "left")
    revisit = F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", base32(F.col("hex")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("leader")).alias("refers_to"))


def _second() -> Column:
    """When a page was captured.  Large ids (hashes) and negative ones are taken modulo some
    3,000 years, so that the year has four digits."""
    return F.coalesce(F.pmod(F.col("page_id"), F.lit(SPAN)), F.lit(0))


def _record(coded: Column) -> Column:
    """The text of a record without its end."""
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + _second()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, "").when(coded, F.base64(F.col("payload").cast("binary"))).otherwise(F.col("payload"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
                    F.when(coded, F.lit(f"Content-Encoding: x-base64{CRLF}")).otherwise(""),
                    line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF), body)
    return F.concat(
        F.lit(f"{VERSION}{CRLF}"), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", one_line(F.col("url"))), F.lit("")), line("WARC-Date", date),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", urn(F.col("refers_to"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))))
        .otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(http).cast("string")), F.lit(CRLF), http)


def write_archives(records: DataFrame, path: str) -> None:
    """Write planned records; each file is sorted by URL key and time."""
    coded = (F.col("record_type") == "response") & F.col("payload").contains(VERSION)
    (records.select(_record(coded).alias("value"), url_key(one_line(F.col("url"))).alias("k"), "page_id")
     .sortWithinPartitions("k", _second(), F.col("page_id").asc_nulls_last()).select("value")
     .write.option("lineSep", RECORD_END).text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path``: INDEX columns, ``url``, ``payload``, and
    ``run, seq``: the archive split and the place in it.

    For a response, bytes and digest are those of the payload read; a revisit has none, so
    its own headers tell them.
    """
    raw = spark.read.option("lineSep", RECORD_END + VERSION + CRLF).text(path)
    head = F.substring_index("value", RECORD_END, 1)
    df = raw.select("value", F.concat(F.lit(CRLF), head, F.lit(CRLF)).alias("head"),
                    F.concat_ws("#", F.input_file_name(), F.spark_partition_id()).alias("run"),
                    F.monotonically_increasing_id().alias("seq"))
    header = lambda text, name: F.nullif(
        F.regexp_extract(text, f"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    block = F.expr("substring(value, length(head) + 1)")  # head has one line end more than what it was cut from
    df = df.where(F.col("head").contains("WARC-Type: ")).withColumn("block", block)
    http = F.substring_index("block", RECORD_END, 1)
    df = df.withColumn("http", F.concat(F.lit(CRLF), http, F.lit(CRLF)))
    body = F.expr("substring(block, length(http) + 1)").cast("binary")
    length = header(F.col("http"), "Content-Length").cast("int")
    urn = lambda name: F.regexp_extract(header(F.col("head"), name), r"<urn:page:(-?\d+)>", 1)
    number = lambda name: F.nullif(urn(name), F.lit("")).cast("long")
    response = header(F.col("head"), "WARC-Type") == "response"
    payload = F.when(response & F.col("http").contains("Content-Encoding: x-base64"),
                     F.unbase64(F.regexp_replace(body.cast("string"), "[^A-Za-z0-9+/=]", ""))) \
        .when(response, F.expr("substring(cast(substring(block, length(http) + 1) as binary), 1, "
                               "cast(regexp_extract(http, '\r\nContent-Length: ([0-9]+)\r\n', 1) as int))"))
    df = df.withColumn("payload", payload)
    url = header(F.col("head"), "WARC-Target-URI")
    return df.select(
        url_key(url).alias("url_key"),
        F.unix_timestamp(header(F.col("head"), "WARC-Date"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        number("WARC-Record-ID").alias("page_id"), header(F.col("head"), "WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        F.when(response, F.octet_length("payload")).otherwise(length).cast("long").alias("payload_bytes"),
        F.when(response, base32(F.sha1("payload")))
        .otherwise(F.substring_index(header(F.col("head"), "WARC-Payload-Digest"), ":", -1)).alias("payload_digest"),
        url.alias("url"), "payload", "run", "seq")


class LoserTree:
    """Merge of ``k`` sorted lists: inner nodes keep the loser of their last match.

    Taking the next item replays one path, about log2(k) comparisons.
    Items are ``(*key, payload)``: only the key is compared.
    """

    def __init__(self, runs: list[list]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.size = k
        self.losers = [-1] * max(1, k)
        for i in range(k):
            self._replay(i, filling=True)

    def _key(self, i: int):
        """Head of run ``i``; an exhausted run is after everything."""
        run, at = self.runs[i], self.at[i]
        return (0, run[at][:-1], i) if at < len(run) else (1, i)

    def _replay(self, i: int, filling: bool = False) -> None:
        winner, node = i, (i + self.size) // 2
        while node > 0:
            held = self.losers[node]
            if held == -1 and filling:  # first to arrive waits here
                self.losers[node] = winner
                return
            if self._key(held) < self._key(winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        if not self.size:
            return
        while True:
            i = self.losers[0]
            if self.at[i] >= len(self.runs[i]):
                return
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self._replay(i)


def _null_last(value):
    return (value is None, 0 if value is None else value)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list] = {}
    schema = None
    for batch in batches:
        names = [n for n in batch.schema.names if n not in ("run", "seq")]
        schema = pa.schema([batch.schema.field(n) for n in names])
        cols = [batch.column(n).to_pylist() for n in names]
        key = [list(map(_null_last, batch.column(n).to_pylist())) for n in ("url_key", "captured", "page_id")]
        for run, *k, row in zip(batch.column("run").to_pylist(), *key, zip(*cols, strict=True), strict=True):
            runs.setdefault(run, []).append((*k, row))
    out = []
    for item in LoserTree(list(runs.values())):
        out.append(item[-1])
        if len(out) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def merge_index(captures: DataFrame, rows: int | None = None) -> DataFrame:
    """Capture index in global order of URL key, time and page id.

    ``captures`` are index rows with ``run, seq``, sorted inside each run.  Key ranges are
    sampled over the whole composite key, so a URL with very many captures is several
    ranges.  ``rows``, their count, sizes the ranges; if it is not known they are counted.
    The captures are written once: sampling the ranges would read and digest the archives
    another time.
    """
    spark = captures.sparkSession
    names = [f.split()[0] for f in INDEX.split(", ")]
    captures = settle(captures.select(*names, "run", "seq"))
    rows = captures.count() if rows is None else rows
    n = max(partitions_of(spark), -(-rows // RANGE_ROWS))
    dealt = (captures
             .repartitionByRange(n, F.col("url_key").asc_nulls_last(), F.col("captured").asc_nulls_last(),
                                 F.col("page_id").asc_nulls_last())
             .sortWithinPartitions("run", "seq"))
    return dealt.mapInArrow(_merge, INDEX)
