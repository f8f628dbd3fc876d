"""Operator 2: personal data by pattern proposals, checksums and context.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for
bank account numbers, number ranges for addresses), and words near a span adjust its
score.  The base kinds (email, ip, card, phone) follow fixed rules: leftmost
non-overlapping matches, failing ones dropped without a retry; they are always
reported.  The added kinds (iban, ssn, secret) are reported where validator and context
bring their score to the threshold.

Texts are scanned in Arrow batches inside tasks; there is no shuffle.  All scans are
linear in the text, also in texts without white space.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import column

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "secret")
KINDS = BASE_KINDS + ADDED_KINDS

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that fails from its start fails from inside too: only run starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
# Shorter chains of digits would be dropped by the 13-digit rule.
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Context words by kind: near a span they raise its score, COUNTER words lower it.
CONTEXT = {
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "identity"),
    "secret": ("token", "secret", "key", "password", "credential", "api"),
}
COUNTER = ("example", "sample", "test", "isbn", "version", "checksum", "sha1", "sha256", "md5", "commit")
CONTEXT_CHARS = 40
#: Score of a confirmed proposal without context, by kind, and the reporting threshold.
PRIOR = {"iban": 0.8, "ssn": 0.4, "secret": 0.4}
THRESHOLD = 0.5
STEP = 0.3


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    """Bank account check: country and check digits moved to the end, letters as 10..35."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(ch, 36)) for ch in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # The local part cannot hold '@': a match is the run of local characters left of one.
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        hit = _DOMAIN.match(text, at + 1) if start < at else None
        # Left of this '@' nothing can match later unless it reaches a later '@' directly.
        free = hit.end() if hit else at + 1
        if hit:
            yield start, hit.end()
        at = text.find("@", free)


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    for hit in _IP.finditer(text):
        if all(int(part) <= 255 for part in (p.lstrip("0")[:4] or "0" for p in hit.group().split("."))):
            yield "ip", hit.start(), hit.end()
    for hit in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", hit.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", hit.start(), hit.end()
    if "+" in text:
        for hit in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", hit.group())) <= 15:
                yield "phone", hit.start(), hit.end()
    for hit in _IBAN.finditer(text):
        # Spaces are allowed in groups; words after the number may be caught with it, so the
        # confirmed account is the longest leading part that passes.
        parts = hit.group().split(" ")
        for n in range(len(parts), 0, -1):
            account = "".join(parts[:n])
            if 15 <= len(account) <= 34 and mod97(account):
                yield "iban", hit.start(), hit.start() + len(" ".join(parts[:n]))
                break
    for hit in _SSN.finditer(text):
        area, group, serial = hit.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", hit.start(), hit.end()
    for hit in _SECRET.finditer(text):
        yield "secret", hit.start(), hit.end()


def score_span(text: str, kind: str, start: int, end: int) -> float:
    """Score of a confirmed proposal: 1 for base kinds, else prior plus context."""
    if kind in BASE_KINDS:
        return 1.0
    near = (text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]).lower()
    words = set(re.findall(r"[a-z0-9]+", near))
    score = PRIOR[kind] + STEP * any(w in words for w in CONTEXT[kind]) - STEP * any(w in words for w in COUNTER)
    if kind == "secret" and text[start:end].startswith("AKIA"):
        score += STEP  # the key's own prefix is evidence
    return max(0.0, min(1.0, score))


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by kind as listed, then start; null text has none.

    Offsets count code points, the end is exclusive.
    """
    out = []
    for kind, start, end in _proposals(text or ""):
        score = score_span(text, kind, start, end)
        if score >= THRESHOLD:
            out.append((kind, start, end, score))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t.as_py())]
                 for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(span))],
                                         [*batch.schema.names[:-1], "pii"])


def detect(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns plus ``pii``, the spans of each whole text in order.

    Null and empty texts have no spans; rows are independent, so repeated rows give
    repeated results and an empty table an empty one.
    """
    kept = [c for c in keep if c != "pii"]
    slim = docs.select(*[column(docs, c) for c in kept], column(docs, text_col).alias("__text"))
    schema = slim.drop("__text").select("*", F.lit(None).cast(
        "array<struct<kind:string,start:bigint,end:bigint,score:double>>").alias("pii")).schema
    return slim.mapInArrow(_scan, schema)


def span_string(spans: list[dict], kinds=KINDS) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] in kinds)


def span_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
