"""Text normalisation and tokenisation expressions.

All functions return Spark ``Column`` expressions built from built-in SQL
functions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Character classes that reproduce Python's Unicode-aware
# ``\w``, ``\s``/``str.split()`` and ``\d``.  Java's ``\w``/``\s`` are ASCII
# only, so the classes are spelled out; the same strings run in RE2 (DuckDB).
# ---------------------------------------------------------------------------
WORD_CHARS = r"\p{L}\p{N}_"
SPACE_CHARS = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_RE = f"[{WORD_CHARS}]+"
WORD2_RE = f"[{WORD_CHARS}]{{2,}}"
PUNCT_RE = f"[^{WORD_CHARS}{SPACE_CHARS}]"
SPACE_RUN_RE = f"[{SPACE_CHARS}]+"
EDGE_SPACE_RE = f"^[{SPACE_CHARS}]+|[{SPACE_CHARS}]+$"
DIGITS_RE = r"\p{Nd}+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c, null_text: str = "") -> Column:
    """Cast to text; a null becomes ``null_text`` ("nan" reproduces
    ``astype(str)`` on a missing value, "" is the intended behaviour)."""
    return F.coalesce(_c(c).cast("string"), F.lit(null_text))


def null_if_na(c, tokens: Iterable[str]) -> Column:
    """Spellings of "missing" become null."""
    c = _c(c)
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def fold_case(c) -> Column:
    """T1."""
    return F.lower(_c(c))


def strip_punctuation(c) -> Column:
    """Drop every character that is neither a word character nor space."""
    return F.regexp_replace(_c(c), PUNCT_RE, "")


def strip_ends(c) -> Column:
    """Trim Unicode whitespace at both ends (inner runs are kept)."""
    return F.regexp_replace(_c(c), EDGE_SPACE_RE, "")


def remove_digits(c) -> Column:
    """T4."""
    return F.regexp_replace(_c(c), DIGITS_RE, "")


def split_words(c) -> Column:
    """T5: whitespace tokenisation (``str.split()`` semantics, no empties)."""
    return F.filter(F.split(_c(c), SPACE_RUN_RE), lambda w: w != F.lit(""))


def join_words(ws) -> Column:
    return F.array_join(_c(ws), " ")


def collapse_spaces(c) -> Column:
    """T5: split and rejoin with single spaces."""
    return join_words(split_words(c))


def word_tokens(c, min_len: int = 1) -> Column:
    """Lower-cased runs of word characters (``\\b\\w+\\b``); with
    ``min_len=2`` the TF-IDF token rule (``\\b\\w\\w+\\b``)."""
    pattern = WORD_RE if min_len <= 1 else f"[{WORD_CHARS}]{{{min_len},}}"
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(pattern), 0)


def normalize(c) -> Column:
    """T1+T2+T3 fused: lower, strip punctuation, trim the ends."""
    return strip_ends(strip_punctuation(fold_case(c)))


def drop_words(ws, words: Iterable[str]) -> Column:
    """T7 (array form): remove listed words, keeping repeats and order.

    ``isin`` over a literal list becomes a hash-set lookup (InSet) past ten
    entries, so the cost is linear in the token count.  ``array_except``
    would also de-duplicate the remaining words, which is wrong here.
    """
    stop = list(words)
    if not stop:
        return _c(ws)
    return F.filter(_c(ws), lambda w: ~w.isin(stop))


def map_words(ws, mapping: Mapping[str, str]) -> Column:
    """Replace each word found in ``mapping``; other words unchanged."""
    if not mapping:
        return _c(ws)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.transform(_c(ws), lambda w: F.coalesce(F.try_element_at(m, w), w))


def replace_emoji(c, names: Mapping[str, str]) -> Column:
    """Each emoji sequence becomes ``" " + name + " "``.

    Longest sequences are replaced first so a skin-toned emoji is not cut
    into its base and modifier.
    """
    out = _c(c)
    for seq in sorted(names, key=lambda s: (-len(s), s)):
        out = F.replace(out, F.lit(seq), F.lit(f" {names[seq]} "))
    return out


def clean_words(c, stopwords: Iterable[str] = (), null_text: str = "") -> Column:
    """T11 as a word array: text cast, lower, digits out, punctuation out,
    whitespace split, stopwords out."""
    base = strip_punctuation(remove_digits(fold_case(as_text(c, null_text))))
    return drop_words(split_words(base), stopwords)


def clean_text(c, stopwords: Iterable[str] = (), null_text: str = "") -> Column:
    """:func:`clean_words` rejoined with single spaces -- one fused
    projection."""
    return join_words(clean_words(c, stopwords, null_text))
