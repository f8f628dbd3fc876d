"""Negation-aware lexicon scoring as array expressions (no shuffle).

The original scorer walks the words left to right and, on "negator + polar
word", consumes both and emits a flipped marker.  Because negators and polar
words are disjoint (enforced by :class:`opinio.resources.Lexicon`), that scan
equals a purely local rule: a polar word is flipped iff the word before it is
a negator, and a negator is dropped iff the word after it is polar.  Both
rules look at one neighbour, so they are ``zip_with`` over shifted copies of
the token array -- linear in the word count, with ``isin`` compiled to a hash
set lookup for larger lists.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinio.resources import Lexicon

NEG_PREFIX = "NEG_"
POS_PREFIX = "POS_"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _previous(ws: Column) -> Column:
    """[null, w0, w1, ...]: element i is the word before word i."""
    return F.concat(F.array(F.lit(None).cast("string")), ws)


def _next(ws: Column) -> Column:
    """[w1, w2, ...]: element i is the word after word i (short by one)."""
    return F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1)))


def polarity(w: Column, lex: Lexicon) -> Column:
    return (F.when(w.isin(list(lex.positive)), F.lit(1))
            .when(w.isin(list(lex.negative)), F.lit(-1))
            .otherwise(F.lit(0)))


def lexicon_score(ws, lex: Lexicon) -> Column:
    """L2: sum of word polarities, sign-flipped after a negator.

    ``ws`` must be an already materialised token column (see
    :func:`opinio.functions.text.word_tokens`).
    """
    ws = _c(ws)
    contrib = F.zip_with(
        ws, _previous(ws),
        lambda w, p: polarity(w, lex) * F.when(p.isin(list(lex.negators)), F.lit(-1)).otherwise(F.lit(1)))
    return F.aggregate(contrib, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def negation_marks(ws, lex: Lexicon) -> Column:
    """L1: the processed word list -- negators before a polar word dropped,
    the polar word replaced by ``NEG_w`` (positive) or ``POS_w`` (negative)."""
    ws = _c(ws)
    polar = list(lex.positive) + list(lex.negative)
    negs = list(lex.negators)
    pairs = F.zip_with(ws, _previous(ws), lambda w, p: F.struct(w.alias("w"), p.alias("p")))
    triples = F.zip_with(pairs, _next(ws),
                         lambda s, n: F.struct(s["w"].alias("w"), s["p"].alias("p"), n.alias("n")))
    marked = F.transform(triples, lambda t: (
        F.when(t["w"].isNull(), F.lit(None).cast("string"))
        .when(t["w"].isin(negs) & t["n"].isin(polar), F.lit(None).cast("string"))
        .when(t["p"].isin(negs) & t["w"].isin(list(lex.positive)), F.concat(F.lit(NEG_PREFIX), t["w"]))
        .when(t["p"].isin(negs) & t["w"].isin(list(lex.negative)), F.concat(F.lit(POS_PREFIX), t["w"]))
        .otherwise(t["w"])))
    return F.filter(marked, lambda x: x.isNotNull())


def score_label(score) -> Column:
    """L3: >0 positif, <0 negatif, otherwise netral."""
    s = _c(score)
    return (F.when(s > 0, F.lit("positif")).when(s < 0, F.lit("negatif"))
            .otherwise(F.lit("netral")))
