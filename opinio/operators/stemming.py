"""Confix-stripping stems of Indonesian words against a root dictionary.

A word is taken apart by its affixes, outermost first: a particle, a possessive, a
derivational suffix, then up to three prefixes, whose assimilated first letter of the root is
put back (``menulis`` -> ``tulis``).  Which forms are tried, and in which order, depends on the
word alone; the first that is a root is the stem.  So each distinct word is turned into its
ordered candidates once, the candidates meet the dictionary in one join, and the least
candidate that is left wins.  The dictionary is a table of any size and is never collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.sources.tables import bounded_broadcast

# Fixed values of the language: affixes of the confix-stripping scheme.
PARTICLES = ("lah", "kah", "tah", "pun")
POSSESSIVES = ("nya", "ku", "mu")
SUFFIXES = ("kan", "an", "i")
VOWELS = frozenset("aiueo")
#: Prefix and suffix that never go together.
NEVER = frozenset({("be", "i"), ("di", "an"), ("ke", "i"), ("ke", "kan"), ("me", "an"), ("se", "i"), ("se", "kan"), ("te", "an")})
#: Such pairs are stripped from the front first.
FRONT_FIRST = (("be", "lah"), ("be", "an"), ("me", "i"), ("di", "i"), ("pe", "i"), ("te", "i"))
#: Nasal of a ``me``/``pe`` prefix -> first letters of a root that it may stand for before a vowel.
ASSIMILATED = {"m": ("m", "p"), "n": ("n", "t"), "ng": ("", "k"), "ny": ("s", "ny")}
#: Letters before which a nasal is only put in front.
KEPT = {"m": "bfvp", "n": "cdjszt", "ng": "ghqk"}
MOST_PREFIXES, SHORTEST = 3, 2


def without_prefix(word: str) -> tuple[str, list[str]]:
    """The kind of the word's prefix (empty: none) and what may stand behind it, in order."""
    kind, rest = word[:2], word[2:]
    if kind in ("di", "ke", "se"):
        return kind, [rest]
    if kind not in ("be", "te", "me", "pe") or len(rest) < 2:
        return "", []
    if kind in ("be", "te") or kind == "pe" and rest[0] == "r":
        if rest in ("lajar",):  # belajar
            return kind, ["ajar"]
        if rest[0] == "r":
            behind = rest[1:]
            return kind, [behind, rest] if behind[:1] in VOWELS else [behind]
        return kind, [rest]
    if rest == "lajar":  # pelajar
        return kind, ["ajar"]
    for nasal in ("ng", "ny", "m", "n"):
        if rest.startswith(nasal):
            behind = rest[len(nasal):]
            if behind[:1] in VOWELS:
                options = [first + behind for first in ASSIMILATED[nasal]]
                if nasal == "ng" and behind[0] == "e":  # before roots of one syllable
                    options.append(behind[1:])
                return kind, options
            if behind[:1] and behind[0] in KEPT.get(nasal, ""):
                return kind, [behind]
            if behind[:1] == "r" and nasal == "m":
                return kind, ["p" + behind, rest]
            break
    return kind, [rest]


def _behind_prefixes(word: str, suffix: str, last: str = "", left: int = MOST_PREFIXES) -> Iterator[str]:
    kind, options = without_prefix(word)
    if not left or not kind or kind == last or (kind, suffix) in NEVER:
        return
    for rest in options:
        if len(rest) >= SHORTEST:
            yield rest
            yield from _behind_prefixes(rest, suffix, kind, left - 1)


def _cut(word: str, endings: tuple[str, ...]) -> tuple[str, str]:
    for e in endings:
        if word.endswith(e) and len(word) - len(e) >= SHORTEST:
            return word[:-len(e)], e
    return word, ""


def _from_the_back(word: str) -> Iterator[str]:
    bare, _ = _cut(word, PARTICLES)
    yield bare
    own, _ = _cut(bare, POSSESSIVES)
    yield own
    root, suffix = _cut(own, SUFFIXES)
    yield root
    yield from _behind_prefixes(root, suffix)
    # Nothing found: what was cut may belong to the root, so it is put back, innermost first.
    if suffix == "kan":
        yield root + "k"
        yield from _behind_prefixes(root + "k", "an")
    for whole in (own, bare, word):
        yield whole
        yield from _behind_prefixes(whole, "")


def candidates(word: str) -> list[str]:
    """The forms of ``word`` that may be its root, in the order in which they are tried."""
    def each() -> Iterator[str]:
        yield word
        if any(word.startswith(p) and word.endswith(s) for p, s in FRONT_FIRST):
            for rest in _behind_prefixes(word, ""):
                yield rest
                yield from _from_the_back(rest)
        yield from _from_the_back(word)
    return list(dict.fromkeys(w for w in each() if len(w) >= SHORTEST or w == word))


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        tried = [candidates(w) for w in words]
        yield pa.RecordBatch.from_pydict({
            "word": pa.array([w for w, c in zip(words, tried, strict=True) for _ in c], pa.string()),
            "prio": pa.array([i for c in tried for i in range(len(c))], pa.int32()),
            "cand": pa.array([x for c in tried for x in c], pa.string())})


def confix_stems(vocab: DataFrame, roots: DataFrame) -> DataFrame:
    """``(word, stem)`` for every distinct word of ``vocab`` (``word``), given ``roots`` (``word``).

    A word without a root among its candidates is its own stem.  A plural written as two
    words with a hyphen (``berbalas-balasan``) has the stem on which both halves agree; if
    they do not agree it is its own stem.  Null words have no row.
    """
    from opinio.session import checkpoint_root
    checkpoint_root(vocab.sparkSession)
    words = vocab.select("word").where("word IS NOT NULL").distinct().checkpoint()
    # Halves of plurals; particles and possessives after a second hyphen go with the right one.
    plural = "^([^-]+)-([^-]+)(-(?:lah|kah|tah|pun|nya|ku|mu))?$"
    half = lambda i: F.regexp_extract("word", plural, i)
    pairs = (words.where(F.col("word").contains("-")).select("word", F.explode(F.array(half(1), half(2))).alias("part"))
             .where("part != ''").checkpoint())
    simple = words.unionByName(pairs.select(F.col("part").alias("word"))).distinct()
    tried = simple.mapInArrow(_expand, "word string, prio int, cand string")
    known = bounded_broadcast(roots.select(F.col("word").alias("cand")).where("cand IS NOT NULL").distinct().checkpoint())
    found = tried.join(known, "cand", "left_semi").groupBy("word").agg(F.min(F.struct("prio", "cand")).alias("b"))
    found = found.select("word", F.col("b.cand").alias("stem")).checkpoint()
    agreed = (pairs.join(found.withColumnRenamed("word", "part"), "part").groupBy("word")
              .agg(F.min("stem").alias("lo"), F.max("stem").alias("hi"), F.count(F.lit(1)).alias("n"))
              .where("n = 2 AND lo = hi").select("word", F.col("lo").alias("both")))
    return (words.join(found, "word", "left").join(agreed, "word", "left")
            .select("word", F.coalesce("stem", "both", "word").alias("stem")))
