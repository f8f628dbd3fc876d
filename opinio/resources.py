"""Lookup tables the operators take as inputs.

Each list below is a fixed value: it must equal the word list of the
original workflow for results to match, so it is spelled out plainly,
in its original order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (sentiment lexicon, negation words, synonyms, label codes).
# ---------------------------------------------------------------------------
POSITIVE_WORDS = ("bagus", "baik", "indah", "cerah", "puas", "suka", "alhamdulillah")
NEGATIVE_WORDS = ("buruk", "jelek", "kecewa", "mengecewakan")
NEGATION_WORDS = ("tidak", "bukan", "kurang", "belum")
NEGATION_WORDS_WITH_TAK = ("tidak", "bukan", "kurang", "belum", "tak")
SYNONYMS = {
    "gk": "tidak", "gak": "tidak", "tdk": "tidak", "ga": "tidak", "nggak": "tidak",
    "berkilau": "cerah", "glowing": "cerah",
    "dr": "dari",
}
LABEL_CODES = {"negatif": 0, "netral": 1, "positif": 2}
LABELS = ("negatif", "netral", "positif")
DEFAULT_LABEL = "netral"
STAR_LABELS = ("Positif", "Netral", "Negatif", "Unknown")

# Spellings pandas' CSV reader turns into a missing value by default
# (public pandas constant STR_NA_VALUES), listed in sorted order.
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


@dataclass(frozen=True)
class Lexicon:
    """Polarity lexicon plus negators.  Negators and polar words must be
    disjoint: that is what makes "flip iff the previous word is a negator"
    equal to the left-to-right consuming scan of the original scorer."""

    positive: tuple[str, ...]
    negative: tuple[str, ...]
    negators: tuple[str, ...]
    name: str = field(default="lexicon", compare=False)

    def __post_init__(self):
        pos, neg, nots = set(self.positive), set(self.negative), set(self.negators)
        clash = (pos & neg) | (pos & nots) | (neg & nots)
        if clash:
            raise ValueError(f"lexicon word lists overlap: {sorted(clash)}")

    @property
    def size(self) -> int:
        return len(self.positive) + len(self.negative) + len(self.negators)

    def polarity_rows(self) -> list[tuple[str, int]]:
        return [(w, 1) for w in self.positive] + [(w, -1) for w in self.negative]

    def polarity_frame(self, spark):
        return spark.createDataFrame(self.polarity_rows(), "word string, polarity int")

    def negator_frame(self, spark):
        return spark.createDataFrame([(w,) for w in self.negators], "word string")


REFERENCE_LEXICON = Lexicon(POSITIVE_WORDS, NEGATIVE_WORDS, NEGATION_WORDS, "reference")
REFERENCE_LEXICON_TAK = Lexicon(POSITIVE_WORDS, NEGATIVE_WORDS, NEGATION_WORDS_WITH_TAK, "reference_tak")

# Test parameters for the driver's multilingual `documents` table, where the
# Indonesian lexicon never matches.  Invented for mechanical coverage only.
DOCS_LEXICON = Lexicon(("der", "de", "la"), ("die", "le", "en", "las"), ("nicht", "pas", "no"), "docs")
DOCS_STOPWORDS = ("the", "and", "of", "et", "le", "la", "les", "des", "und", "der", "die", "el", "los")
DOCS_SYNONYMS = {"nicht": "no", "pas": "no", "ne": "no", "les": "le", "des": "de"}
DOCS_LANGS = ("de", "en", "es", "fr", "it")
# Single-code-point and multi-code-point emoji with names, for T10 tests.
DOCS_EMOJI = {"\U0001F600": "grinning_face", "\U0001F44D\U0001F3FD": "thumbs_up_medium_skin_tone",
              "\U0001F44D": "thumbs_up", "❤️": "red_heart",
              # Sequences that the driver's multilingual tables hold.
              "é": "e_acute", ".\n": "end_of_line", ".": "full_stop", "ß": "sharp_s"}
