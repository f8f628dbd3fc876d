"""Label mapping, guards and score vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinio.functions.text import strip_ends


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _flag(c) -> Column:
    # A missing flag counts as "not set".
    return F.coalesce(_c(c).cast("double"), F.lit(0.0)) != 0


def stars_to_label(star1, star2, star3, star4, star5) -> Column:
    """First matching rule wins -- 4/5 stars, then 3, then 1/2."""
    return (F.when(_flag(star4) | _flag(star5), F.lit("Positif"))
            .when(_flag(star3), F.lit("Netral"))
            .when(_flag(star1) | _flag(star2), F.lit("Negatif"))
            .otherwise(F.lit("Unknown")))


def map_values(c, mapping: Mapping) -> Column:
    """Dictionary lookup; an unmapped value gives null."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, _c(c))


def label_code(label) -> Column:
    """P10: positif 2, negatif 0, anything else 1."""
    lab = _c(label)
    return (F.when(lab == "positif", F.lit(2)).when(lab == "negatif", F.lit(0))
            .otherwise(F.lit(1)))


def blank_guard(text, prediction, default: str = "netral") -> Column:
    """Blank or missing text gets the default label."""
    return (F.when(strip_ends(F.coalesce(_c(text), F.lit(""))) == "", F.lit(default))
            .otherwise(_c(prediction)))


def argmax_index(scores) -> Column:
    """0-based position of the first maximum."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def argmax_label(scores, labels: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), argmax_index(scores) + 1)


def shifted_exp(scores, max_col) -> Column:
    """M6 step 1: ``exp(z - max z)``; ``max_col`` is a materialised column."""
    return F.transform(_c(scores).cast("array<double>"), lambda x: F.exp(x - _c(max_col)))


def array_sum(values) -> Column:
    return F.aggregate(_c(values), F.lit(0.0), lambda a, y: a + y)


def divide_by(values, total_col) -> Column:
    """M6 step 2: divide every element by a materialised total column."""
    return F.transform(_c(values), lambda x: x / _c(total_col))
