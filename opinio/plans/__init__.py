"""Registered queries over the driver tables.

Each query is a plan over whole tables, ``(spark, sf_dir) -> DataFrame``, with
(where one can be written) an equivalent DuckDB SQL oracle.
"""

from opinio.plans.registry import REGISTRY, Query  # noqa: F401
from opinio.plans import text_queries, lexicon_queries  # noqa: F401,E402

from opinio.plans import io_queries, ml_queries  # noqa: F401,E402


def queries():
    return {k: q.fn for k, q in REGISTRY.items()}


def oracle_sql():
    return {k: q.sql for k, q in REGISTRY.items() if q.sql}
