from opinio.sources.tables import load_table, spread, bounded_broadcast, TABLES
from opinio.sources.comments import (
    read_comments, normalize_na, read_splits, write_splits, write_comments_csv,
    require_columns, quarantine_malformed, COMMENT_SCHEMA,
)

__all__ = [
    "load_table", "spread", "bounded_broadcast", "TABLES",
    "read_comments", "normalize_na", "read_splits", "write_splits", "write_comments_csv",
    "require_columns", "quarantine_malformed", "COMMENT_SCHEMA",
]
