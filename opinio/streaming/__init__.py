"""Structured Streaming forms of the scoring and counting operators."""

from opinio.streaming.scoring import parse_requests, score_requests, score_csv_stream
from opinio.streaming.counts import (windowed_label_counts, run_to_table, running_totals,
                                     run_complete_to_table)

__all__ = ["parse_requests", "score_requests", "score_csv_stream", "windowed_label_counts", "run_to_table",
           "running_totals", "run_complete_to_table"]
