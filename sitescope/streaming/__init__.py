"""Structured Streaming jobs built from the batch operators."""

from .scoring import final_windows, late_rows, run_to_table, run_wave, score_stream, windowed_rate  # noqa: F401
