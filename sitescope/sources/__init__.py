"""Scans, validation and sinks."""

from .validate import ensure_min_rows, ensure_not_empty, require_columns  # noqa: F401
from .readers import batch_template, read_table, load_batch, load_districts, load_observations, load_sites  # noqa: F401
from .sinks import write_table  # noqa: F401
from .district_store import lookup_stored, store_districts, stored_districts  # noqa: F401
