"""Driver-side schema checks (names only) and bounded emptiness guards."""

from __future__ import annotations

from pyspark.sql import DataFrame


class SchemaError(ValueError):
    """A required column is missing."""


def require_columns(df: DataFrame, required, what: str = "input") -> DataFrame:
    """Raise listing the missing and the found columns; no Spark job runs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaError(f"{what}: no column {', '.join(missing)} among {', '.join(df.columns)}")
    return df


def ensure_not_empty(df: DataFrame, what: str = "input") -> DataFrame:
    """Raise on an empty table; reads at most one row."""
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def ensure_min_rows(df: DataFrame, n: int, what: str = "input") -> DataFrame:
    """Raise when fewer than ``n`` rows exist; counts at most ``n`` rows."""
    got = df.limit(n).count()
    if got < n:
        raise ValueError(f"{what}: {got} rows, training needs {n} or more")
    return df
