"""Seeded sampling without replacement: exactly min(n, rows) rows.

Rows are ranked by a per-row hash of their key (ties by the key) and the first
n kept: a distributed top-k (each partition keeps n rows), no global sort, and
the same rows whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import class_label, unit_hash, unit_hash_int


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    integral = df.schema[key].dataType.typeName() in ("long", "integer", "short", "byte")
    u = unit_hash_int(key, seed) if integral else unit_hash(key, seed=seed)
    return df.withColumn("_u", u).orderBy("_u", key).limit(n).drop("_u")


def scatter(df: DataFrame, x: str, y: str, key: str, n: int = K.SCATTER_SAMPLE, seed: int = 42,
            label: str = K.LABEL_COL) -> DataFrame:
    """Sampled (x, y, class name) points for a scatter view."""
    s = sample_rows(df.select(key, x, y, label), n, key, seed)
    return s.select(key, F.col(x).alias("x"), F.col(y).alias("y"), class_label(label).alias("class"))
