"""District roll-up over arriving observations: exact partial states, merged on read.

Each load of observations adds one state: per district, the exact sums and counts
of the columns it has. A load is written under its id, and the same id again
replaces it, so a repeated load (a retried batch, a stream's epoch) changes
nothing. Sums are decimals, hence any split into loads gives the bits of the
roll-up of all observations at once. A state has a row per district of the load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce_typed
from ..functions.aggregates import exact_parts, merge_parts, parts_mean
from ..sources.validate import require_columns
from .districts import OPTIONAL, finish_rollup


def district_state(obs: DataFrame) -> DataFrame:
    """(state, district, one struct of sums and count per present column): one shuffle on the key."""
    require_columns(obs, ["state", "district"], "observation table")
    present = [c for c in OPTIONAL if c in obs.columns]
    keyed = obs.where(F.col("state").isNotNull() & F.col("district").isNotNull())
    if not present:
        return keyed.select("state", "district").distinct()
    return keyed.groupBy("state", "district").agg(
        *[exact_parts(coerce_typed(c, obs.schema[c].dataType)).alias(c) for c in present])


def add_load(obs: DataFrame, path: str, load_id: str | int) -> None:
    """Add a load's state, or replace the one with its id."""
    district_state(obs).write.mode("overwrite").parquet(f"{path}/load_id={load_id}")


def merged_state(spark: SparkSession, path: str) -> DataFrame:
    """The state of all loads; a column that only some loads have counts their rows."""
    states = spark.read.option("mergeSchema", "true").parquet(path)
    present = [c for c in OPTIONAL if c in states.columns]
    if not present:
        return states.select("state", "district").distinct()
    return states.groupBy("state", "district").agg(*[merge_parts(c).alias(c) for c in present])


def rollup_from_state(spark: SparkSession, path: str, sort: bool = True) -> DataFrame:
    """The district roll-up of every load under ``path``; the observations are not read again."""
    state = merged_state(spark, path)
    present = [c for c in OPTIONAL if c in state.columns]
    means = state.select("state", "district", *[parts_mean(c).alias(c) for c in present])
    return finish_rollup(means, present, sort)
