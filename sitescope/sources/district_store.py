"""The stored district table: partitioned by state, sorted by district.

A lookup by state and district reads one partition (PartitionFilters) and, in it,
the row groups that can hold the district (PushedFilters on sorted files). The
state is stored in the rows too, so that the partition is layout only: an empty
state, which a partition folder cannot tell from a missing one, stays itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT = "state_part"


def store_districts(districts: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write a district table (state, district, ...) in the layout that lookups are planned on."""
    out = districts.withColumn(LAYOUT, F.col("state"))
    # a range of districts per task: a state with very many districts is written by several tasks, each file sorted
    ordered = out.repartitionByRange(LAYOUT, "district").sortWithinPartitions(LAYOUT, "district")
    ordered.write.mode(mode).partitionBy(LAYOUT).parquet(path)
    return path


def stored_districts(spark: SparkSession, path: str) -> DataFrame:
    """The stored table with its layout column; partition values are read as text."""
    kept = spark.read.option("recursiveFileLookup", "true").parquet(path).schema  # file schema, without the layout
    return spark.read.schema(kept.add(LAYOUT, "string")).parquet(path)


def _part(state: str | None):
    return F.col(LAYOUT) == F.lit(state) if state else F.col(LAYOUT).isNull()


def lookup_stored(spark: SparkSession, path: str, state: str, district: str) -> DataFrame:
    """First row of a state and district; empty when there is none."""
    table = stored_districts(spark, path)
    found = table.where(_part(state) & (F.col("state") == F.lit(state)) & (F.col("district") == F.lit(district))).drop(LAYOUT)
    return found.orderBy(*[c for c in ("state", "district", "elevation", "annual_rainfall") if c in found.columns]).limit(1)
