"""Land-data views over the driver's tables.

The driver's tables hold no land measurements, so sites, districts and
weather observations are integer arithmetic over orders / lineitem / customer /
supplier / nation. Every view is a narrow projection (plus, for observations,
two joins) so its size and work grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import sf_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, name))


def _soil_name(code) -> F.Column:
    return (F.when(code == 0, "Clay").when(code == 1, "Loamy").when(code == 2, "Sandy")
            .when(code == 3, "Silty").otherwise("Gravel"))


def _sites_numbers(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("site_id"),
        F.when(k % 97 != 0, ((c * 37 + k * 11) % 30001).cast("double") / 10.0).alias("_e"),
        F.when(k % 89 != 0, ((k * 7 + c * 13) % 451).cast("double") / 10.0).alias("_s"),
        (200.0 + (F.round(F.col("o_totalprice") * 100.0).cast("bigint") % 18001).cast("double") / 10.0).alias("_r"),
        _soil_name(k % 5).alias("Soil_Type"),
        (((c * 7919 + k * 10473) % 2001 - 1000).cast("double") / 1000.0 * 0.7).alias("noise"),
        *extra,
    )


def _as_text(n: DataFrame) -> list:
    return [
        F.when(F.col("site_id") % 97 == 0, F.lit("n/a")).otherwise(F.col("_e").cast("string")).alias("Elevation"),
        F.col("_s").cast("string").alias("Slope"),
        F.col("_r").cast("string").alias("Rainfall"),
    ]


def sites_raw(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Sites as an uploaded CSV would arrive: strings, 'n/a', NULLs, unknown soil.

    Columns: site_id, Elevation, Slope, Rainfall, Soil_Type (strings), noise (double).
    One row per order (unique key); ``extra`` columns of the order come along.
    """
    n = _sites_numbers(spark, sf_dir, extra)
    return n.select("site_id", *_as_text(n), "Soil_Type", "noise", *extra)


def sites_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sites plus the Suitability label drawn from the rule (score + noise > 2.5).

    The label is computed from the numbers the text was printed from (the text
    parses back to exactly these doubles), so no text is parsed twice.
    """
    from ..functions import ndvi, rule_label, rule_score
    n = _sites_numbers(spark, sf_dir).withColumn("_n", ndvi("_r"))
    label = rule_label(rule_score("_e", "_s", "_r", "_n"), F.col("noise"))
    return n.select("site_id", *_as_text(n), "Soil_Type", "noise", label.alias("Suitability"))


def sites_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean numeric sites, one per lineitem (site_id is not unique)."""
    li = table(spark, sf_dir, "lineitem")
    ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return li.select(
        (ok * 8 + ln).alias("site_id"),
        (((pk * 37 + ok * 11 + ln * 101) % 30001).cast("double") / 10.0).alias("Elevation"),
        (((ok * 7 + sk * 13 + ln * 29) % 451).cast("double") / 10.0).alias("Slope"),
        (200.0 + (F.round(F.col("l_extendedprice") * 100.0).cast("bigint") % 18001).cast("double") / 10.0).alias("Rainfall"),
        _soil_name(F.col("l_quantity").cast("bigint") % 5).alias("Soil_Type"),
        (((pk * 7919 + ok * 10473 + ln * 31) % 2001 - 1000).cast("double") / 1000.0 * 0.7).alias("noise"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw weather observations: one row per order, keyed by (state, district)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # nation has a fixed 25 rows: a proven size bound for a broadcast
    na = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    j = o.join(cu, o.o_custkey == cu.c_custkey).join(na, F.col("c_nationkey") == F.col("n_nationkey"))
    ck, ok = F.col("c_custkey"), F.col("o_orderkey")
    return j.select(
        F.col("n_name").alias("state"),
        F.concat(F.col("c_mktsegment"), F.lit(" "), (ck % 7).cast("string")).alias("district"),
        ((ck * 53 + F.col("n_nationkey") * 211) % 2700).cast("double").alias("elevation"),
        ((ok % 161).cast("double") / 10.0).alias("rainfall"),
        (5.0 + (ok % 250).cast("double") / 10.0).alias("avg_temp"),
        (8.0 + ((F.col("c_nationkey") * 7919) % 26000).cast("double") / 1000.0).alias("latitude"),
        (69.0 + ((F.col("c_nationkey") * 104729) % 26000).cast("double") / 1000.0).alias("longitude"),
    )


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District summary table: one row per supplier."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    na = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    k = F.col("s_suppkey")
    return s.join(na, F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.alias("district_id"),
        F.col("n_name").alias("state"),
        F.concat(F.lit("District "), k.cast("string")).alias("district"),
        ((k * 53) % 2700).cast("double").alias("elevation"),
        (278 + (k * 977) % 5400).cast("double").alias("annual_rainfall"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity query points: one per customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("target_id"),
        ((k * 53) % 3001).cast("double").alias("elevation"),
        (200 + (k * 101) % 1801).cast("double").alias("rainfall"),
    )
