"""District tables: cleaning, observation roll-up, lookups, auto-fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import annualise_rainfall, clip, coerce_typed, exact_mean, np_round, temperature, title_case
from ..sources.validate import require_columns

OPTIONAL = ["elevation", "rainfall", "annual_rainfall", "avg_temp", "latitude", "longitude"]


def clean_districts(df: DataFrame) -> DataFrame:
    """Coerce, fill elevation/rainfall with 0, estimate absent avg_temp, title-case names.

    A missing state or district stays NULL (not the text 'Nan').
    """
    require_columns(df, K.REQUIRED_DISTRICT_COLS, "district table")
    def num(c):
        return coerce_typed(c, df.schema[c].dataType)
    elev = F.coalesce(num("elevation"), F.lit(0.0))
    out = {
        "elevation": elev,
        "annual_rainfall": F.coalesce(num("annual_rainfall"), F.lit(0.0)),
        "avg_temp": num("avg_temp") if "avg_temp" in df.columns else temperature(elev),
        "latitude": num("latitude") if "latitude" in df.columns else F.lit(None).cast("double"),
        "longitude": num("longitude") if "longitude" in df.columns else F.lit(None).cast("double"),
        "state": title_case("state"),
        "district": title_case("district"),
    }
    return df.withColumns(out)


def rollup_observations(obs: DataFrame, sort: bool = True) -> DataFrame:
    """Observation -> district roll-up.

    Rows with a NULL key are dropped; present numeric columns are averaged
    (partial + final hash aggregate, one shuffle on the key); daily rainfall is
    annualised; absent columns get defaults (elevation 200, temperature from
    the unrounded mean elevation, coordinates NULL); then rounded and sorted.
    """
    require_columns(obs, ["state", "district"], "observation table")
    present = [c for c in OPTIONAL if c in obs.columns]
    keyed = obs.where(F.col("state").isNotNull() & F.col("district").isNotNull())
    aggs = [exact_mean(coerce_typed(c, obs.schema[c].dataType)).alias(c) for c in present]
    if aggs:
        g = keyed.groupBy("state", "district").agg(*aggs)
    else:
        g = keyed.select("state", "district").distinct()
    return finish_rollup(g, present, sort)


def finish_rollup(g: DataFrame, present, sort: bool = True) -> DataFrame:
    """District means (of the ``present`` columns) -> the roll-up's columns, defaults and rounding."""
    if "rainfall" in present:
        g = g.withColumn("annual_rainfall", annualise_rainfall("rainfall")).drop("rainfall")
    elif "annual_rainfall" not in present:
        g = g.withColumn("annual_rainfall", F.lit(0.0))
    if "elevation" not in present:
        g = g.withColumn("elevation", F.lit(K.DEFAULT_ELEVATION))
    if "avg_temp" not in present:
        g = g.withColumn("avg_temp", np_round(temperature("elevation"), 1))
    for c in ("latitude", "longitude"):
        if c not in present:
            g = g.withColumn(c, F.lit(None).cast("double"))
    g = g.select(
        "state", "district",
        np_round("elevation", 0).alias("elevation"),
        np_round("avg_temp", 1).alias("avg_temp"),
        np_round("latitude", 4).alias("latitude"),
        np_round("longitude", 4).alias("longitude"),
        np_round("annual_rainfall", 0).alias("annual_rainfall"),
    )
    return g.orderBy("state", "district") if sort else g


def list_states(districts: DataFrame) -> DataFrame:
    """Distinct sorted states."""
    return districts.select("state").na.drop().distinct().orderBy("state")


def list_districts(districts: DataFrame, state: str | None = None) -> DataFrame:
    """Distinct sorted districts, within one state when given."""
    d = districts if state is None else districts.where(F.col("state") == F.lit(state))
    return d.select("state", "district").na.drop().distinct().orderBy("state", "district")


def lookup_district(districts: DataFrame, state: str, district: str) -> DataFrame:
    """First row of the (state, district) equality filter (pushed to the scan)."""
    m = districts.where((F.col("state") == F.lit(state)) & (F.col("district") == F.lit(district)))
    return m.orderBy("state", "district", *[c for c in ("elevation", "annual_rainfall") if c in districts.columns]).limit(1)


def district_coords(districts: DataFrame) -> DataFrame:
    """Rows with both coordinates, projected to (state, district, lat, lon)."""
    return districts.na.drop(subset=["latitude", "longitude"]).select("state", "district", "latitude", "longitude")


def site_bounds(sites: DataFrame | None):
    """Struct scalar {Elevation, Slope, Rainfall: {lo, hi}} (one subquery), or fixed literals.

    Falls back to the fixed bounds when no site table is given (or it is empty).
    """
    fields = []
    for c in K.NUMERIC_INPUTS:
        lo, hi = K.FALLBACK_BOUNDS[c]
        if sites is None:
            fields.append(F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")).alias(c))
        else:
            fields.append(F.struct(F.coalesce(F.min(F.col(c).cast("double")), F.lit(lo)).alias("lo"),
                                   F.coalesce(F.max(F.col(c).cast("double")), F.lit(hi)).alias("hi")).alias(c))
    if sites is None:
        return F.struct(*fields)
    return sites.select(F.struct(*fields)).scalar()


def autofill_inputs(districts: DataFrame, sites: DataFrame | None) -> DataFrame:
    """Scoring inputs for every district, clipped to the site bounds.

    The bounds are a one-row scalar subquery attached once as a column: no
    join, no broadcast of data.
    """
    d = districts.withColumn("_b", site_bounds(sites))
    e, r = F.col("elevation"), F.col("annual_rainfall")
    return d.select(
        "state", "district",
        F.when(e.isNotNull(), F.least(F.greatest(e, F.col("_b.Elevation.lo")), F.col("_b.Elevation.hi"))).alias("Elevation"),
        F.when(r.isNotNull(), F.least(F.greatest(r, F.col("_b.Rainfall.lo")), F.col("_b.Rainfall.hi"))).alias("Rainfall"),
    )


__all__ = ["clean_districts", "rollup_observations", "list_states", "list_districts",
           "lookup_district", "district_coords", "site_bounds", "autofill_inputs", "clip"]
