"""Derived environmental features (scalar formulas)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .numeric import _col, clip, np_round


def temperature(elevation) -> Column:
    """Lapse-rate temperature: 30 - 0.006 * elevation."""
    return F.lit(K.TEMP_SEA_LEVEL) - F.lit(K.TEMP_LAPSE_PER_M) * _col(elevation)


def ndvi(rainfall) -> Column:
    """Vegetation index proxy: clip(0.2 + rainfall / 2500, 0, 1)."""
    return clip(F.lit(K.NDVI_BASE) + _col(rainfall) / F.lit(K.NDVI_RAIN_SCALE), 0.0, 1.0)


def soil_moisture(rainfall, slope) -> Column:
    """rainfall / 2000 - slope / 100 (may be negative)."""
    return _col(rainfall) / F.lit(K.MOISTURE_RAIN_SCALE) - _col(slope) / F.lit(K.MOISTURE_SLOPE_SCALE)


def elevation_zone(elevation) -> Column:
    """0..3 by inclusive upper edges 500/1500/2500; NULL/NaN fall to 3."""
    e = _col(elevation)
    z = F.when(e <= F.lit(K.ZONE_EDGES[0]), 0)
    for i, edge in enumerate(K.ZONE_EDGES[1:], start=1):
        z = z.when(e <= F.lit(edge), i)
    return z.otherwise(len(K.ZONE_EDGES)).cast("int")


def zone_name(zone) -> Column:
    """Zone code -> name, unknown -> '?'."""
    z = _col(zone)
    out = F.lit("?")
    for code in reversed(range(len(K.ZONE_NAMES))):
        out = F.when(z == code, F.lit(K.ZONE_NAMES[code])).otherwise(out)
    return out


def annualise_rainfall(daily_mean) -> Column:
    """Mean daily rainfall * 365, rounded to whole mm."""
    return np_round(_col(daily_mean) * F.lit(K.DAYS_PER_YEAR), 0)


def rounded_single(elevation, slope, rainfall) -> dict[str, Column]:
    """Derived features as the single-site path shows them (2/4/4 dp, int zone)."""
    return {
        "Temperature": np_round(temperature(elevation), 2),
        "NDVI": np_round(ndvi(rainfall), 4),
        "Soil_Moisture": np_round(soil_moisture(rainfall, slope), 4),
        "Elevation_Zone": elevation_zone(elevation),
    }
