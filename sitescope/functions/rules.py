"""Transparent rule scoring and per-condition checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .numeric import _col, clip, np_round


def rule_score(elevation, slope, rainfall, ndvi_col) -> Column:
    """Sum of four [0,1] parts (max 4): low, flat, wet enough, green enough."""
    e, s, r, n = (_col(x) for x in (elevation, slope, rainfall, ndvi_col))
    elev_part = clip(F.lit(1.0) - e / F.lit(K.RULE_ELEV_SCALE), 0.0, 1.0, null_guard=False)
    slope_part = clip(F.lit(1.0) - s / F.lit(K.RULE_SLOPE_SCALE), 0.0, 1.0, null_guard=False)
    rain_part = clip((r - F.lit(K.RULE_RAIN_OFFSET)) / F.lit(K.RULE_RAIN_SCALE), 0.0, 1.0, null_guard=False)
    ndvi_part = clip((n - F.lit(K.RULE_NDVI_OFFSET)) / F.lit(K.RULE_NDVI_SCALE), 0.0, 1.0, null_guard=False)
    # one NULL guard for the whole sum: any missing input -> NULL score
    known = e.isNotNull() & s.isNotNull() & r.isNotNull() & n.isNotNull()
    return F.when(known, elev_part + slope_part + rain_part + ndvi_part)


def rule_label(score, noise=None) -> Column:
    """1 when score (+ noise) > 2.5 strictly."""
    total = _col(score) if noise is None else _col(score) + _col(noise)
    return (total > F.lit(K.RULE_THRESHOLD)).cast("int")


def condition_array(values: dict | None = None) -> Column:
    """array<struct<name,val,ideal,op,unit,passed>> of the six threshold checks.

    ``values`` maps condition name to the Column holding its value (defaults to
    the feature columns). ``val`` is rounded to 3 dp for display; ``passed``
    tests the unrounded value, inclusive.
    """
    items = []
    for name, col, ideal, op, unit in K.CONDITIONS:
        v = (values or {}).get(name, F.col(col))
        passed = v >= F.lit(ideal) if op == ">=" else v <= F.lit(ideal)
        items.append(F.struct(
            F.lit(name).alias("name"), np_round(v, 3).alias("val"), F.lit(float(ideal)).alias("ideal"),
            F.lit(op).alias("op"), F.lit(unit).alias("unit"), passed.alias("passed")))
    return F.array(*items)
