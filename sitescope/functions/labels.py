"""Labels, confidence tiers and warning bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .numeric import _col


def class_label(pred) -> Column:
    p = _col(pred)
    return F.when(p == 1, F.lit(K.CLASS_NAMES[1])).when(p == 0, F.lit(K.CLASS_NAMES[0]))


def _tier(conf, idx: int) -> Column:
    c = _col(conf)
    out = None
    for bound, label, color in K.CONFIDENCE_TIERS:
        val = F.lit((label, color)[idx])
        out = F.when(c >= F.lit(bound), val) if out is None else out.when(c >= F.lit(bound), val)
    return out.otherwise(F.lit(K.LOW_TIER[idx]))


def confidence_tier(conf) -> Column:
    """High (>=0.85) / Moderate (>=0.65) / Low label."""
    return _tier(conf, 0)


def confidence_color(conf) -> Column:
    return _tier(conf, 1)


def gap_band(gap) -> Column:
    """Overfit-gap band: <=0.03 green, <=0.06 amber, else red."""
    g = _col(gap)
    return (F.when(g <= F.lit(K.GAP_GREEN), F.lit("green"))
            .when(g <= F.lit(K.GAP_AMBER), F.lit("amber")).otherwise(F.lit("red")))
