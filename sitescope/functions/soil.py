"""Soil type encoding via literal maps."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .numeric import _col


def _soil_map() -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in K.SOIL_CODES.items()))


def _label_map() -> Column:
    return F.create_map(*chain.from_iterable((F.lit(v), F.lit(k)) for k, v in K.SOIL_CODES.items()))


def encode_soil_strict(soil) -> Column:
    """Exact, case-sensitive name -> code; unknown or NULL -> NULL."""
    return F.try_element_at(_soil_map(), _col(soil)).cast("int")


def soil_error(soil) -> Column:
    """Error text for names the strict encoder rejects, else NULL."""
    s = _col(soil)
    msg = F.concat(F.lit("no soil code for "), F.coalesce(s, F.lit("a missing name")),
                   F.lit(f" (known: {', '.join(K.SOIL_CODES)})"))
    return F.when(encode_soil_strict(s).isNull(), msg)


def encode_soil_lenient(soil) -> Column:
    """Name -> code; unknown or missing -> Loamy (1)."""
    return F.coalesce(encode_soil_strict(soil), F.lit(K.SOIL_FALLBACK_CODE)).cast("int")


def decode_soil(code) -> Column:
    """Code -> name; anything else -> 'Unknown'."""
    return F.coalesce(F.try_element_at(_label_map(), _col(code).cast("int")), F.lit("Unknown"))
