"""Numeric helpers with pandas/NumPy semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number as pandas.to_numeric accepts it: optional sign, digits with an
# optional fraction, optional exponent, or inf/infinity; surrounding blanks.
# Spark's cast alone also accepts Java suffixes such as "12d" or "1f".
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_double(c) -> Column:
    """Lenient text -> double as pandas.to_numeric: unparseable -> NULL.

    The pattern admits no NaN spelling, so no NaN can come out of text.
    """
    s = _col(c).cast("string")
    return F.when(s.rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))


def nan_to_null(c) -> Column:
    """Typed numbers: NaN -> NULL (Spark keeps NaN and NULL apart)."""
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def coerce_typed(c, dtype) -> Column:
    """Coerce by the declared column type: numbers skip the text parse."""
    from pyspark.sql.types import NumericType
    return nan_to_null(c) if isinstance(dtype, NumericType) else coerce_double(c)


def clip(c, lo: float, hi: float, null_guard: bool = True) -> Column:
    """np.clip: NULL stays NULL (greatest/least alone would skip it).

    ``null_guard=False`` is for inputs already known non-NULL.
    """
    c = _col(c)
    v = F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))
    return F.when(c.isNotNull(), v) if null_guard else v


def np_round(c, digits: int = 0) -> Column:
    """NumPy/pandas ``round``: scale, round half to even, unscale."""
    c = _col(c)
    if digits == 0:
        return F.rint(c)
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)
