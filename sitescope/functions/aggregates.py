"""Aggregate expressions with partition-order-independent results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _col

# Sums run over decimals so the result does not depend on how rows are split
# across partitions (re-runs and cluster sizes give identical bits).
EXACT_DECIMAL = "decimal(38,12)"


# Values of this size and more, and infinities, are summed as doubles.
DECIMAL_LIMIT = 1e25


def exact_sum(c) -> Column:
    """Order-independent sum: 12 decimals, up to 25 digits before the point. Larger and
    infinite values add as doubles (inf and -inf together give NaN)."""
    x = _col(c)
    small = F.abs(x) < F.lit(DECIMAL_LIMIT)
    exact = F.sum(F.when(small, x.cast(EXACT_DECIMAL))).cast("double")
    large = F.sum(F.when(~small, x.cast("double")))
    return F.when(large.isNotNull(), F.coalesce(exact, F.lit(0.0)) + large).otherwise(exact)


def exact_mean(c) -> Column:
    """Mean of non-NULL values; NULL when there are none."""
    return F.try_divide(exact_sum(c), F.count(_col(c)).cast("double"))


def exact_parts(c) -> Column:
    """Mergeable state of an exact mean: sums of the small and of the large values, and the count."""
    x = _col(c)
    small = F.abs(x) < F.lit(DECIMAL_LIMIT)
    return F.struct(F.sum(F.when(small, x.cast(EXACT_DECIMAL))).alias("small"), F.sum(F.when(~small, x.cast("double"))).alias("large"),
                    F.count(x).alias("n"))


def merge_parts(c) -> Column:
    """The state of several ``exact_parts`` together."""
    p = _col(c)
    return F.struct(F.sum(p["small"]).cast(EXACT_DECIMAL).alias("small"), F.sum(p["large"]).alias("large"),
                    F.coalesce(F.sum(p["n"]), F.lit(0)).alias("n"))


def parts_mean(c) -> Column:
    """The mean behind a state, with the bits of ``exact_mean`` over its rows."""
    p = _col(c)
    exact = p["small"].cast("double")
    total = F.when(p["large"].isNotNull(), F.coalesce(exact, F.lit(0.0)) + p["large"]).otherwise(exact)
    return F.try_divide(total, p["n"].cast("double"))
