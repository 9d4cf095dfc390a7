"""Range buckets: running sums in value order without a task that sees all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SKETCH = 10_000


def width(df: DataFrame) -> int:
    """Range buckets a column is cut into: the session's shuffle partitions, or 64 if these are fewer."""
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_buckets(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Add an int range bucket (ascending) of each double column ``col`` as ``cols[col]``.

    The edges are approximate quantiles, one list of at most ``width`` numbers per
    column; they decide only how the work is dealt out, so results do not depend on them.
    """
    from pyspark.ml.feature import Bucketizer
    n = width(df)
    inf = float("inf")
    probs = [i / n for i in range(1, n)]
    found = df.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), probs, SKETCH).alias(f"e{i}")
                     for i, c in enumerate(cols)]).first()
    splits = [[-inf, *sorted({e for e in found[f"e{i}"] or [] if abs(e) < inf} or {0.0}), inf] for i in range(len(cols))]
    temp = [f"{b}_" for b in cols.values()]
    cut = Bucketizer(inputCols=list(cols), outputCols=temp, splitsArray=splits, handleInvalid="keep").transform(df)
    return cut.withColumns({b: F.col(t).cast("int") for b, t in zip(cols.values(), temp, strict=True)}).drop(*temp)
