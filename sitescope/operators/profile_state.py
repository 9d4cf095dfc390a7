"""Mergeable profile states: counts per fixed value bucket, kept per load.

A state holds, for every column, the rows it lacks a value in and, for numeric ones,
the count, smallest and largest value of each bucket of a fixed grid (``STEPS``
buckets per power of two, the sign apart, zero alone). The grid does not depend on
the data, so states of separate loads add up to the state of the whole table. A
state has a bounded number of rows per column, whatever the table's size.

Quartiles and fence counts stay exact: the merged state tells which buckets hold a
wanted rank, and between which values each fence must lie; only values of these
buckets are read again. Ranks within them are found by equal parts of the bucket's
range, so that no task orders more than a part. A report reads its table twice,
and a third time only the rows whose digests repeat.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .. import constants as K
from ..session import materialize

STEPS = 64  # buckets per power of two
ZERO_OFFSET = 1_075 * STEPS + 1  # beyond the exponent of the smallest positive double
PARTS = 4_096  # equal parts of a bucket that holds a wanted rank
LARGEST = 1.7976931348623157e308
ROWS, CLASS, DIGEST = -1, -2, -3  # what is counted beside the columns
STATE = "i int, column string, bucket long, n long, low double, high double"


def value_bucket(x: Column) -> Column:
    """The fixed bucket of a double, ascending in it; null for null and NaN."""
    size = F.floor(F.log2(F.least(F.abs(x), F.lit(LARGEST))) * STEPS).cast("long") + ZERO_OFFSET
    return F.when(x.isNull() | F.isnan(x), None).when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size)


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def _cell(i: int, bucket: Column, x: Column) -> Column:
    return F.struct(F.lit(i).alias("i"), bucket.cast("long").alias("bucket"), x.cast("double").alias("x"))


def profile_state(df: DataFrame, label: str | None = K.LABEL_COL) -> DataFrame:
    """The state of one table, in one pass and one small shuffle: (i, column, bucket, n, low, high)."""
    nums, none = set(_numeric(df)), F.lit(None)
    cells = [_cell(ROWS, F.lit(0), none)]
    if label in df.columns:
        cells.append(F.when(F.col(f"`{label}`").isNotNull(), _cell(CLASS, F.col(f"`{label}`").try_cast("long"), none)))
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        if c in nums:
            cells.append(_cell(i, value_bucket(x.cast("double")), x))
        else:
            cells.append(F.when(x.isNull(), _cell(i, none, none)))
    long = df.select(F.inline(F.array_compact(F.array(*cells))))
    names = F.create_map(*[F.lit(v) for i, c in [(ROWS, "rows"), (CLASS, "class"), *enumerate(df.columns)] for v in (i, c)])
    counted = long.groupBy("i", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    return counted.select("i", names[F.col("i")].alias("column"), "bucket", "n", "low", "high")


def merge_states(states: DataFrame) -> DataFrame:
    """The state of all tables behind ``states``; columns meet by name."""
    return states.groupBy("column", "bucket", (F.col("i") < 0).alias("beside")).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def add_profile(df: DataFrame, path: str, load_id: str | int, label: str | None = K.LABEL_COL) -> None:
    """Keep the state of one load under ``path``; the same id again replaces it."""
    profile_state(df, label).write.mode("overwrite").parquet(f"{path}/load_id={load_id}")


def stored_profile(spark: SparkSession, path: str) -> DataFrame:
    """The states of all loads under ``path``."""
    return spark.read.schema(STATE).parquet(path)


@dataclass
class _Column:
    """What the state says of a numeric column: buckets in order, with the values before each."""

    buckets: list[tuple[int, int, float, float]]  # bucket, n, low, high
    missing: int = 0

    @property
    def n(self) -> int:
        return sum(b[1] for b in self.buckets)

    def place(self, rank: int) -> tuple[int, int, float, float, int]:
        """(bucket, n, low, high, values before it) of the value of that rank."""
        before = 0
        for b, n, low, high in self.buckets:
            if rank < before + n:
                return b, n, low, high, before
            before += n
        raise IndexError(rank)


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    at = p * (n - 1)
    return math.floor(at), math.ceil(at), at - math.floor(at)


def _between(low: float, high: float, part: float) -> float:
    return low if low == high else low + (high - low) * part


class Profile:
    """A merged state, held by the driver: a bounded number of rows per column."""

    def __init__(self, state: DataFrame, columns: list[str]) -> None:
        self.columns: dict[str, _Column] = {c: _Column([]) for c in columns}
        self.rows, self.classes = 0, {}
        for r in merge_states(state).collect():
            if r["beside"]:
                if r["column"] == "rows":
                    self.rows = r["n"]
                else:
                    self.classes[r["bucket"]] = r["n"]
            elif r["column"] in self.columns:
                if r["bucket"] is None:
                    self.columns[r["column"]].missing = r["n"]
                else:
                    self.columns[r["column"]].buckets.append((r["bucket"], r["n"], r["low"], r["high"]))
        for c in self.columns.values():
            c.buckets.sort()

    def _fence_ranges(self, c: _Column) -> list[tuple[float, float]]:
        """Ranges that must hold the lower and the upper fence, from the buckets of the quartiles."""
        ends = []
        for p in (0.25, 0.75):
            a, b, _ = _ranks(c.n, p)
            ends.append((c.place(a)[2], c.place(b)[3]))
        (a1, b1), (a3, b3) = ends
        found = [(2.5 * a1 - 1.5 * b3, 2.5 * b1 - 1.5 * a3), (2.5 * a3 - 1.5 * b1, 2.5 * b3 - 1.5 * a1)]
        # infinite quartiles bound nothing
        return [(-math.inf, math.inf) if math.isnan(x + y) and not (x == -math.inf and y == math.inf) else (x, y) for x, y in found]

    def wanted(self, probs: list[float], fences: bool) -> list[tuple[str, int, float, float, int]]:
        """(column, bucket, low, high, before) of the buckets whose values must be read again."""
        out = set()
        for name, c in self.columns.items():
            if not c.n:
                continue
            for p in probs:
                for rank in _ranks(c.n, p)[:2]:
                    b, _, low, high, before = c.place(rank)
                    if low != high:
                        out.add((name, b, low, high, before))
            if fences:
                before, ranges = 0, self._fence_ranges(c)
                for b, n, low, high in c.buckets:
                    if any(high >= x - _slack(x) and low <= y + _slack(y) for x, y in ranges) and low != high:
                        out.add((name, b, low, high, before))
                    before += n
        return sorted(out)


def _slack(x: float) -> float:
    return abs(x) * 1e-12  # the bounds above are rounded


def _near_values(df: DataFrame, wanted: list[tuple], digest: Column | None) -> DataFrame:
    """(i, bucket, v, d, m): values of the wanted buckets and repeated digests of rows, counted in one pass."""
    names = sorted({w[0] for w in wanted})
    cells = []
    for i, c in enumerate(names):
        x, own = F.col(f"`{c}`").cast("double"), [w for w in wanted if w[0] == c]
        b = value_bucket(x)
        cells.append(F.when(b.isin(*[w[1] for w in own]), F.struct(F.lit(i).alias("i"), b.alias("bucket"), x.alias("v"),
                                                                    F.lit(None).cast("long").alias("d"))))
    if digest is not None:
        cells.append(F.struct(F.lit(DIGEST).alias("i"), F.lit(None).cast("long").alias("bucket"),
                              F.lit(None).cast("double").alias("v"), digest.alias("d")))
    long = df.select(F.inline(F.array_compact(F.array(*cells))))
    counted = long.groupBy("i", "bucket", "v", "d").agg(F.count(F.lit(1)).alias("m"))
    return materialize(counted.where((F.col("i") >= 0) | (F.col("m") > 1)))


def _ranked(near: DataFrame, wanted: list[tuple], profile: Profile, probs: list[float]) -> dict[tuple[str, int], float]:
    """{(column, rank): value} of the ranks that lie in wanted buckets."""
    names = sorted({w[0] for w in wanted})
    asked = set()
    for c in names:
        for p in probs:
            for rank in _ranks(profile.columns[c].n, p)[:2]:
                b, _, low, high, before = profile.columns[c].place(rank)
                if low != high:
                    asked.add((names.index(c), b, low, high, rank - before))
    if not asked:
        return {}
    spark = near.sparkSession
    # two rows per column and quantile at most
    asked_df = spark.createDataFrame(sorted(asked), "i int, bucket long, low double, high double, r long")
    ends = F.broadcast(asked_df.select("i", "bucket", "low", "high").distinct())
    # halves, lest the range itself overflow
    part = F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * PARTS).cast("long")
    values = near.where("i >= 0").join(ends, ["i", "bucket"]).select("i", "bucket", "v", "m", part.alias("part"))
    totals = values.groupBy("i", "bucket", "part").agg(F.sum("m").alias("m"))
    upto = Window.partitionBy("i", "bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # PARTS rows per bucket at most
    totals = totals.select("i", "bucket", "part", (F.sum("m").over(upto) - F.col("m")).alias("start"), F.sum("m").over(upto).alias("stop"))
    hit = totals.join(F.broadcast(asked_df.select("i", "bucket", "r")), ["i", "bucket"]).where("r >= start and r < stop")
    hit = materialize(hit.select("i", "bucket", "part", "r", "start"))
    run = Window.partitionBy("i", "bucket", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = values.join(F.broadcast(hit.select("i", "bucket", "part").distinct()), ["i", "bucket", "part"])
    inside = inside.withColumn("stop_v", F.sum("m").over(run))
    found = inside.join(F.broadcast(hit), ["i", "bucket", "part"]).where("r < start + stop_v and r >= start + stop_v - m")
    before = {(names.index(w[0]), w[1]): w[4] for w in wanted}
    return {(names[r["i"]], r["r"] + before[r["i"], r["bucket"]]): r["v"] for r in found.select("i", "bucket", "r", "v").collect()}


def _quantiles(profile: Profile, probs: list[float], ranked: dict) -> dict[str, list[float | None]]:
    out = {}
    for name, c in profile.columns.items():
        if not c.n:
            out[name] = [None] * len(probs)
            continue
        values = []
        for p in probs:
            a, b, part = _ranks(c.n, p)
            low, high = (ranked.get((name, rank), c.place(rank)[2]) for rank in (a, b))
            values.append(_between(low, high, part))
        out[name] = values
    return out


def _outliers(profile: Profile, fences: dict[str, tuple], near: DataFrame, wanted: list[tuple]) -> dict[str, int]:
    """Values strictly outside the fences: whole buckets from the state, the others by value."""
    names, read = sorted({w[0] for w in wanted}), {(w[0], w[1]) for w in wanted}
    out = {}
    for name, c in profile.columns.items():
        _, _, lo, hi = fences[name]
        out[name] = 0 if lo is None else sum(n for b, n, low, high in c.buckets
                                             if (name, b) not in read and (high < lo or low > hi))
    if names:
        outside = F.lit(False)
        for i, name in enumerate(names):
            if any(math.isnan(x) for x in fences[name][2:]):
                continue  # infinite quartiles have no fences
            outside = outside | ((F.col("i") == i) & ((F.col("v") < fences[name][2]) | (F.col("v") > fences[name][3])))
        for r in near.where(outside).groupBy("i").agg(F.sum("m").alias("n")).collect():
            out[names[r["i"]]] += r["n"]
    return out


def state_quantiles(df: DataFrame, cols: list[str], probs: list[float], state: DataFrame | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles (linear interpolation) of ``df``; ``state``: its stored states, if there are any."""
    slim = df.select(*[f"`{c}`" for c in cols])
    profile = Profile(profile_state(slim, None) if state is None else state, cols)
    wanted = profile.wanted(probs, fences=False)
    near = _near_values(slim, wanted, None) if wanted else None
    return _quantiles(profile, probs, _ranked(near, wanted, profile, probs) if wanted else {})


def profile_table(df: DataFrame, label: str | None = K.LABEL_COL, state: DataFrame | None = None,
                  digest: Column | None = None) -> tuple[Profile, dict[str, tuple], dict[str, int], DataFrame | None]:
    """(profile, {column: q1, q3, lower and upper fence}, {column: outliers}, repeated digests) of a table.

    ``state``: its stored states, if there are any; else they are counted by a first pass.
    ``digest``: rows' digests, counted by the pass that reads the wanted buckets again.
    """
    nums, probs = _numeric(df), [0.25, 0.75]
    profile = Profile(profile_state(df, label) if state is None else state, df.columns)
    missing_only = {c: v for c, v in profile.columns.items() if c not in nums}
    profile.columns = {c: profile.columns[c] for c in nums}
    wanted = profile.wanted(probs, fences=True)
    near = _near_values(df, wanted, digest) if wanted or digest is not None else None
    quartiles = _quantiles(profile, probs, _ranked(near, wanted, profile, probs) if wanted else {})
    fences = {}
    for c, (q1, q3) in quartiles.items():
        fences[c] = (q1, q3, None, None) if q1 is None else (q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    outliers = _outliers(profile, fences, near, wanted)
    profile.columns |= missing_only
    again = near.where(F.col("i") == DIGEST).select("d") if digest is not None else None
    return profile, fences, outliers, again
