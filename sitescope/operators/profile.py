"""Data-quality, distribution and correlation reports.

Each report is one or two aggregate passes over the table; per-column work is
folded into a single aggregate (no loop of jobs over columns). Results are
small long-form tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .. import constants as K
from ..functions import np_round
from ..session import materialize
from .profile_state import profile_table, state_quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def class_counts(df: DataFrame, label: str = K.LABEL_COL) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_ratio(df: DataFrame, label: str = K.LABEL_COL) -> DataFrame:
    """round(n1 / max(n0, 1), 3) with an absent class 0 counted as 1."""
    g = df.agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
    n0 = F.when(F.col("n0") == 0, F.lit(1)).otherwise(F.col("n0"))
    return g.select("n0", "n1", np_round(F.col("n1").cast("double") / F.greatest(n0, F.lit(1)).cast("double"), 3)
                    .alias("class_ratio"))


# So many digests are broadcast at most: 8 bytes each, 8 MB together.
MOST_DIGESTS = 1 << 20


def duplicate_rows(df: DataFrame, cols=None, digest=None) -> DataFrame:
    """Extra copies over all (or the given) columns; NULLs compare equal.

    Two phases. Digests of the rows are counted first: the shuffle moves eight bytes
    a row and a count. Whole rows travel only where a digest occurs again, and these
    are compared by value, so that rows which share a digest by chance count as the
    different rows they are. The repeated digests are broadcast to the second scan if
    they are ``MOST_DIGESTS`` or fewer, by a count of them, and joined by a shuffle
    beyond it. Partial aggregation collapses hot duplicates in both phases.
    """
    cols = list(cols or df.columns)
    hashed, d = _digested(df, cols, digest)
    again = materialize(hashed.groupBy(d).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(d))
    return _verified(hashed, d, cols, again)


def _digested(df: DataFrame, cols, digest=None) -> tuple[DataFrame, str]:
    d = "_digest"
    while d in df.columns:
        d += "_"
    return df.withColumn(d, F.xxhash64(*cols) if digest is None else digest), d


def _verified(hashed: DataFrame, d: str, cols, again: DataFrame) -> DataFrame:
    """Extra copies among the rows whose digest is one of ``again`` (a written table), by value."""
    few = again.count() <= MOST_DIGESTS
    suspects = hashed.join(F.broadcast(again) if few else again, d, "left_semi")
    g = suspects.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("n_dupes"))


def missing_cells(df: DataFrame, keep_zero: bool = False) -> DataFrame:
    """(column, n_missing) for columns with missing cells, in one pass."""
    aggs = [F.count_if(F.col(c).isNull() | (F.isnan(c) if isinstance(df.schema[c].dataType, NumericType)
                                           else F.lit(False))).alias(c) for c in df.columns]
    row = df.agg(*aggs)
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("bigint").alias("n_missing")) for c in df.columns]))
        .alias("m")).select("m.*")
    return long if keep_zero else long.where(F.col("n_missing") > 0)


def quantiles(df: DataFrame, cols, probs, accuracy: int | None = None) -> dict[str, list[float | None]]:
    """{column: quantiles}.

    ``accuracy=None``: exact, linear interpolation (pandas' default), see
    ``profile_state``; else ``percentile_approx`` at that accuracy.
    """
    cols = list(cols)
    if accuracy is None:
        return state_quantiles(df, cols, list(probs))
    if not cols:
        return {}
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [float(p) for p in probs], accuracy).alias(f"q{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: row[f"q{i}"] or [None] * len(probs) for i, c in enumerate(cols)}


def _fences(df: DataFrame, cols, accuracy: int | None) -> dict[str, tuple]:
    """{column: (q1, q3, lower fence, upper fence)} as literals; NULL for a column without values."""
    out = {}
    for c, (q1, q3) in quantiles(df, cols, [0.25, 0.75], accuracy).items():
        q1, q3 = F.lit(q1).cast("double"), F.lit(q3).cast("double")
        out[c] = (q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def _outside(c: str, lo, hi):
    x = F.col(c).cast("double")
    return F.count_if(~F.isnan(x) & ((x < lo) | (x > hi)))


def iqr_outliers(df: DataFrame, cols=None, accuracy: int | None = None, keep_zero: bool = False) -> DataFrame:
    """Per numeric column: q1, q3, fences and the count strictly outside them.

    Two passes, see ``profile_state``; with ``accuracy``, approximate quartiles and one
    more pass that counts the outliers of every column in one aggregate.
    """
    cols = list(cols or numeric_columns(df))
    if accuracy is None:
        _, found, outliers, _ = profile_table(df.select(*cols), None)
        rows = [(c, *found[c], outliers[c]) for c in cols if keep_zero or outliers[c]]
        return df.sparkSession.createDataFrame(rows, "column string, q1 double, q3 double, lower double, upper double, n_outliers long")
    fences = _fences(df, cols, accuracy)
    row = df.agg(*[_outside(c, *fences[c][2:]).alias(f"n__{c}") for c in cols])
    cells = []
    for c in cols:
        q1, q3, lo, hi = fences[c]
        cells.append(F.struct(F.lit(c).alias("column"), q1.alias("q1"), q3.alias("q3"), lo.alias("lower"),
                              hi.alias("upper"), F.col(f"n__{c}").alias("n_outliers")))
    long = row.select(F.explode(F.array(*cells)).alias("o")).select("o.*")
    return long if keep_zero else long.where(F.col("n_outliers") > 0)


def numeric_bounds(df: DataFrame | None, cols=K.NUMERIC_INPUTS) -> DataFrame:
    """(column, min, max) with the fixed fallback for absent tables or columns."""
    rows = []
    for c in cols:
        lo, hi = K.FALLBACK_BOUNDS.get(c, (None, None))
        rows.append((c, lo, hi))
    if df is None:
        from pyspark.sql import SparkSession
        return SparkSession.getActiveSession().createDataFrame(rows, "column string, min double, max double")
    row = df.agg(*[F.struct(F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi"))
                   .alias(c) for c in cols])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"{c}.lo"), F.lit(lo)).alias("min"),
                 F.coalesce(F.col(f"{c}.hi"), F.lit(hi)).alias("max")) for c, lo, hi in rows])).alias("b")).select("b.*")


def correlation(df: DataFrame, cols, digits: int | None = 2) -> DataFrame:
    """Pearson matrix in long form (x, y, r), all pairs incl. the diagonal.

    One pass: a row is opened into its pairs of values, which partial aggregation
    collapses to a row per pair at once, so that the aggregate stays small however
    many columns there are. A constant column gives NULL (no division error under ANSI).
    """
    n = len(cols)
    if not n:
        return df.sparkSession.createDataFrame([], "x string, y string, r double")
    pairs = (df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))
             .select("v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
             .select("i", F.get("v", "i").alias("a"), F.posexplode(F.slice("v", 1, F.col("i") + 1)).alias("j", "b")))
    cov = pairs.groupBy("i", "j").agg(F.covar_pop("a", "b").alias("cov"))
    # one row with a number per pair of columns
    row = cov.agg(F.map_from_entries(F.collect_list(F.struct(F.col("i") * n + F.col("j"), "cov"))).alias("m"))

    def found(i, j):
        return F.try_element_at("m", F.lit(max(i, j) * n + min(i, j)))

    def r(i, j):
        spread = F.sqrt(found(i, i)) * F.sqrt(found(j, j))
        v = F.when(spread > 0, F.try_divide(found(i, j), spread))
        return np_round(v, digits) if digits is not None else v

    cells = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r(i, j).alias("r"))
             for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return row.select(F.inline(F.array(*cells)))


def histograms(df: DataFrame, features, label: str = K.LABEL_COL, bins: int = K.HIST_BINS) -> DataFrame:
    """Per-class fixed-width histograms of several features in one job.

    Features are unpivoted first; bounds come from one scalar subquery. Output:
    feature, class, bin, bin_lo, bin_hi, n (only non-empty bins).
    """
    b = df.select(F.struct(*[F.struct(F.min(F.col(c).cast("double")).alias("lo"),
                                      F.max(F.col(c).cast("double")).alias("hi")).alias(c)
                             for c in features])).scalar()
    df = df.withColumn("_b", b)  # one subquery
    long = df.select(F.col(label).alias(label), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                 F.col(f"_b.{c}.lo").alias("lo"), F.col(f"_b.{c}.hi").alias("hi"))
        for c in features])).alias("v")).select(label, "v.*").where(F.col("value").isNotNull())
    width = F.col("hi") - F.col("lo")
    bin_ = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width * bins), F.lit(bins - 1))) \
        .otherwise(F.lit(0)).cast("int")
    g = long.withColumn("bin", bin_).groupBy("feature", label, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    return g.select("feature", label, "bin", (F.col("lo") + F.col("bin") * step).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * step).alias("bin_hi"), "n")


def nice_step(raw):
    """``raw`` rounded to 1, 2 or 5 times a power of ten."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)).cast("double"))
    lead = raw / power
    return F.when(lead < 1.5, 1.0).when(lead < 3.5, 2.0).when(lead < 7.5, 5.0).otherwise(10.0) * power


def auto_histograms(df: DataFrame, features, label: str = K.LABEL_COL) -> DataFrame:
    """Per-class histograms whose bin width follows the data, over all rows.

    A feature's width is 3.49 standard deviations over the cube root of its count
    (the rule that is best for a normal distribution), rounded to a nice step; bins start at
    multiples of it, and the classes share them. Two passes: spread and count of all
    features in one aggregate, then one count of the unpivoted values. A constant
    feature has one bin of width 1. Output: feature, class, bin, bin_lo, bin_hi, n.
    """
    spread = df.select(F.struct(*[F.struct(F.stddev_pop(F.col(c).cast("double")).alias("sd"), F.count(c).alias("n")).alias(c)
                                  for c in features])).scalar()
    df = df.withColumn("_s", spread)  # one subquery

    def step(c):
        raw = 3.49 * F.col(f"_s.{c}.sd") / F.pow(F.col(f"_s.{c}.n").cast("double"), F.lit(1.0 / 3.0))
        return F.when(raw > 0, nice_step(raw)).otherwise(1.0)

    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), step(c).alias("step")) for c in features])
    long = df.select(F.col(label), F.inline(cells)).where("value is not null and not isnan(value)")
    g = long.groupBy("feature", label, "step", F.floor(F.col("value") / F.col("step")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("feature", label, "bin", (F.col("bin") * F.col("step")).alias("bin_lo"),
                    ((F.col("bin") + 1) * F.col("step")).alias("bin_hi"), "n")


def _exact_report(df: DataFrame, label: str, state: DataFrame | None) -> DataFrame:
    hashed, d = _digested(df, df.columns)
    profile, fences, outliers, again = profile_table(df, label, state, F.xxhash64(*df.columns))
    repeated = again.withColumnRenamed("d", d)
    n_dupes = 0 if repeated.isEmpty() else _verified(hashed, d, df.columns, repeated).first()[0]
    missing = {c: v.missing for c, v in profile.columns.items()}
    rows = [("n_rows", None, profile.rows), ("n_cols", None, len(df.columns)), ("n_dupes", None, n_dupes)]
    rows += [("missing", c, n) for c, n in missing.items() if n]
    rows.append(("total_missing", None, sum(missing.values())))
    rows += [("outliers", c, n) for c, n in outliers.items() if n]
    if label in df.columns:
        n0, n1 = (profile.classes.get(y, 0) for y in (0, 1))
        rows += [("class_balance", str(y), n) for y, n in ((0, n0), (1, n1)) if n]
        rows.append(("class_ratio", None, round(n1 / max(n0 or 1, 1) * 1000) / 1000))
    return df.sparkSession.createDataFrame([(m, c, float(v)) for m, c, v in rows], "metric string, column string, value double")


def quality_report(df: DataFrame, label: str = K.LABEL_COL, accuracy: int | None = None,
                   state: DataFrame | None = None) -> DataFrame:
    """Long-form report (metric, column, value): rows, columns, duplicates,
    missing per column and total, IQR outliers per numeric column, class counts
    and class ratio.

    The table is read twice (see ``profile_state``): for the counts per value bucket,
    missing cells and classes, then for the values of the buckets that hold a wanted rank
    or fence and for the digests of its rows. Rows whose digests repeat, if any do, are
    read once more and compared by value. ``state``: stored states of the table's loads, which replace
    the first read. ``accuracy``: approximate quartiles, by the aggregates below instead.
    """
    if accuracy is None:
        return _exact_report(df, label, state)
    nums = numeric_columns(df)
    has_label = label in df.columns

    def is_missing(c):
        nan = F.isnan(c) if isinstance(df.schema[c].dataType, NumericType) else F.lit(False)
        return F.col(c).isNull() | nan

    prof = [F.count(F.lit(1)).alias("n_rows")]
    prof += [F.count_if(is_missing(c)).alias(f"m__{c}") for c in df.columns]
    if has_label:
        prof += [F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")]
    fences = _fences(df, nums, accuracy)
    prof += [_outside(c, *fences[c][2:]).alias(f"o__{c}") for c in nums]
    dupes = duplicate_rows(df).select(F.col("n_dupes").alias("_d"))     # one row
    row = df.agg(*prof).withColumn("_d", dupes.scalar())

    def item(metric, column, value):
        return F.struct(F.lit(metric).alias("metric"), (F.lit(column) if column is not None else
                        F.lit(None).cast("string")).alias("column"), value.cast("double").alias("value"))

    items = [item("n_rows", None, F.col("n_rows")), item("n_cols", None, F.lit(float(len(df.columns)))),
             item("n_dupes", None, F.col("_d"))]
    items += [item("missing", c, F.col(f"m__{c}")) for c in df.columns]
    total_missing = sum((F.col(f"m__{c}") for c in df.columns), F.lit(0))
    items.append(item("total_missing", None, total_missing))
    items += [item("outliers", c, F.col(f"o__{c}")) for c in nums]
    if has_label:
        n0, n1 = F.col("n0"), F.col("n1")
        items += [item("class_balance", "0", n0), item("class_balance", "1", n1)]
        denom = F.greatest(F.when(n0 == 0, F.lit(1)).otherwise(n0), F.lit(1)).cast("double")
        items.append(item("class_ratio", None, np_round(n1.cast("double") / denom, 3)))
    out = row.select(F.explode(F.array(*items)).alias("r")).select("r.*")
    # per-column entries only when positive; class counts only for present classes
    keep = (~F.col("metric").isin("missing", "outliers", "class_balance")) | (F.col("value") > 0)
    return out.where(keep)


def overview(df: DataFrame, flag: str) -> DataFrame:
    """Rows, flagged (==1) count and share, the rest and its share (%)."""
    g = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(flag) == 1).alias("n_suitable"))
    other = F.col("n_rows") - F.col("n_suitable")
    return g.select("n_rows", "n_suitable",
                    np_round(F.try_divide(F.col("n_suitable") * 100.0, F.col("n_rows")), 6).alias("suitable_pct"),
                    other.alias("n_not_suitable"),
                    np_round(F.try_divide(other * 100.0, F.col("n_rows")), 6).alias("not_suitable_pct"))
