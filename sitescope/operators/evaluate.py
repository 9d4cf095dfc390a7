"""Classification metrics over a scored table (label y, prob. p, class pred).

Counting metrics are one aggregate. Curves group by the distinct score first
(partial aggregation collapses repeated scores), then take cumulative sums in
score order using range buckets: a bounded window over per-bucket totals gives
each bucket its offset, and the per-row running sums are windows partitioned
by bucket, so no single task sees all distinct scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exact_mean, gap_band, np_round
from ..session import materialize
from .ranges import with_buckets


def confusion_counts(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    yy, pp = F.col(y), F.col(pred)
    return df.agg(F.count_if((yy == 1) & (pp == 1)).alias("tp"), F.count_if((yy == 0) & (pp == 1)).alias("fp"),
                  F.count_if((yy == 1) & (pp == 0)).alias("fn"), F.count_if((yy == 0) & (pp == 0)).alias("tn"))


def binary_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """accuracy, precision, recall, f1 for class 1; zero division -> 0."""
    c = confusion_counts(df, y, pred)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, F.when(b != 0, b)), F.lit(0.0))

    return c.select("tp", "fp", "fn", "tn",
                    ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                    ratio(tp, tp + fp).alias("precision"),
                    ratio(tp, tp + fn).alias("recall"),
                    ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """All four cells (actual, predicted, n), zeros kept, from one aggregate."""
    c = confusion_counts(df, y, pred)
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return c.select(F.explode(F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"),
                                                 F.col(n).alias("n")) for a, b, n in cells])).alias("c")).select("c.*")


def _score_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(p).alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"),
                                                   F.count_if(F.col(y) != 1).alias("neg"))


def roc_table(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return _roc(df, y, p)[0].drop("b")


def _roc(df: DataFrame, y: str, p: str):
    """Per distinct score (descending): pos, neg and cumulative tp, fp; plus totals P, N.

    The distinct-score table is checkpointed once (it feeds three branches) and
    cut into as many range buckets as the session has shuffle partitions.
    """
    d = materialize(_score_counts(df, y, p).withColumn("score", F.col("score").cast("double")))
    totals = d.select(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    d = with_buckets(d, {"score": "b"})
    tot = d.groupBy("b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    w_off = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    off = tot.select("b", F.coalesce(F.sum("bp").over(w_off), F.lit(0)).alias("pos_off"),
                     F.coalesce(F.sum("bn").over(w_off), F.lit(0)).alias("neg_off"))
    d = d.join(F.broadcast(off), d["b"].eqNullSafe(off["b"])).drop(off["b"])  # a row per bucket
    w = Window.partitionBy("b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = d.select("b", "score", "pos", "neg", (F.col("pos_off") + F.sum("pos").over(w)).alias("tp"),
                 (F.col("neg_off") + F.sum("neg").over(w)).alias("fp"))
    return t, int(totals["P"] or 0), int(totals["N"] or 0)


def roc_points(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score plus the (inf, 0, 0) start."""
    return _points(df.sparkSession, *_roc(df, y, p))


def roc_points_reduced(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """``roc_points`` without the points on a straight run: an inner point goes if the step
    to it and the step from it count the same positives and negatives. Same area.

    The step from a point is the next lower score's counts: within a range bucket a
    window, and for a bucket's last point the first counts of the next bucket that
    holds a score, a row per bucket.
    """
    t, p_tot, n_tot = _roc(df, y, p)
    step = F.struct("pos", "neg")
    first = t.groupBy("b").agg(F.max_by(step, "score").alias("head"))
    down = Window.orderBy(F.desc("b"))  # a row per bucket
    carry = first.select(F.col("b").alias("carry_b"), F.lead("head").over(down).alias("carry"), F.lag("head").over(down).isNull().alias("top"))
    t = t.join(F.broadcast(carry), t["b"].eqNullSafe(F.col("carry_b")))
    w = Window.partitionBy("b").orderBy(F.desc("score"))
    after = F.coalesce(F.lead(step).over(w), F.col("carry"))
    t = t.withColumns({"after": after, "is_first": F.col("top") & (F.row_number().over(w) == 1)})
    bends = F.col("is_first") | F.col("after").isNull() | (F.col("after") != step)
    return _points(df.sparkSession, t.where(bends), p_tot, n_tot)


def roc_curve_and_auc(df: DataFrame, y: str = "y", p: str = "p"):
    """(points DataFrame, area) from one ROC table (one checkpoint, one quantile job)."""
    t, p_tot, n_tot = _roc(df, y, p)
    return _points(df.sparkSession, t, p_tot, n_tot), _auc(t).first()[0]


def _points(spark, t: DataFrame, p_tot: int, n_tot: int) -> DataFrame:
    P, N = F.lit(float(p_tot)), F.lit(float(n_tot))
    pts = t.select(F.col("score").alias("threshold"), F.try_divide(F.col("fp").cast("double"), N).alias("fpr"),
                   F.try_divide(F.col("tp").cast("double"), P).alias("tpr"))
    start = spark.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                                  F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def roc_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Trapezoid area under the ROC curve, exact in integers:
    sum(neg_i * (2 tp_i - pos_i)) / (2 P N)."""
    return _auc(roc_table(df, y, p))


def _auc(t: DataFrame) -> DataFrame:
    num = F.sum((F.col("neg") * (2 * F.col("tp") - F.col("pos"))).cast("decimal(38,0)"))
    g = t.agg(num.alias("num"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return g.select(F.try_divide(F.col("num").cast("double"),
                                 (2.0 * F.col("P").cast("double") * F.col("N").cast("double"))).alias("roc_auc"))


def calibration_curve(df: DataFrame, y: str = "y", p: str = "p", bins: int = K.CALIBRATION_BINS) -> DataFrame:
    """Uniform bins on p; bin = number of inner edges strictly below p; non-empty bins only."""
    step = 1.0 / bins
    inner = [i * step for i in range(1, bins)]
    b = sum((F.col(p) > F.lit(e)).cast("int") for e in inner)
    return df.withColumn("bin", b).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("n_pos"),
        exact_mean(F.col(p)).alias("mean_pred")).select(
        "bin", "n", (F.col("n_pos") / F.col("n")).alias("frac_pos"), "mean_pred")


def brier_score(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    d = F.col(p) - F.col(y).cast("double")
    return df.agg(exact_mean(d * d).alias("brier"))


def overfit_gap(scored: DataFrame, y: str = "y", pred: str = "pred", is_test: str = "is_test") -> DataFrame:
    """Train accuracy - test accuracy of a scored table with its parts marked, in one
    pass, with the gap's colour band and warning flag. An empty part counts as 0."""
    test, right = F.col(is_test), F.col(y) == F.col(pred)

    def accuracy(part):
        return F.coalesce(F.try_divide(F.count_if(part & right).cast("double"), F.count_if(part)), F.lit(0.0))

    one = scored.agg(accuracy(~test).alias("train_accuracy"), accuracy(test).alias("test_accuracy"))
    gap = F.col("train_accuracy") - F.col("test_accuracy")
    return one.select("train_accuracy", "test_accuracy", np_round(gap, 9).alias("overfit_gap"),
                      gap_band(gap).alias("band"), (gap > F.lit(K.WARN_GAP)).alias("warning"))


def _counts(y: str, pred: str) -> list:
    yy, pp = F.col(y), F.col(pred)
    return [F.count_if((yy == 1) & (pp == 1)).alias("tp"), F.count_if((yy == 0) & (pp == 1)).alias("fp"),
            F.count_if((yy == 1) & (pp == 0)).alias("fn"), F.count(F.lit(1)).alias("n")]


def _f1(tp, fp, fn):
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def fold_scores(df: DataFrame, fold: str = "fold", y: str = "y", pred: str = "pred") -> DataFrame:
    """(fold, n, f1) of a scored table with its folds marked, in one aggregate."""
    g = df.groupBy(fold).agg(*_counts(y, pred))
    return g.select(fold, "n", _f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the folds' F1, and the warning for scores that vary too much."""
    g = folds.agg(exact_mean("f1").alias("cv_mean"), F.sqrt(exact_mean(F.col("f1") * F.col("f1")) - exact_mean("f1") * exact_mean("f1")).alias("cv_std"))
    return g.select(np_round("cv_mean", 6).alias("cv_mean"), np_round("cv_std", 6).alias("cv_std"),
                    (F.col("cv_std") > K.WARN_CV_STD).alias("cv_warning"))


def learning_scores(df: DataFrame, sizes: list[float], fold: str = "fold", u: str = "u", y: str = "y", pred: str = "pred") -> DataFrame:
    """(step, fraction, train_size, train_f1, val_f1, gap, warning) of a scored table.

    ``df`` has a fold and a uniform number ``u`` per row. For each size, the rows of the other folds with ``u`` below it are the
    training part and the fold itself validates; scores are means over the folds. Rows are counted once, per fold and
    smallest size that takes them in; nested samples and left-out folds are sums of these few counts.
    """
    last = len(sizes) - 1
    step = F.lit(last)
    for i in range(last - 1, -1, -1):
        step = F.when(F.col(u) < F.lit(float(sizes[i])), F.lit(i)).otherwise(step)
    cells = df.withColumn("step", step).groupBy(fold, "step").agg(*_counts(y, pred))
    sums = ["tp", "fp", "fn", "n"]
    held = cells.select(fold, *sums, F.explode(F.sequence(F.col("step"), F.lit(last))).alias("step"))
    held = held.groupBy("step", fold).agg(*[F.sum(c).alias(c) for c in sums])
    of_step, of_fold = Window.partitionBy("step"), Window.partitionBy(fold)
    parts = held.select("step", fold, *[(F.sum(c).over(of_step) - F.col(c)).alias(f"t_{c}") for c in sums],
                        *[F.max_by(c, "step").over(of_fold).alias(f"v_{c}") for c in sums])
    scores = parts.select("step", F.col("t_n").alias("n"), _f1(F.col("t_tp"), F.col("t_fp"), F.col("t_fn")).alias("t"),
                          _f1(F.col("v_tp"), F.col("v_fp"), F.col("v_fn")).alias("v"))
    g = scores.groupBy("step").agg(F.floor(F.avg("n")).alias("train_size"), exact_mean("t").alias("t"), exact_mean("v").alias("v"))
    fraction = F.element_at(F.array(*[F.lit(float(x)) for x in sizes]), F.col("step") + 1)
    gap = F.col("t") - F.col("v")
    return g.select("step", np_round(fraction, 6).alias("fraction"), "train_size", np_round("t", 6).alias("train_f1"),
                    np_round("v", 6).alias("val_f1"), np_round(gap, 6).alias("gap"), (gap > K.WARN_GAP).alias("warning"))
