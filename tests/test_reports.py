"""Profiling, evaluation, districts and similarity edge cases."""

import pytest
from pyspark.sql import functions as F

from sitescope.operators import districts as D
from sitescope.operators import evaluate as EV
from sitescope.operators import profile as PR
from sitescope.operators import similar as SIM


def test_duplicates_nulls_equal(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "x int")
    assert PR.duplicate_rows(df).first().n_dupes == 2


def test_quantile_linear(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    q = PR.quantiles(df, ["x"], [0.25, 0.75])["x"]
    assert q[0] == pytest.approx(1.5) and q[1] == pytest.approx(3.0)


def test_iqr_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "x double")
    r = PR.iqr_outliers(df).collect()
    assert len(r) == 1 and r[0].column == "x" and r[0].n_outliers == 1


def test_missing_cells(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "a"), (2.0, "b")], "a double, b string")
    got = {r.column: r.n_missing for r in PR.missing_cells(df).collect()}
    assert got == {"a": 1, "b": 1}


def test_correlation_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 6.1)], "a double, c double, b double")
    got = {(r.x, r.y): r.r for r in PR.correlation(df, ["a", "b", "c"]).collect()}
    assert got[("a", "c")] is None and got[("c", "c")] is None
    assert got[("a", "a")] == 1.0 and got[("a", "b")] == 1.0


def test_histogram_bins(spark):
    df = spark.createDataFrame([(0.0, 1), (5.0, 1), (10.0, 0), (10.0, 0)], "x double, Suitability int")
    got = {(r.Suitability, r.bin): r.n for r in PR.histograms(df, ["x"], bins=10).collect()}
    assert got == {(1, 0): 1, (1, 5): 1, (0, 9): 2}


def test_class_ratio_absent_zero(spark):
    df = spark.createDataFrame([(1,), (1,)], "Suitability int")
    assert PR.class_ratio(df).first().class_ratio == 2.0


def test_calibration_bins(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.0), (1, 1.0), (1, 0.30000000000000004), (0, 0.3)], "y int, p double")
    got = {r.bin: r.n for r in EV.calibration_curve(df).collect()}
    assert got == {0: 2, 9: 1, 2: 2}


def test_metrics_no_predicted_positive(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, pred int")
    r = EV.binary_metrics(df).first()
    assert r.precision == 0.0 and r.recall == 0.0 and r.f1 == 0.0 and r.accuracy == 0.5
    cells = {(c.actual, c.predicted): c.n for c in EV.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_roc_auc_matches_pairs(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.3), (0, 0.1), (1, 0.7)]
    df = spark.createDataFrame(rows, "y int, p double")
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    expect = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert EV.roc_auc(df).first().roc_auc == pytest.approx(expect)
    pts = EV.roc_points(df).orderBy("fpr", "tpr").collect()
    assert (pts[0].fpr, pts[0].tpr) == (0.0, 0.0) and (pts[-1].fpr, pts[-1].tpr) == (1.0, 1.0)


def test_rollup_drops_null_keys_and_estimates_temperature(spark):
    obs = spark.createDataFrame([("S", "A", 1001.0, 1.0), ("S", "A", 1000.0, 3.0), (None, "A", 5.0, 1.0), ("S", None, 5.0, 1.0)],
                                "state string, district string, elevation double, rainfall double")
    r = D.rollup_observations(obs).collect()
    assert len(r) == 1
    assert r[0].elevation == 1000.0            # 1000.5 -> half-even
    assert r[0].avg_temp == 24.0               # 30 - 0.006 * 1000.5 = 23.997 -> 24.0
    assert r[0].annual_rainfall == 730.0


def test_rollup_no_optional_columns(spark):
    obs = spark.createDataFrame([("S", "A"), ("S", "A")], "state string, district string")
    r = D.rollup_observations(obs).first()
    assert (r.elevation, r.annual_rainfall, r.avg_temp, r.latitude) == (200.0, 0.0, 28.8, None)


def test_similarity_edges(spark):
    one = spark.createDataFrame([("S", "A", 100.0, 500.0)], "state string, district string, elevation double, annual_rainfall double")
    r = SIM.similar_districts(one, 600, 800).collect()
    assert len(r) == 1 and r[0].Match_Distance is None
    const = spark.createDataFrame([("S", "A", 100.0, 500.0), ("S", "B", 100.0, 700.0), ("T", "C", 100.0, 900.0)],
                                  "state string, district string, elevation double, annual_rainfall double")
    r = SIM.similar_districts(const, 100.0, 800.0, n=10).collect()
    assert len(r) == 3                         # fewer rows than N -> all
    assert [x.district for x in r][0] in ("B", "C")
    assert r[0].Match_Distance == pytest.approx(0.25)  # constant elevation: range 1


def test_autofill_fallback_bounds(spark):
    d = spark.createDataFrame([("S", "A", 5000.0, 100.0)], "state string, district string, elevation double, annual_rainfall double")
    r = D.autofill_inputs(d, None).first()
    assert (r.Elevation, r.Rainfall) == (3000.0, 200.0)


def test_roc_all_scores_tied(spark):
    df = spark.createDataFrame([(i % 2, 0.5) for i in range(1000)], "y int, p double")
    assert EV.roc_auc(df).first().roc_auc == pytest.approx(0.5)
    pts = sorted((r.fpr, r.tpr) for r in EV.roc_points(df).collect())
    assert pts == [(0.0, 0.0), (1.0, 1.0)]


def test_roc_skewed_scores(spark):
    # a third of the rows share one score; the rest are distinct
    rows = [(1 if i % 3 else 0, 0.9) for i in range(300)] + [((i * 7) % 2, i / 1000.0) for i in range(600)]
    df = spark.createDataFrame(rows, "y int, p double")
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    pairs = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert EV.roc_auc(df).first().roc_auc == pytest.approx(pairs / (len(pos) * len(neg)))


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=3000).round(2)
    x[:1000] = 0.5  # a third of all rows hold one value
    y = rnd.exponential(size=3000) ** 4
    df = spark.createDataFrame([(float(a), float(b), None, float("nan")) for a, b in zip(x, y)],
                               "x double, y double, z double, w double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    q = PR.quantiles(df, ["x", "y", "z", "w"], probs)
    assert q["x"] == pytest.approx(list(np.quantile(x, probs))) and q["y"] == pytest.approx(list(np.quantile(y, probs)))
    assert q["z"] == [None] * 7 and q["w"] == [None] * 7
    assert PR.quantiles(df.limit(0), ["x"], probs)["x"] == [None] * 7
