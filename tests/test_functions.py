"""Scalar functions and cleaning on hand-made rows; expectations computed by hand."""

import math

import pytest
from pyspark.sql import functions as F

from sitescope.functions import (
    class_label, coerce_double, confidence_tier, decode_soil, elevation_zone, encode_soil_lenient,
    encode_soil_strict, ndvi, np_round, rule_label, rule_score, soil_moisture, temperature, title_case, zone_name,
)
from sitescope.operators import clean as C

POINTS = [  # elev, slope, rain, soil, temp, ndvi, moisture, zone, score, label, passed
    (600.0, 8.0, 800.0, "Loamy", 26.4, 0.52, 0.32, 1, 2.31333, 0, 6),
    (3000.0, 45.0, 200.0, "Sandy", 12.0, 0.28, -0.35, 3, 0.13333, 0, 0),
    (0.0, 0.0, 2000.0, "Loamy", 30.0, 1.0, 1.0, 0, 4.0, 1, 6),
    (450.0, 5.0, 900.0, "Loamy", 27.3, 0.56, 0.40, 0, 2.675, 1, 6),
    (1200.0, 12.0, 650.0, "Clay", 22.8, 0.46, 0.205, 1, 1.60333, 0, 6),
    (2800.0, 35.0, 350.0, "Sandy", 13.2, 0.34, -0.175, 3, 0.23333, 0, 0),
    (300.0, 3.0, 1400.0, "Silty", 28.2, 0.76, 0.67, 0, 3.66333, 1, 6),
]


def test_feature_formulas_and_rule(spark):
    df = spark.createDataFrame([p[:4] for p in POINTS], "Elevation double, Slope double, Rainfall double, Soil_Type string")
    df = C.derive_features(C.encode_soil_column(df))
    df = df.withColumn("score", rule_score("Elevation", "Slope", "Rainfall", "NDVI"))
    df = df.withColumn("label", rule_label("score"))
    from sitescope.functions import condition_array
    df = df.withColumn("passed", F.size(F.filter(condition_array(), lambda c: c["passed"])))
    rows = df.collect()
    for r, p in zip(rows, POINTS):
        assert r.Temperature == pytest.approx(p[4])
        assert r.NDVI == pytest.approx(p[5])
        assert r.Soil_Moisture == pytest.approx(p[6])
        assert r.Elevation_Zone == p[7]
        assert r.score == pytest.approx(p[8], abs=1e-5)
        assert r.label == p[9]
        assert r.passed == p[10]


def test_zone_edges(spark):
    vals = [(-5.0,), (500.0,), (500.1,), (1500.0,), (2500.0,), (2500.1,), (None,)]
    rows = spark.createDataFrame(vals, "e double").select(elevation_zone("e").alias("z"), zone_name(elevation_zone("e")).alias("n")).collect()
    assert [r.z for r in rows] == [0, 0, 1, 1, 2, 3, 3]
    assert rows[0].n == "Lowland" and rows[-1].n == "Alpine"


def test_numeric_coercion(spark):
    vals = [" 12 ", "1e3", "inf", "12d", "abc", "", "true", None, "-4.5", ".5"]
    got = [r.v for r in spark.createDataFrame([(v,) for v in vals], "s string").select(coerce_double("s").alias("v")).collect()]
    assert got[:3] == [12.0, 1000.0, math.inf]
    assert got[3:8] == [None] * 5
    assert got[8:] == [-4.5, 0.5]


def test_soil_codes(spark):
    vals = ["Gravel", None, "loamy", " Loamy ", "Clay", "Silty"]
    rows = spark.createDataFrame([(v,) for v in vals], "s string").select(
        encode_soil_strict("s").alias("strict"), encode_soil_lenient("s").alias("lenient")).collect()
    assert [r.strict for r in rows] == [None, None, None, None, 0, 3]
    assert [r.lenient for r in rows] == [1, 1, 1, 1, 0, 3]
    codes = spark.createDataFrame([(0,), (3,), (7,)], "c int").select(decode_soil("c").alias("n")).collect()
    assert [r.n for r in codes] == ["Clay", "Silty", "Unknown"]


def test_lenient_soil_keeps_label(spark):
    df = C.encode_soil_column(spark.createDataFrame([("Gravel",), ("Sandy",)], "Soil_Type string"))
    assert [(r.Soil_Type, r.Soil_Type_Label) for r in df.collect()] == [(1, "Gravel"), (2, "Sandy")]


def test_title_case(spark):
    vals = ["ri-bhoi", "o'neil", "AN", "  north  goa ", "1st ward", None]
    got = [r.t for r in spark.createDataFrame([(v,) for v in vals], "s string").select(title_case("s").alias("t")).collect()]
    assert got == ["Ri-Bhoi", "O'Neil", "An", "North  Goa", "1St Ward", None]


def test_half_even_rounding(spark):
    r = spark.range(1).select(np_round(F.lit(2.5), 0).alias("a"), np_round(F.lit(3.5), 0).alias("b"),
                              np_round(F.lit(0.285), 2).alias("c")).first()
    assert (r.a, r.b, r.c) == (2.0, 4.0, 0.28)


def test_confidence_tiers(spark):
    rows = spark.createDataFrame([(0.65,), (0.85,), (0.64996,)], "c double").select(
        confidence_tier("c").alias("single"), confidence_tier(np_round("c", 4)).alias("batch")).collect()
    assert rows[0].single == "Moderate Confidence" and rows[1].single == "High Confidence"
    assert rows[2].single.startswith("Low Confidence") and rows[2].batch == "Moderate Confidence"


def test_class_label(spark):
    rows = spark.createDataFrame([(1,), (0,)], "p int").select(class_label("p").alias("l")).collect()
    assert [r.l for r in rows] == ["Suitable", "Not Suitable"]


def test_label_truncation_and_domain(spark):
    base = "Elevation string, Slope string, Rainfall string, Soil_Type string, Suitability string"
    ok = spark.createDataFrame([("1", "1", "300", "Clay", "0.7"), ("1", "1", "300", "Clay", "x")], base)
    rows = C.clean_sites(ok).collect()
    assert [r.Suitability for r in rows] == [0]  # text label is missing -> dropped
    bad = spark.createDataFrame([("1", "1", "300", "Clay", "2")], base)
    with pytest.raises(Exception, match="only 0 and 1"):
        C.clean_sites(bad).collect()


def test_partial_feature_column_recomputed(spark):
    df = spark.createDataFrame([(100.0, 1.0, 500.0, "Clay", 99.0, 0.9), (200.0, 1.0, 500.0, "Clay", None, 0.8)],
                               "Elevation double, Slope double, Rainfall double, Soil_Type string, Temperature double, NDVI double")
    rows = C.derive_features(C.encode_soil_column(df)).collect()
    assert [r.Temperature for r in rows] == pytest.approx([29.4, 28.8])  # whole column recomputed
    assert [r.NDVI for r in rows] == [0.9, 0.8]                          # complete column kept
    rows = C.derive_features(C.encode_soil_column(df), mode="row").collect()
    assert [r.Temperature for r in rows] == pytest.approx([99.0, 28.8])


def test_dropped_rows_counted(spark):
    df = spark.createDataFrame([("1", "2", "3", "Clay", "1"), ("n/a", "2", "3", "Clay", "1"), ("1", None, "3", "Clay", "0")],
                               "Elevation string, Slope string, Rainfall string, Soil_Type string, Suitability string")
    assert C.clean_sites(df).count() == 1
    r = C.dropped_counts(C.coerce_numeric(df, ["Elevation", "Slope", "Rainfall", "Suitability"])).first()
    assert (r.rows_in, r.dropped) == (3, 2)
