"""CSV inputs: numeric soil codes, optional text columns, staleness, non-finite means."""

import math

from pyspark.sql import functions as F

from sitescope.functions.aggregates import exact_mean
from sitescope.functions.text import title_case
from sitescope.operators.clean import clean_sites, derive_features, encode_soil_column
from sitescope.plans.registry import input_modified_at
from sitescope.sources.readers import load_sites

HEAD = "Elevation,Slope,Rainfall,Soil_Type,Suitability"


def test_numeric_soil_codes_from_csv(spark, tmp_path):
    (tmp_path / "sites.csv").write_text(f"{HEAD}\n600,8,800,0,1\n500,5,900,2,0\n400,4,700,3,1\n")
    rows = load_sites(spark, str(tmp_path / "sites.csv")).orderBy("Elevation").collect()
    assert [r["Soil_Type"] for r in rows] == [3, 2, 0]
    assert [r["Soil_Type_Label"] for r in rows] == ["Silty", "Sandy", "Clay"]
    assert input_modified_at(spark, str(tmp_path / "sites.csv")) is not None


def test_mixed_soil_text_stays_names(spark):
    df = spark.createDataFrame([("0",), ("Clay",), (None,)], "Soil_Type string")
    assert [r["Soil_Type"] for r in encode_soil_column(df).collect()] == [1, 0, 1]


def test_optional_text_and_nan_columns(spark):
    df = spark.createDataFrame([(600.0, 8.0, 800.0, "20.5", 0.5), (600.0, 8.0, 800.0, "n/a", float("nan"))],
                               "Elevation double, Slope double, Rainfall double, Temperature string, NDVI double")
    rows = derive_features(df).collect()
    assert {round(r["Temperature"], 6) for r in rows} == {26.4} and {round(r["NDVI"], 6) for r in rows} == {0.52}


def test_mean_with_infinities(spark):
    def mean(*values):
        return spark.createDataFrame([(v,) for v in values], "x double").agg(exact_mean("x").alias("m")).first()["m"]

    assert mean(1.0, math.inf) == math.inf and math.isnan(mean(math.inf, -math.inf))
    assert mean(1e27, 1e27) == 1e27 and mean(0.1, 0.2) == 0.15 and mean(None) is None


def test_title_case_strips_all_white_space(spark):
    assert spark.range(1).select(title_case(F.lit("\tgoa\n"))).first()[0] == "Goa"


def test_clean_sites_still_encodes_names(spark):
    df = spark.createDataFrame([("600", "8", "800", "Loamy", "1")], "Elevation string, Slope string, Rainfall string, "
                                                                   "Soil_Type string, Suitability string")
    assert clean_sites(df).first()["Soil_Type"] == 1
