"""Site scoring: class, confidence, tier, per-condition checks.

A *scorer* turns feature rows into the probability of class 1:
``RuleScorer`` (transparent rule score / 4, threshold 2.5 of 4) or
``ForestScorer`` (a fitted MLlib pipeline). Scoring is one narrow pass: no
shuffle, the forest is evaluated once per row for class and probability.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import (
    class_label, condition_array, confidence_color, confidence_tier, encode_soil_strict, np_round,
    rule_score, soil_error,
)
from ..functions.features import rounded_single
from .clean import clean_batch

P1 = "probability_1"


class RuleScorer:
    """p = rule score / 4; class 1 when p > 0.625 (score > 2.5)."""

    threshold = K.RULE_THRESHOLD / K.RULE_MAX

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(P1, rule_score("Elevation", "Slope", "Rainfall", "NDVI") / F.lit(K.RULE_MAX))


class ForestScorer:
    """Wraps a fitted forest (``ForestEnsemble`` or a ``PipelineModel``); argmax, tie -> class 0."""

    threshold = 0.5

    def __init__(self, model):
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        if hasattr(self.model, "forests"):  # sub-forest ensemble: averages probabilities itself
            return self.model.transform(df, out=P1)
        out = self.model.transform(df)
        out = out.withColumn(P1, vector_to_array(F.col("probability"))[1])
        drop = [c for c in ("features", "rawPrediction", "probability", "prediction") if c in out.columns
                and c not in df.columns]
        return out.drop(*drop)


def with_prediction(df: DataFrame, scorer) -> DataFrame:
    """Add probability_1, Prediction (int) and raw confidence (prob. of the predicted class)."""
    s = scorer.transform(df)
    p = F.col(P1)
    pred = (p > F.lit(float(scorer.threshold))).cast("int")
    return s.withColumns({"Prediction": pred}).withColumn(
        "_conf", F.when(F.col("Prediction") == 1, p).otherwise(F.lit(1.0) - p))


def score_batch(df: DataFrame, scorer, mode: str = "table", soil: str = "auto") -> DataFrame:
    """Batch scoring: lenient soil, derived features; confidence 4 dp, tier from the rounded value.

    Input columns are kept.
    """
    clean = clean_batch(df, mode=mode, soil=soil)
    s = with_prediction(clean, scorer)
    conf = np_round("_conf", 4)
    return (s.withColumn("Confidence", conf)
             .withColumns({"Label": class_label("Prediction"), "Conf_Tier": confidence_tier("Confidence")})
             .drop("_conf"))


def score_single(df: DataFrame, scorer) -> DataFrame:
    """Single-site scoring for any number of rows.

    Strict soil (unknown -> ``error`` text and NULL prediction); derived
    features rounded (2/4/4 dp) *before* inference; confidence unrounded and the
    tier taken from it; six condition checks as an array of structs.
    """
    soil = F.col("Soil_Type").cast("string")
    base = df.withColumns({
        "Elevation": F.col("Elevation").cast("double"),
        "Slope": F.col("Slope").cast("double"),
        "Rainfall": F.col("Rainfall").cast("double"),
    })
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in K.NUMERIC_INPUTS]
    num_error = F.when(F.concat_ws(", ", *missing) != "",
                       F.concat(F.lit("no value for "), F.concat_ws(", ", *missing)))
    base = base.withColumns({"error": F.coalesce(soil_error(soil), num_error), "Soil_Type_Label": soil,
                             "Soil_Type": encode_soil_strict(soil)})
    base = base.withColumns(rounded_single("Elevation", "Slope", "Rainfall"))
    s = with_prediction(base, scorer)
    ok = F.col("error").isNull()
    conditions = condition_array({
        "Rainfall": F.col("Rainfall"), "Slope": F.col("Slope"), "Elevation": F.col("Elevation"),
        "NDVI": F.col("NDVI"), "Soil Moisture": F.col("Soil_Moisture"), "Temperature": F.col("Temperature")})
    return s.select(
        *[c for c in df.columns if c not in ("Elevation", "Slope", "Rainfall", "Soil_Type")],
        "Elevation", "Slope", "Rainfall", "Soil_Type", "Soil_Type_Label",
        "Temperature", "NDVI", "Soil_Moisture", "Elevation_Zone",
        F.when(ok, F.col("Prediction")).alias("prediction"),
        F.when(ok, F.col("_conf")).alias("confidence"),
        F.when(ok, class_label("Prediction")).alias("label"),
        F.when(ok, confidence_tier("_conf")).alias("conf_tier"),
        F.when(ok, confidence_color("_conf")).alias("conf_color"),
        F.when(ok, conditions).alias("conditions"),
        "error",
    )


def batch_summary(scored: DataFrame) -> DataFrame:
    """Total, suitable and not-suitable counts with shares (%)."""
    g = scored.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("Prediction") == 1).alias("suitable"))
    return g.select(
        "total", "suitable", (F.col("total") - F.col("suitable")).alias("not_suitable"),
        np_round(F.try_divide(F.col("suitable") * 100.0, F.col("total")), 6).alias("suitable_pct"),
        np_round(F.try_divide((F.col("total") - F.col("suitable")) * 100.0, F.col("total")), 6).alias("not_suitable_pct"))


def display_columns(df: DataFrame) -> DataFrame:
    """The columns that are shown, under their display names, those that ``df`` has."""
    return df.select(*[F.col(f"`{c}`").alias(shown) for c, shown in K.DISPLAY_NAMES.items() if c in df.columns])
