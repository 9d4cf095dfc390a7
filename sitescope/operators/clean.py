"""Cleaning of the site table: coercion, missing rows, label, soil, features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from .. import constants as K
from ..functions import (
    coerce_double, coerce_typed, decode_soil, elevation_zone, encode_soil_lenient, ndvi, soil_moisture, temperature,
)
from ..sources.validate import require_columns


def coerce_numeric(df: DataFrame, cols) -> DataFrame:
    """Lenient numeric coercion of ``cols``: unparseable -> NULL.

    The coerced values come out of a one-row ``inline`` generator. Catalyst
    cannot push a later filter on them (such as dropping rows with missing
    values) below a generator, so each text value is parsed once; a filter
    pushed through a plain projection would re-run every parse inside the
    predicate (measured 6x slower on the site table).
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    if all(isinstance(df.schema[c].dataType, NumericType) for c in cols):
        return df.withColumns({c: coerce_typed(c, df.schema[c].dataType) for c in cols})
    others = [c for c in df.columns if c not in cols]
    parsed = F.struct(*[coerce_typed(c, df.schema[c].dataType).alias(c) for c in cols])
    return df.select(*others, F.inline(F.array(parsed))).select(*df.columns)


def drop_missing(df: DataFrame, cols) -> DataFrame:
    """Drop rows missing any of ``cols``."""
    return df.na.drop(subset=list(cols))


def dropped_counts(df: DataFrame, cols=None) -> DataFrame:
    """One-row report of rows in and rows a cleaning step would drop (missing core values).

    ``df`` is the coerced table (see ``coerce_numeric``).
    """
    cols = list(cols or [c for c in K.NUMERIC_INPUTS + [K.LABEL_COL] if c in df.columns])
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull()
    return df.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(missing).alias("dropped"))


def label_to_int(df: DataFrame, label: str = K.LABEL_COL) -> DataFrame:
    """Coerce the label leniently, truncate toward zero, reject labels outside {0, 1}.

    The check is a filter that raises, which column pruning cannot remove: every job
    that reads such a row fails, whichever columns it needs, without a pass of its
    own. ``sources.load_sites`` runs it over the whole table when it loads one.
    """
    col = F.col(label)
    y = (col if isinstance(df.schema[label].dataType, NumericType) else coerce_double(col)).cast("int")
    reject = F.raise_error(F.concat(F.lit(f"{label} holds "), y.cast("string"), F.lit("; only 0 and 1 are allowed")))
    return df.where(F.when(y.isNull() | y.isin(0, 1), F.lit(True)).otherwise(reject.cast("boolean"))).withColumn(label, y)


CODE_TEXT = r"^\s*[+-]?\d{1,9}(\.0*)?\s*$"


def encode_soil_column(df: DataFrame, mode: str = "table", soil: str = "auto") -> DataFrame:
    """Lenient soil encoding; text keeps the original in Soil_Type_Label.

    ``soil``: what a text column holds, "names" or "codes", where the caller knows it (a table
    with a declared schema, a checked load). A CSV scan reads codes as text too; "auto"
    takes values as codes when every non-missing one, over all rows, is a whole number. That test is one scalar
    subquery over the table; ``mode="row"`` (streams) decides cell by cell.
    """
    dtype = df.schema["Soil_Type"].dataType
    if isinstance(dtype, StringType):
        if soil != "auto" and mode != "row":
            code = F.trim("Soil_Type").try_cast("double").cast("int")
            given = soil == "codes"
            return df.withColumns({"Soil_Type_Label": decode_soil(code) if given else F.col("Soil_Type"),
                                   "Soil_Type": code if given else encode_soil_lenient("Soil_Type")})
        is_code = F.coalesce(F.col("Soil_Type").rlike(CODE_TEXT), F.lit(False))
        code = F.trim("Soil_Type").try_cast("double").cast("int")
        if mode != "row":
            all_codes = df.select(F.min(F.when(F.col("Soil_Type").isNotNull(), is_code)).alias("all_codes")).scalar()
            is_code = F.coalesce(all_codes, F.lit(False))
        label = F.when(is_code, decode_soil(code)).otherwise(F.col("Soil_Type"))
        return df.withColumns({"Soil_Type_Label": label,
                               "Soil_Type": F.when(is_code, code).otherwise(encode_soil_lenient("Soil_Type"))})
    if isinstance(dtype, NumericType):
        code = F.col("Soil_Type").cast("int")
        return df.withColumns({"Soil_Type": code, "Soil_Type_Label": decode_soil(code)})
    return df.withColumns({"Soil_Type_Label": F.col("Soil_Type").cast("string"),
                           "Soil_Type": encode_soil_lenient(F.col("Soil_Type").cast("string"))})


def _derivations() -> dict:
    return {
        "Temperature": temperature("Elevation"),
        "NDVI": ndvi("Rainfall"),
        "Soil_Moisture": soil_moisture("Rainfall", "Slope"),
        "Elevation_Zone": elevation_zone("Elevation"),
    }


def derive_features(df: DataFrame, mode: str = "table", gaps: dict[str, bool] | None = None) -> DataFrame:
    """Add Temperature, NDVI, Soil_Moisture, Elevation_Zone.

    ``mode="table"`` (batch semantics): a column is derived when absent, and a
    provided column is replaced *entirely* when any of its rows is missing; the
    "any missing" test is one scalar subquery over the table, so the plan stays
    lazy; ``gaps`` ({column: any row missing}) replaces it where a load has measured it.
    ``mode="row"`` (streams): each missing cell is filled on its own.
    """
    derived = _derivations()
    present = [c for c in derived if c in df.columns]
    out = {}
    if mode == "row":
        for c, expr in derived.items():
            if c in present:
                out[c] = F.coalesce(coerce_typed(c, df.schema[c].dataType), expr.cast("double"))
            else:
                out[c] = expr
    else:
        present = [c for c in present if gaps is None or c not in gaps]
        if present:
            flags = df.select(F.struct(*[F.max(coerce_typed(c, df.schema[c].dataType).isNull().cast("int")).alias(c)
                                        for c in present])).scalar()
            df = df.withColumn("_any_null", flags)  # one subquery, referenced by column
        for c, expr in derived.items():
            if gaps is not None and c in gaps and c in df.columns:
                out[c] = expr if gaps[c] else coerce_typed(c, df.schema[c].dataType)
            elif c in present:
                given = coerce_typed(c, df.schema[c].dataType)
                out[c] = F.when(F.coalesce(F.col(f"_any_null.{c}"), F.lit(0)) == 1, expr.cast("double")).otherwise(given)
            else:
                out[c] = expr
    out["Elevation_Zone"] = out["Elevation_Zone"].cast("int")
    for c in ("Temperature", "NDVI", "Soil_Moisture"):
        out[c] = out[c].cast("double")
    out_df = df.withColumns(out)
    return out_df.drop("_any_null") if present and mode != "row" else out_df


def clean_sites(df: DataFrame, mode: str = "table", soil: str = "auto") -> DataFrame:
    """Training table: soil -> coerce -> drop missing core values -> binary label -> features."""
    require_columns(df, K.REQUIRED_SITE_COLS, "training table")
    # soil first: its test of the whole column then reads that column alone
    df = encode_soil_column(df, mode, soil)
    # the label comes out of the generator too, so that its check is not pushed below and worked out again there
    df = coerce_numeric(df, K.NUMERIC_INPUTS + [K.LABEL_COL])
    df = drop_missing(df, K.NUMERIC_INPUTS + [K.LABEL_COL])
    df = label_to_int(df)
    return derive_features(df, mode=mode)


def clean_batch(df: DataFrame, mode: str = "table", soil: str = "auto") -> DataFrame:
    """Batch input: lenient soil -> coerce -> drop missing numerics -> features."""
    require_columns(df, K.REQUIRED_BATCH_COLS, "batch input")
    df = encode_soil_column(df, mode, soil)
    df = coerce_numeric(df, K.NUMERIC_INPUTS)
    df = drop_missing(df, K.NUMERIC_INPUTS)
    return derive_features(df, mode=mode)
