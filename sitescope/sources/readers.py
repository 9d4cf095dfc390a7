"""Table scans for the four inputs: sites, districts, observations, batches.

Spark reads CSV, JSON and Parquet alike; CSV is read with every column as a
string so the lenient numeric coercion decides what parses (no schema
inference pass over the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .validate import ensure_not_empty, require_columns


def file_format(path: str, fmt: str | None = None) -> str:
    """The format given, or that of the path's ending, or Parquet."""
    return fmt or (path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "parquet")


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema=None, **options) -> DataFrame:
    fmt = file_format(path, fmt)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", False)
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def load_sites(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Training scan: validated, cleaned, soil-encoded, feature-derived sites."""
    from ..operators.clean import clean_sites
    df = ensure_not_empty(require_columns(read_table(spark, path, fmt), K.REQUIRED_SITE_COLS, "training table"), "training table")
    sites = clean_sites(df)
    sites.agg(F.count(K.LABEL_COL)).first()  # a label outside {0, 1} rejects the table here
    return sites


def load_districts(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """District scan: cleaned district table."""
    from ..operators.districts import clean_districts
    df = ensure_not_empty(require_columns(read_table(spark, path, fmt), K.REQUIRED_DISTRICT_COLS, "district table"), "district table")
    return clean_districts(df)


def load_observations(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Raw weather observations: one row per observation, any extra columns."""
    obs = require_columns(read_table(spark, path, fmt), ["state", "district"], "observation table")
    return ensure_not_empty(obs, "observation table")


def load_batch(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Uploaded batch of sites to score."""
    batch = require_columns(read_table(spark, path, fmt), K.REQUIRED_BATCH_COLS, "batch input")
    return ensure_not_empty(batch, "batch input")


def batch_template(spark: SparkSession) -> DataFrame:
    """The four-row example of the batch upload format."""
    rows = [(150, 2, 1100, "Silty"), (730, 9, 820, "Loamy"), (1650, 18, 540, "Clay"), (2400, 27, 310, "Sandy")]
    return spark.createDataFrame(rows, "Elevation int, Slope int, Rainfall int, Soil_Type string")
