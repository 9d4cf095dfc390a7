"""Checked loads: one job reads a scan, writes kept rows and rejects, and measures both.

The scan is read once. Each row gets the first reason that rejects it (corrupt
record, missing core value, label outside {0, 1}) or none; one write lays both
kinds out in a table partitioned by outcome, so that the cleaned rows and the
reject table are each a pruned read of it. What the load reports (rows in, rows
dropped per reason and column, class counts) and what later steps need to know of
the whole table (are soil values codes, is a given feature missing anywhere) is
observed by that same job. Nothing is collected but these numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import constants as K
from ..functions import coerce_typed
from ..operators import clean as C
from ..operators.districts import clean_districts
from ..session import shared_path
from .readers import file_format, read_table
from .validate import require_columns

CORRUPT, MISSING, BAD_LABEL = "corrupt record", "missing core value", "label outside 0 and 1"
OPTIONAL_FEATURES = ["Temperature", "NDVI", "Soil_Moisture", "Elevation_Zone"]


@dataclass
class Load:
    """A finished load: ``rows`` cleaned, ``rejects`` with reason, detail and record, ``counts`` of the job that wrote them."""

    rows: DataFrame
    rejects: DataFrame
    counts: dict = field(default_factory=dict)
    path: str = ""

    def warnings(self) -> list[str]:
        """What a caller should hear: dropped rows and classes too rare to train on."""
        out = []
        if self.counts["dropped"]:
            out.append(f"{self.counts['dropped']} of {self.counts['rows_in']} rows were rejected")
        for label in (0, 1):
            n = self.counts.get(f"class_{label}", 0)
            if 0 < n < K.RARE_CLASS_ROWS:
                out.append(f"class {label} has {n} rows only; a model of it may be unreliable")
        return out

    def report(self) -> DataFrame:
        """(metric, column, n, warning) in long form: a handful of numbers."""
        rows = [("rows_in", None), ("kept", None), ("dropped", None), *[("rejected", r) for r in (CORRUPT, MISSING, BAD_LABEL)]]
        keys = ["rows_in", "kept", "dropped", "n_corrupt", "n_missing", "n_label"]
        cells = [(m, c, int(self.counts.get(k) or 0), k == "dropped" and bool(self.counts.get(k)))
                 for (m, c), k in zip(rows, keys, strict=True)]
        cells += [("missing", k.removeprefix("missing_"), int(v or 0), False)
                  for k, v in self.counts.items() if k.startswith("missing_")]
        cells += [("class", str(y), int(self.counts[f"class_{y}"]), 0 < self.counts[f"class_{y}"] < K.RARE_CLASS_ROWS)
                  for y in (0, 1) if f"class_{y}" in self.counts]
        return self.rows.sparkSession.createDataFrame(cells, "metric string, column string, n long, warning boolean")


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scan_records(spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None,
                 **options) -> tuple[DataFrame, str | None]:
    """A scan that keeps malformed records, and the name of the column that holds their text.

    CSV columns are text, named by ``schema`` or by the header. A record with too many or too few fields is malformed.
    """
    fmt = file_format(path, fmt)
    if fmt not in ("csv", "json"):
        return read_table(spark, path, fmt, schema, **options), None
    plain = read_table(spark, path, fmt, schema, **options)  # names only: at most a header is read
    corrupt = fresh_name(plain, "corrupt_record")
    fields = StructType([*plain.schema.fields, StructField(corrupt, StringType())])
    return read_table(spark, path, fmt, fields, mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt, **options), corrupt


def _staged(df: DataFrame, corrupt: str | None, coerce: list[str], core: list[str], label: str | None):
    """``df`` with ``coerce`` parsed once, and per row its part, reason, detail and record; their names."""
    given = [c for c in df.columns if c != corrupt]
    coerce = [c for c in coerce if c in given]
    name = {k: fresh_name(df, k) for k in ("part", "reason", "detail", "record", "parsed", "label_value")}
    broken = F.col(corrupt).isNotNull() if corrupt else F.lit(False)
    parsed = F.struct(*[coerce_typed(c, df.schema[c].dataType).alias(c) for c in coerce],
                      *([coerce_typed(label, df.schema[label].dataType).try_cast("long").alias(name["label_value"])] if label else []))
    # one generator row: later expressions refer to the parsed values and do not repeat the parse
    out = df.withColumn(name["parsed"], F.explode(F.array(parsed)))
    value = {c: F.col(f"{name['parsed']}.`{c}`") for c in coerce}
    y = F.col(f"{name['parsed']}.{name['label_value']}") if label else None
    gaps = [F.when(value[c].isNull(), F.lit(c)) for c in core if c in value]
    if label:
        gaps.append(F.when(y.isNull(), F.lit(label)))
    lacks = F.array_compact(F.array(*gaps)) if gaps else F.array().cast("array<string>")
    strange = ~y.isin(0, 1) if label else F.lit(False)
    reason = (F.when(broken, CORRUPT).when(F.size(lacks) > 0, MISSING).when(strange, BAD_LABEL))
    detail = (F.when(broken, F.lit(None).cast("string")).when(F.size(lacks) > 0, F.concat_ws(",", lacks))
              .when(strange, F.col(f"`{label}`").cast("string") if label else F.lit(None)))
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in given]))
    if corrupt:
        record = F.coalesce(F.col(corrupt), record)
    out = out.withColumn(name["reason"], reason)
    kept = F.col(name["reason"]).isNull()
    columns = [value[c].alias(c) if c in value else F.when(y.isin(0, 1), y.cast("int")).alias(c) if c == label else F.col(f"`{c}`") for c in given]
    out = out.select(*columns, name["reason"], detail.alias(name["detail"]), F.when(~kept, record).alias(name["record"]),
                     F.when(kept, "kept").otherwise("rejected").alias(name["part"]))
    return out, name, coerce


def _measures(df: DataFrame, name: dict, core: list[str], label: str | None, soil: bool, optional: list[str]) -> list[Column]:
    reason, kept = F.col(name["reason"]), F.col(name["reason"]).isNull()
    sound = F.coalesce(reason != CORRUPT, F.lit(True))

    def n(cond: Column, key: str) -> Column:
        return F.count_if(cond).alias(key)

    out = [F.count(F.lit(1)).alias("rows_in"), n(kept, "kept"), n(~kept, "dropped"), n(reason == CORRUPT, "n_corrupt"),
           n(reason == MISSING, "n_missing"), n(reason == BAD_LABEL, "n_label")]
    out += [n(sound & F.col(c).isNull(), f"missing_{c}") for c in core]
    if label:
        # a rejected label is given, though the column holds none
        lacks = F.array_contains(F.split(F.col(name["detail"]), ","), label) & (reason == MISSING)
        out.append(n(lacks, f"missing_{label}"))
        out += [n(kept & (F.col(label) == y), f"class_{y}") for y in (0, 1)]
    if soil:
        out += [n(sound & F.col("Soil_Type").isNotNull(), "soil_given"),
                n(sound & F.coalesce(F.col("Soil_Type").rlike(C.CODE_TEXT), F.lit(False)), "soil_codes")]
    return out + [n(kept & F.col(c).isNull(), f"gaps_{c}") for c in optional]


def stage_load(df: DataFrame, corrupt: str | None = None, core: list[str] | None = None, label: str | None = K.LABEL_COL,
               optional: list[str] | None = None):
    """(frame to be written, its extra names, observation): the plan of a checked load, not run yet."""
    core = [c for c in (K.NUMERIC_INPUTS if core is None else core) if c in df.columns]
    optional = [c for c in (OPTIONAL_FEATURES if optional is None else optional) if c in df.columns]
    out, name, coerced = _staged(df, corrupt, core + optional, core, label)
    soil = "Soil_Type" in df.columns and isinstance(df.schema["Soil_Type"].dataType, StringType)
    seen = Observation()
    return out.observe(seen, *_measures(out, name, core, label, soil, optional)), name, seen


def _write(spark: SparkSession, staged: DataFrame, name: dict, seen: Observation, out: str | None):
    out = out or shared_path(spark, "load")
    staged.write.mode("overwrite").partitionBy(name["part"]).parquet(out)
    written = spark.read.schema(staged.schema).parquet(out)
    extra = [name[k] for k in ("reason", "detail", "record")]
    kept = written.where(F.col(name["part"]) == "kept").drop(*extra, name["part"])
    rejects = written.where(F.col(name["part"]) == "rejected").drop(name["part"])
    return kept, rejects, dict(seen.get), out


def _soil_kind(df: DataFrame, counts: dict) -> str:
    if not isinstance(df.schema["Soil_Type"].dataType, StringType):
        return "auto"  # by its type
    return "codes" if counts["soil_given"] and counts["soil_codes"] == counts["soil_given"] else "names"


def ingest_sites(spark: SparkSession, path: str, out: str | None = None, fmt: str | None = None, schema=None,
                 bad_label: str = "quarantine", **options) -> Load:
    """Training scan in one pass: cleaned, soil-encoded, feature-derived rows; rejects; counts.

    ``out``: where the written table goes (default: the shared folder).
    ``bad_label="reject"``: a label outside {0, 1} rejects the whole table, as the plain load does;
    the rejects stay written for a look at them.
    """
    df, corrupt = scan_records(spark, path, fmt, schema, **options)
    return ingest_site_table(df, out, corrupt, bad_label)


def ingest_site_table(df: DataFrame, out: str | None = None, corrupt: str | None = None, bad_label: str = "quarantine") -> Load:
    """``ingest_sites`` of a frame that is read already; ``corrupt`` names its column of malformed records."""
    if bad_label not in ("quarantine", "reject"):
        raise ValueError("bad_label must be 'quarantine' or 'reject'")
    require_columns(df, K.REQUIRED_SITE_COLS, "training table")
    staged, name, seen = stage_load(df, corrupt)
    kept, rejects, counts, out = _write(df.sparkSession, staged, name, seen, out)
    if not counts["rows_in"]:
        raise ValueError("training table: no rows")
    if bad_label == "reject" and counts["n_label"]:
        raise ValueError(f"{counts['n_label']} rows of {K.LABEL_COL} hold labels other than 0 and 1; see the rejects under {out}")
    rows = C.encode_soil_column(kept, soil=_soil_kind(kept, counts))
    rows = C.derive_features(rows, gaps={c: counts[f"gaps_{c}"] > 0 for c in OPTIONAL_FEATURES if f"gaps_{c}" in counts})
    return Load(rows, rejects, counts, out)


def ingest_batch(spark: SparkSession, path: str, out: str | None = None, fmt: str | None = None, schema=None, **options) -> Load:
    """Batch scan in one pass: rows ready to be scored, rejects, counts."""
    df, corrupt = scan_records(spark, path, fmt, schema, **options)
    require_columns(df, K.REQUIRED_BATCH_COLS, "batch input")
    staged, name, seen = stage_load(df, corrupt, label=None)
    kept, rejects, counts, out = _write(spark, staged, name, seen, out)
    rows = C.encode_soil_column(kept, soil=_soil_kind(kept, counts))
    rows = C.derive_features(rows, gaps={c: counts[f"gaps_{c}"] > 0 for c in OPTIONAL_FEATURES if f"gaps_{c}" in counts})
    return Load(rows, rejects, counts, out)


def ingest_districts(spark: SparkSession, path: str, out: str | None = None, fmt: str | None = None, schema=None,
                     **options) -> Load:
    """District scan in one pass: only malformed records are rejected; missing numbers are filled and counted."""
    df, corrupt = scan_records(spark, path, fmt, schema, **options)
    require_columns(df, K.REQUIRED_DISTRICT_COLS, "district table")
    staged, name, coerced = _staged(df, corrupt, ["elevation", "annual_rainfall", "avg_temp", "latitude", "longitude"], [], None)
    seen = Observation()
    staged = staged.observe(seen, *_measures(staged, name, ["elevation", "annual_rainfall"], None, False, []))
    kept, rejects, counts, out = _write(spark, staged, name, seen, out)
    if not counts["rows_in"]:
        raise ValueError("district table: no rows")
    return Load(clean_districts(kept), rejects, counts, out)

