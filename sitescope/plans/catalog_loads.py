"""Queries of loads and of state that grows by loads: checked ingestion, incremental roll-up, late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollup_state as RS
from ..operators import score as S
from ..session import shared_path
from ..sources import fixtures as fx
from ..sources import ingest as I
from . import oracle_sql as Q
from .catalog import CLEAN_COLS, ROLLUP_SQL, query

# ------------------------------------------------------------ checked load (S1, P2-P5)
CSV_COLS = ["site_id", "Elevation", "Slope", "Rainfall", "Soil_Type", "Suitability", "Temperature", "NDVI"]


def sites_csv(spark: SparkSession, sf_dir: str) -> str:
    """The sites as an upload of CSV lines: missing cells, other labels, and lines with a field too many."""
    s = fx.sites_labelled(spark, sf_dir)
    k = F.col("site_id")
    label = (F.when(k % 103 == 0, "2").when(k % 107 == 0, "x").when(k % 109 == 0, "0.7")
             .otherwise(F.coalesce(F.col("Suitability").cast("string"), F.lit(""))))
    cells = [k.cast("string"), *[F.coalesce(c, F.lit("")) for c in ("Elevation", "Slope", "Rainfall", "Soil_Type")], label,
             F.when(k % 7 == 0, "").otherwise("25.5"), F.lit("0.5")]
    line = F.concat(F.concat_ws(",", *cells), F.when(k % 101 == 0, ",surplus").otherwise(""))
    path = shared_path(spark, "upload") + ".csv"
    s.select(line.alias("value")).write.text(path)
    return path


def loaded(spark: SparkSession, sf_dir: str) -> I.Load:
    schema = ", ".join(f"{c} string" for c in CSV_COLS)
    return I.ingest_sites(spark, sites_csv(spark, sf_dir), fmt="csv", schema=schema, header=False)


LOAD_CTE = "with " + ",".join([Q.SITES_RAW, Q.SITES_NUM, Q.SITES_LAB]) + """,
typed as (select *, case when site_id % 103 = 0 then '2' when site_id % 107 = 0 then 'x' when site_id % 109 = 0 then '0.7'
   else coalesce(cast(Suitability as varchar), '') end as label from sites_lab),
gaps as (select *, case when label in ('', 'x') then null else cast(trunc(cast(label as double)) as bigint) end as y,
   site_id % 101 = 0 as broken from (select *, case when label in ('', 'x') then '0' else label end as l2 from typed)),
judged as (select *, concat_ws(',', case when Elevation is null then 'Elevation' end, case when Slope is null then 'Slope' end,
   case when Rainfall is null then 'Rainfall' end, case when y is null then 'Suitability' end) as lacks from gaps),
load as (select *, case when broken then 'corrupt record' when lacks <> '' then 'missing core value'
   when y not in (0, 1) then 'label outside 0 and 1' end as reason from judged)"""
# the cast runs on every row, hence on a number for the rows whose label is none
LOAD_CTE = LOAD_CTE.replace("cast(trunc(cast(label as double)) as bigint)", "cast(trunc(cast(l2 as double)) as bigint)")


@query("load_rejects", LOAD_CTE + """
select site_id, reason, case reason when 'missing core value' then lacks when 'label outside 0 and 1' then label end as detail
from load where reason is not null""")
def q_load_rejects(spark, sf_dir):
    """Every line that a checked load refuses, with the reason."""
    return loaded(spark, sf_dir).rejects.select(F.col("site_id").cast("bigint").alias("site_id"), "reason", "detail")


@query("load_kept", LOAD_CTE + f"""
select site_id, Elevation, Slope, Rainfall, {Q.soil_lenient('Soil_Type')} as Soil_Type, Soil_Type as Soil_Type_Label,
 cast(y as integer) as Suitability, case when (select count_if(site_id % 7 = 0) from load where reason is null) > 0
  then {Q.temperature('Elevation')} else 255e-1 end as Temperature, 5e-1 as NDVI, {Q.moisture('Rainfall', 'Slope')} as Soil_Moisture,
 {Q.zone('Elevation')} as Elevation_Zone
from load where reason is null""")
def q_load_kept(spark, sf_dir):
    """The rows that it keeps, cleaned: a column with a gap is derived whole, a full one stays as given."""
    return loaded(spark, sf_dir).rows.select(F.col("site_id").cast("bigint").alias("site_id"), *CLEAN_COLS[1:])


@query("load_report", LOAD_CTE + """
select 'rows_in' as metric, cast(null as varchar) as "column", count(*) as n, false as warning from load
union all select 'kept', null, count_if(reason is null), false from load
union all select 'dropped', null, count_if(reason is not null), count_if(reason is not null) > 0 from load
union all select 'rejected', 'corrupt record', count_if(reason = 'corrupt record'), false from load
union all select 'rejected', 'missing core value', count_if(reason = 'missing core value'), false from load
union all select 'rejected', 'label outside 0 and 1', count_if(reason = 'label outside 0 and 1'), false from load
union all select 'missing', 'Elevation', count_if(not broken and Elevation is null), false from load
union all select 'missing', 'Slope', count_if(not broken and Slope is null), false from load
union all select 'missing', 'Rainfall', count_if(not broken and Rainfall is null), false from load
union all select 'missing', 'Suitability', count_if(not broken and y is null), false from load
union all select 'class', '0', count_if(reason is null and y = 0), count_if(reason is null and y = 0) between 1 and 9 from load
union all select 'class', '1', count_if(reason is null and y = 1), count_if(reason is null and y = 1) between 1 and 9 from load""")
def q_load_report(spark, sf_dir):
    """What the load counted while it wrote: rows in and dropped, by reason and column, and the classes."""
    return loaded(spark, sf_dir).report()


@query("load_rare_class", LOAD_CTE + """,
few as (select case when site_id % 997 = 0 then 1 else 0 end as y from load where reason is null)
select cast(y as varchar) as "column", count(*) as n, count(*) < 10 as warning from few group by y""")
def q_load_rare_class(spark, sf_dir):
    """Class counts, and the warning, of a table whose class 1 is scarce."""
    kept = loaded(spark, sf_dir).rows
    scarce = kept.withColumn("Suitability", (F.col("site_id").cast("bigint") % 997 == 0).cast("int")).drop("Soil_Type_Label")
    again = I.ingest_site_table(scarce.select("site_id", "Elevation", "Slope", "Rainfall", "Soil_Type", "Suitability"))
    return again.report().where("metric = 'class' and n > 0").select("column", "n", "warning")


# ------------------------------------------------------- roll-up of arriving observations (A1)
@query("district_rollup_incremental", ROLLUP_SQL)
def q_district_rollup_incremental(spark, sf_dir):
    """Observations arrive in four loads, one of them twice; the states together give the roll-up."""
    path = shared_path(spark, "district-state")
    obs = fx.observations(spark, sf_dir).withColumn("_load", F.pmod(F.xxhash64("rainfall", "district"), F.lit(4)))
    for i in (0, 1, 2, 3, 1):
        RS.add_load(obs.where(F.col("_load") == i).drop("_load"), path, i)
    return RS.rollup_from_state(spark, path)


# --------------------------------------------------------------- late data (§2.11)
WAVES, LATE_EVERY = 4, 50


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with an event time (the order's date) and the wave they arrive in: two years
    a wave; every fiftieth arrives one wave later than it should."""
    from ..streaming.scoring import ntz_as_utc
    src = fx.sites_raw(spark, sf_dir, ("o_orderdate",)).withColumn("ts", ntz_as_utc("o_orderdate")).drop("o_orderdate")
    due = F.floor((F.year("ts") - 1992) / 2)
    late = F.when(F.col("site_id") % LATE_EVERY == 0, 1).otherwise(0)
    return src.withColumn("wave", F.greatest(F.lit(0), F.least(due + late, F.lit(WAVES - 1))).cast("int"))


def run_waves(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    from ..streaming import run_wave, score_stream
    base = shared_path(spark, "waves")
    src = waves(spark, sf_dir)
    spark.createDataFrame([], src.schema).write.parquet(f"{base}/in")
    stream = score_stream(spark, f"{base}/in", src.schema, S.RuleScorer()).select("site_id", "ts", "Prediction")
    for w in range(WAVES):
        src.where(F.col("wave") == w).repartition(2, "site_id").write.mode("append").parquet(f"{base}/in")
        run_wave(stream, "ts", f"{base}/out")
    return f"{base}/out", stream


WAVES_CTE = "with " + ",".join([Q.SITES_RAW, Q.SITES_NUM]) + f""",
ev as (select o_orderkey as site_id, o_orderdate as ts from orders),
s as (select sites_num.*, ts, cast(greatest(0, least(floor((year(ts) - 1992) / 2) + case when site_id % {LATE_EVERY} = 0 then 1 else 0 end,
   {WAVES - 1})) as integer) as wave from sites_num join ev using (site_id)
  where Elevation is not null and Slope is not null and Rainfall is not null),
p as (select site_id, wave, epoch(ts) as t, cast(floor(epoch(ts) / 2592000) * 2592000 as bigint) as w0,
  cast({Q.rule_p('Elevation', 'Slope', 'Rainfall', Q.ndvi('Rainfall'))} > 6.25e-1 as integer) as pred from s),
marks as (select w.wave, (select max(t) from p where p.wave < w.wave) - 7776000 as mark from range({WAVES + 1}) w(wave)),
judged as (select p.*, coalesce(w0 + 2592000 <= mark, false) as late from p join marks on p.wave = marks.wave)"""


@query("stream_final_windows", WAVES_CTE + f"""
select w0 as window_start_s, w0 + 2592000 as window_end_s, count(*) as n_sites, count_if(pred = 1) as n_suitable
from judged where not late and w0 + 2592000 <= (select mark from marks where wave = {WAVES}) group by w0""")
def q_stream_final_windows(spark, sf_dir):
    """Sites arrive in waves; windows that the watermark has passed come out once and are final."""
    out, _ = run_waves(spark, sf_dir)
    return spark.read.parquet(f"{out}/final")


@query("stream_late_rows", WAVES_CTE + """
select site_id, t::bigint as ts_s, pred as Prediction from judged where late""")
def q_stream_late_rows(spark, sf_dir):
    """The sites that arrived after their window was final."""
    from ..streaming import late_rows
    out, stream = run_waves(spark, sf_dir)
    return late_rows(spark, out, stream.schema).select("site_id", F.unix_seconds("ts").alias("ts_s"), "Prediction")
