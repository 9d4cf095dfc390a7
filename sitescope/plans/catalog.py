"""The query catalogue: one entry per operator, each over the driver's tables.

Every query takes ``(spark, sf_dir)`` and returns a lazy DataFrame. Queries
with an SQL restatement register it in ``ORACLE`` under the same name (same
column names, aliased on both sides).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exact_mean, np_round, zone_name
from ..operators.clean import clean_sites
from ..sources import fixtures as fx
from . import oracle_sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CLEAN_COLS = ["site_id", "Elevation", "Slope", "Rainfall", "Soil_Type", "Soil_Type_Label", "Suitability",
              "Temperature", "NDVI", "Soil_Moisture", "Elevation_Zone"]


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned training table over the sites view."""
    return clean_sites(fx.sites_labelled(spark, sf_dir), soil="names")


# ---------------------------------------------------------------- §7.2 slice
@query("sites_clean", Q.SITES_CTE + "\nselect " + ", ".join(CLEAN_COLS) + " from sites")
def q_sites_clean(spark, sf_dir):
    return sites(spark, sf_dir).select(*CLEAN_COLS)


@query("zone_counts", Q.SITES_CTE + f"""
select Elevation_Zone,
 case Elevation_Zone when 0 then 'Lowland' when 1 then 'Mid-Hill' when 2 then 'Highland' when 3 then 'Alpine' else '?' end as zone_name,
 count(*) as n_sites, cast(sum(Suitability) as bigint) as n_suitable,
 {Q.npround('cast(sum(Suitability) as double)/cast(count(*) as double)', 6)} as suitable_share,
 {Q.npround(Q.exact_mean('Elevation'), 6)} as mean_elevation
from sites group by Elevation_Zone""")
def q_zone_counts(spark, sf_dir):
    """Where is land suitable? Site count and suitable share per elevation zone."""
    return (sites(spark, sf_dir).groupBy("Elevation_Zone")
            .agg(F.count(F.lit(1)).alias("n_sites"), F.sum("Suitability").cast("bigint").alias("n_suitable"),
                 exact_mean("Elevation").alias("mean_elevation"))
            .select("Elevation_Zone", zone_name("Elevation_Zone").alias("zone_name"), "n_sites", "n_suitable",
                    np_round(F.col("n_suitable") / F.col("n_sites"), 6).alias("suitable_share"),
                    np_round("mean_elevation", 6).alias("mean_elevation")))


# ------------------------------------------------------------ cleaning, features
from ..functions import (  # noqa: E402
    coerce_double, condition_array, decode_soil, encode_soil_strict, rule_label, rule_score, soil_error,
    title_case,
)
from ..operators import clean as C  # noqa: E402


@query("numeric_coercion", "with " + Q.SITES_RAW + "," + Q.SITES_NUM + """
select site_id, Elevation, Slope, Rainfall,
 (Elevation is null or Slope is null or Rainfall is null) as is_dropped from sites_num""")
def q_numeric_coercion(spark, sf_dir):
    d = C.coerce_numeric(fx.sites_raw(spark, sf_dir), K.NUMERIC_INPUTS)
    return d.select("site_id", "Elevation", "Slope", "Rainfall",
                    (F.col("Elevation").isNull() | F.col("Slope").isNull() | F.col("Rainfall").isNull())
                    .alias("is_dropped"))


@query("label_domain", "with " + ",".join([Q.SITES_RAW, Q.SITES_NUM, Q.SITES_LAB]) + """
select count(*) as n_rows, count_if(Suitability is null) as n_missing,
 count_if(Suitability = 0) as n_zero, count_if(Suitability = 1) as n_one from sites_lab""")
def q_label_domain(spark, sf_dir):
    d = C.label_to_int(C.coerce_numeric(fx.sites_labelled(spark, sf_dir), [K.LABEL_COL]))
    y = F.col(K.LABEL_COL)
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(y.isNull()).alias("n_missing"),
                 F.count_if(y == 0).alias("n_zero"), F.count_if(y == 1).alias("n_one"))


@query("soil_encode", Q.SITES_CTE + """
select Soil_Type_Label, Soil_Type, count(*) as n from sites group by Soil_Type_Label, Soil_Type""")
def q_soil_encode(spark, sf_dir):
    return sites(spark, sf_dir).groupBy("Soil_Type_Label", "Soil_Type").agg(F.count(F.lit(1)).alias("n"))


@query("soil_decode", """
select cast(cast(l_quantity as bigint) % 6 as integer) as code,
 coalesce(case cast(l_quantity as bigint) % 6 when 0 then 'Clay' when 1 then 'Loamy' when 2 then 'Sandy' when 3 then 'Silty' end, 'Unknown') as soil,
 count(*) as n from lineitem group by 1, 2""")
def q_soil_decode(spark, sf_dir):
    code = (F.col("l_quantity").cast("bigint") % 6).cast("int")
    return (fx.table(spark, sf_dir, "lineitem").select(code.alias("code"))
            .groupBy("code").agg(F.count(F.lit(1)).alias("n"))
            .select("code", decode_soil("code").alias("soil"), "n"))


@query("title_case", f"""
select p_partkey as id, 'part' as source, p_name as raw, {Q.title('p_name')} as titled from part
union all
select n_nationkey, 'nation', n_name, {Q.title('n_name')} from nation
union all
select c_custkey, 'customer', c_mktsegment || ' ' || c_name, {Q.title("c_mktsegment || ' ' || c_name")} from customer""")
def q_title_case(spark, sf_dir):
    def part(t, key, src, raw):
        return fx.table(spark, sf_dir, t).select(F.col(key).cast("bigint").alias("id"), F.lit(src).alias("source"),
                                                 raw.alias("raw")).withColumn("titled", title_case("raw"))
    return (part("part", "p_partkey", "part", F.col("p_name"))
            .unionByName(part("nation", "n_nationkey", "nation", F.col("n_name")))
            .unionByName(part("customer", "c_custkey", "customer",
                              F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("c_name")))))


WIDE_COLS = ["site_id", "Elevation", "Slope", "Rainfall", "Soil_Type", "Soil_Type_Label", "Temperature", "NDVI",
             "Soil_Moisture", "Elevation_Zone"]


@query("features_all", Q.WIDE_CTE + "\nselect " + ", ".join(WIDE_COLS) + " from wide")
def q_features_all(spark, sf_dir):
    return C.derive_features(C.encode_soil_column(fx.sites_wide(spark, sf_dir), soil="names")).select(*WIDE_COLS)


@query("features_partial_columns", "with " + Q.SITES_WIDE + f""",
given as (select *, case when l_ln = 7 then null else 25e0 end as Temperature, 5e-1 as NDVI
  from (select *, site_id - 8*((site_id - 1) // 8) as l_ln from sites_wide)),
flags as (select max(case when Temperature is null then 1 else 0 end) as t_any, max(case when NDVI is null then 1 else 0 end) as n_any from given)
select site_id,
 case when t_any = 1 then {Q.temperature('Elevation')} else Temperature end as Temperature,
 case when n_any = 1 then {Q.ndvi('Rainfall')} else NDVI end as NDVI,
 {Q.moisture('Rainfall', 'Slope')} as Soil_Moisture, {Q.zone('Elevation')} as Elevation_Zone
from given, flags""")
def q_features_partial_columns(spark, sf_dir):
    """A provided column with one missing cell is recomputed whole; a complete one is kept."""
    w = fx.sites_wide(spark, sf_dir)
    ln = F.col("site_id") - 8 * F.floor((F.col("site_id") - 1) / 8).cast("bigint")
    given = w.withColumns({"Temperature": F.when(ln != 7, F.lit(25.0)), "NDVI": F.lit(0.5)})
    return C.derive_features(given).select("site_id", "Temperature", "NDVI", "Soil_Moisture", "Elevation_Zone")


@query("features_optional_text", "with " + Q.SITES_WIDE + f""",
given as (select *, case when l_ln = 7 then 'n/a' else '25.5' end as t, '0.5' as n, case when l_ln <> 3 then '0.25' end as m
  from (select *, site_id - 8*((site_id - 1) // 8) as l_ln from sites_wide)),
parsed as (select *, {Q.coerce('t')} as t_num, {Q.coerce('n')} as n_num, {Q.coerce('m')} as m_num from given),
flags as (select count_if(t_num is null) > 0 as t_any, count_if(n_num is null) > 0 as n_any, count_if(m_num is null) > 0 as m_any from parsed)
select site_id,
 case when t_any then {Q.temperature('Elevation')} else t_num end as Temperature,
 case when n_any then {Q.ndvi('Rainfall')} else n_num end as NDVI,
 case when m_any then {Q.moisture('Rainfall', 'Slope')} else m_num end as Soil_Moisture
from parsed, flags""")
def q_features_optional_text(spark, sf_dir):
    """Optional columns as a CSV scan reads them: text, with "n/a" and empty cells."""
    w = fx.sites_wide(spark, sf_dir)
    ln = F.col("site_id") - 8 * F.floor((F.col("site_id") - 1) / 8).cast("bigint")
    given = w.withColumns({"Temperature": F.when(ln == 7, "n/a").otherwise("25.5"), "NDVI": F.lit("0.5"),
                           "Soil_Moisture": F.when(ln != 3, "0.25")})
    return C.derive_features(given).select("site_id", "Temperature", "NDVI", "Soil_Moisture")


@query("soil_numeric_codes", "with " + Q.SITES_WIDE + """,
coded as (select site_id, case when site_id % 7 <> 0 then cast(site_id % 5 as integer) end as Soil_Type from sites_wide)
select Soil_Type, case Soil_Type when 0 then 'Clay' when 1 then 'Loamy' when 2 then 'Sandy' when 3 then 'Silty' else 'Unknown' end as Soil_Type_Label,
 count(*) as n from coded group by 1, 2""")
def q_soil_numeric_codes(spark, sf_dir):
    """Soil codes as a CSV scan reads them: text that holds whole numbers and empty cells."""
    code = F.when(F.col("site_id") % 7 != 0, (F.col("site_id") % 5).cast("string"))
    coded = C.encode_soil_column(fx.sites_wide(spark, sf_dir).withColumn("Soil_Type", code))
    return coded.groupBy("Soil_Type", "Soil_Type_Label").agg(F.count(F.lit(1)).alias("n"))


@query("strict_soil_errors", "with " + Q.SITES_RAW + f"""
select site_id, Soil_Type as soil, {Q.soil_strict('Soil_Type')} as code,
 case when {Q.soil_strict('Soil_Type')} is null then 'no soil code for ' || coalesce(Soil_Type, 'a missing name') || ' (known: Clay, Loamy, Sandy, Silty)' end as error
from sites_raw""")
def q_strict_soil_errors(spark, sf_dir):
    r = fx.sites_raw(spark, sf_dir)
    return r.select("site_id", F.col("Soil_Type").alias("soil"), encode_soil_strict("Soil_Type").alias("code"),
                    soil_error("Soil_Type").alias("error"))


# ------------------------------------------------------------------ rule scoring
RULE_SQL = Q.rule_score("Elevation", "Slope", "Rainfall", "NDVI")


@query("rule_score", Q.SITES_CTE + f"""
select site_id, {RULE_SQL} as rule_score, cast({RULE_SQL} > 2.5e0 as integer) as rule_label, Suitability from sites""")
def q_rule_score(spark, sf_dir):
    s = sites(spark, sf_dir).withColumn("rule_score", rule_score("Elevation", "Slope", "Rainfall", "NDVI"))
    return s.select("site_id", "rule_score", rule_label("rule_score").alias("rule_label"), "Suitability")


@query("rule_label_by_zone", Q.SITES_CTE + f"""
select Elevation_Zone, Soil_Type, count(*) as n, {Q.npround(Q.exact_mean(RULE_SQL), 6)} as mean_score,
 count_if({RULE_SQL} > 2.5e0) as n_rule_suitable, count_if(Suitability = 1) as n_suitable
from sites group by Elevation_Zone, Soil_Type""")
def q_rule_label_by_zone(spark, sf_dir):
    s = sites(spark, sf_dir).withColumn("_score", rule_score("Elevation", "Slope", "Rainfall", "NDVI"))
    return s.groupBy("Elevation_Zone", "Soil_Type").agg(
        F.count(F.lit(1)).alias("n"), np_round(exact_mean("_score"), 6).alias("mean_score"),
        F.count_if(F.col("_score") > K.RULE_THRESHOLD).alias("n_rule_suitable"),
        F.count_if(F.col("Suitability") == 1).alias("n_suitable"))


def _cond_sql(source: str, key: str = "site_id") -> str:
    parts = []
    for name, col, ideal, op, unit in K.CONDITIONS:
        parts.append(f"select {key}, '{name}' as name, {Q.npround(col, 3)} as val, cast({ideal!r} as double) as ideal, "
                     f"'{op}' as op, '{unit}' as unit, ({col} {op} {ideal!r}) as passed from {source}")
    return "\nunion all\n".join(parts)


@query("condition_checks", Q.SITES_CTE + "\n" + _cond_sql("sites"))
def q_condition_checks(spark, sf_dir):
    s = sites(spark, sf_dir).withColumn("conditions", condition_array())
    return s.select("site_id", F.inline("conditions"))


@query("condition_pass_rate", Q.SITES_CTE + ", checks as (" + _cond_sql("sites") + """)
select name, count(*) as n, count_if(passed) as n_passed, round_even(cast(count_if(passed) as double)/count(*)*1e6, 0)/1e6 as pass_rate
from checks group by name
union all
select 'ALL', count(*), count_if(np = 6), round_even(cast(count_if(np = 6) as double)/count(*)*1e6, 0)/1e6
from (select site_id, count_if(passed) as np from checks group by site_id)""")
def q_condition_pass_rate(spark, sf_dir):
    s = sites(spark, sf_dir).withColumn("conditions", condition_array())
    names = [c[0] for c in K.CONDITIONS]
    passed = [F.col("conditions")[i]["passed"] for i in range(len(names))]
    row = s.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(p).alias(f"p{i}") for i, p in enumerate(passed)],
                F.count_if(F.forall("conditions", lambda c: c["passed"])).alias("all_passed"))
    cells = [F.struct(F.lit(x).alias("name"), F.col(c).alias("n_passed"))
             for x, c in [*[(x, f"p{i}") for i, x in enumerate(names)], ("ALL", "all_passed")]]
    return row.select("n", F.inline(F.array(*cells))).select(
        "name", "n", "n_passed", np_round(F.try_divide("n_passed", "n"), 6).alias("pass_rate"))


# ------------------------------------------------------------- batch / single scoring
from ..functions import class_label, gap_band  # noqa: E402,F401
from ..operators import score as S  # noqa: E402
from ..operators import profile as PR  # noqa: E402


def wide_scored(spark, sf_dir):
    return S.score_batch(fx.sites_wide(spark, sf_dir), S.RuleScorer(), soil="names")


@query("batch_scores", Q.WIDE_CTE + "," + Q.WIDE_SCORED + f"""
select site_id, pred as Prediction, {Q.npround('conf', 4)} as Confidence,
 case pred when 1 then 'Suitable' else 'Not Suitable' end as Label, {Q.tier(Q.npround('conf', 4))} as Conf_Tier
from wide_scored""")
def q_batch_scores(spark, sf_dir):
    return wide_scored(spark, sf_dir).select("site_id", "Prediction", "Confidence", "Label", "Conf_Tier")


@query("confidence_tiers", Q.WIDE_CTE + "," + Q.WIDE_SCORED + f"""
select case pred when 1 then 'Suitable' else 'Not Suitable' end as Label, {Q.tier(Q.npround('conf', 4))} as Conf_Tier,
 count(*) as n from wide_scored group by 1, 2""")
def q_confidence_tiers(spark, sf_dir):
    return wide_scored(spark, sf_dir).groupBy("Label", "Conf_Tier").agg(F.count(F.lit(1)).alias("n"))


@query("batch_summary", Q.WIDE_CTE + "," + Q.WIDE_SCORED + """
select count(*) as total, count_if(pred = 1) as suitable, count(*) - count_if(pred = 1) as not_suitable,
 round_even(count_if(pred = 1)*1e2/count(*)*1e6, 0)/1e6 as suitable_pct,
 round_even((count(*) - count_if(pred = 1))*1e2/count(*)*1e6, 0)/1e6 as not_suitable_pct
from wide_scored""")
def q_batch_summary(spark, sf_dir):
    return S.batch_summary(wide_scored(spark, sf_dir))


@query("dataset_overview", Q.SITES_CTE + """
select count(*) as n_rows, count_if(Suitability = 1) as n_suitable,
 round_even(count_if(Suitability = 1)*1e2/count(*)*1e6, 0)/1e6 as suitable_pct,
 count(*) - count_if(Suitability = 1) as n_not_suitable,
 round_even((count(*) - count_if(Suitability = 1))*1e2/count(*)*1e6, 0)/1e6 as not_suitable_pct
from sites""")
def q_dataset_overview(spark, sf_dir):
    return PR.overview(sites(spark, sf_dir), K.LABEL_COL)


def _single_input(spark, sf_dir):
    """Typed inputs with the raw soil text (unknown soils included)."""
    return sites(spark, sf_dir).select("site_id", "Elevation", "Slope", "Rainfall",
                                       F.col("Soil_Type_Label").alias("Soil_Type"))


SINGLE_SQL = Q.SITES_CTE + f""",
single as (
 select site_id, Elevation, Slope, Rainfall, Soil_Type_Label as soil, {Q.soil_strict('Soil_Type_Label')} as code,
  {Q.npround(Q.temperature('Elevation'), 2)} as Temperature, {Q.npround(Q.ndvi('Rainfall'), 4)} as NDVI,
  {Q.npround(Q.moisture('Rainfall', 'Slope'), 4)} as Soil_Moisture, {Q.zone('Elevation')} as Elevation_Zone
 from sites),
single_p as (select *, {Q.rule_p()} as p from single),
single_s as (select *, cast(p > 6.25e-1 as integer) as pred, case when p > 6.25e-1 then p else 1e0 - p end as conf from single_p)
select site_id, Temperature, NDVI, Soil_Moisture, Elevation_Zone,
 case when code is not null then pred end as prediction,
 case when code is not null then conf end as confidence,
 case when code is not null then (case pred when 1 then 'Suitable' else 'Not Suitable' end) end as label,
 case when code is not null then {Q.tier('conf')} end as conf_tier,
 case when code is not null then cast((Rainfall >= 600.0) as integer) + cast((Slope <= 20.0) as integer)
  + cast((Elevation <= 2000.0) as integer) + cast((NDVI >= 0.4) as integer) + cast((Soil_Moisture >= 0.1) as integer)
  + cast((Temperature >= 15.0) as integer) end as n_passed,
 case when code is null then 'no soil code for ' || coalesce(soil, 'a missing name') || ' (known: Clay, Loamy, Sandy, Silty)' end as error
from single_s"""


@query("single_scores", SINGLE_SQL)
def q_single_scores(spark, sf_dir):
    s = S.score_single(_single_input(spark, sf_dir), S.RuleScorer())
    return s.select("site_id", "Temperature", "NDVI", "Soil_Moisture", "Elevation_Zone", "prediction", "confidence",
                    "label", "conf_tier",
                    F.size(F.filter("conditions", lambda c: c["passed"])).alias("n_passed"), "error") \
        .withColumn("n_passed", F.when(F.col("error").isNull(), F.col("n_passed")))


# ------------------------------------------------------------------- districts
from ..operators import districts as D  # noqa: E402
from ..session import shared_path  # noqa: E402
from ..sources.district_store import lookup_stored, store_districts  # noqa: E402
from ..operators import similar as SIM  # noqa: E402

ROLLUP_SQL = "with " + Q.OBSERVATIONS + f""",
g as (select state, district, {Q.exact_mean('elevation')} as elevation, {Q.exact_mean('rainfall')} as rainfall,
  {Q.exact_mean('avg_temp')} as avg_temp, {Q.exact_mean('latitude')} as latitude, {Q.exact_mean('longitude')} as longitude
 from observations where state is not null and district is not null group by state, district)
select state, district, {Q.npround('elevation', 0)} as elevation, {Q.npround('avg_temp', 1)} as avg_temp,
 {Q.npround('latitude', 4)} as latitude, {Q.npround('longitude', 4)} as longitude,
 {Q.npround(Q.npround('rainfall*365e0', 0), 0)} as annual_rainfall
from g"""


@query("district_rollup", ROLLUP_SQL)
def q_district_rollup(spark, sf_dir):
    return D.rollup_observations(fx.observations(spark, sf_dir))


@query("district_rollup_defaults", "with " + Q.OBSERVATIONS + f""",
g as (select state, district, {Q.exact_mean('rainfall')} as rainfall
 from observations where state is not null and district is not null group by state, district)
select state, district, 2e2 as elevation, {Q.npround(Q.temperature('2e2'), 1)} as avg_temp,
 cast(null as double) as latitude, cast(null as double) as longitude,
 {Q.npround(Q.npround('rainfall*365e0', 0), 0)} as annual_rainfall
from g""")
def q_district_rollup_defaults(spark, sf_dir):
    """Only the key and daily rainfall exist: defaults fill the rest."""
    return D.rollup_observations(fx.observations(spark, sf_dir).select("state", "district", "rainfall"))


@query("districts_clean", "with " + Q.DISTRICTS + f"""
select district_id, {Q.title('state')} as state, {Q.title('district')} as district,
 coalesce(elevation, 0e0) as elevation, coalesce(annual_rainfall, 0e0) as annual_rainfall,
 {Q.temperature('coalesce(elevation, 0e0)')} as avg_temp, cast(null as double) as latitude,
 cast(null as double) as longitude from districts""")
def q_districts_clean(spark, sf_dir):
    return D.clean_districts(fx.districts(spark, sf_dir)).select(
        "district_id", "state", "district", "elevation", "annual_rainfall", "avg_temp", "latitude", "longitude")


LOOKUP_STATE, LOOKUP_DISTRICT = "NATION_1", "BUILDING 3"


@query("district_lookup", ROLLUP_SQL.replace("\nfrom g", f"\nfrom g where state = '{LOOKUP_STATE}' and district = '{LOOKUP_DISTRICT}'"))
def q_district_lookup(spark, sf_dir):
    """The roll-up is stored once, by state and district; the lookup reads one partition of it."""
    path = store_districts(D.rollup_observations(fx.observations(spark, sf_dir), sort=False), shared_path(spark, "districts"))
    return lookup_stored(spark, path, LOOKUP_STATE, LOOKUP_DISTRICT)


@query("district_list", "with " + Q.OBSERVATIONS + """
select distinct state, district from observations where state is not null and district is not null""")
def q_district_list(spark, sf_dir):
    return D.list_districts(fx.observations(spark, sf_dir))


@query("state_list", "with " + Q.OBSERVATIONS + """
select distinct state from observations where state is not null""")
def q_state_list(spark, sf_dir):
    return D.list_states(fx.observations(spark, sf_dir))


@query("district_coords", ROLLUP_SQL.replace(
    "select state, district, " + Q.npround('elevation', 0) + " as elevation, " + Q.npround('avg_temp', 1) + " as avg_temp,",
    "select state, district,").replace(
    f",\n {Q.npround(Q.npround('rainfall*365e0', 0), 0)} as annual_rainfall\nfrom g",
    "\nfrom g where latitude is not null and longitude is not null"))
def q_district_coords(spark, sf_dir):
    return D.district_coords(D.rollup_observations(fx.observations(spark, sf_dir), sort=False))


@query("autofill_clipped", Q.SITES_CTE + "," + Q.DISTRICTS + """,
b as (select min(Elevation) as elo, max(Elevation) as ehi, min(Rainfall) as rlo, max(Rainfall) as rhi from sites)
select state, district, case when elevation is not null then least(greatest(elevation, coalesce(elo, 0e0)), coalesce(ehi, 3e3)) end as Elevation,
 case when annual_rainfall is not null then least(greatest(annual_rainfall, coalesce(rlo, 2e2)), coalesce(rhi, 2e3)) end as Rainfall
from districts, b""")
def q_autofill_clipped(spark, sf_dir):
    return D.autofill_inputs(fx.districts(spark, sf_dir), sites(spark, sf_dir))


# ------------------------------------------------------------------ similarity
def _sim_sql_params(src: str = "districts") -> str:
    return f"""p as (select min(coalesce(elevation,0e0)) as emin, max(coalesce(elevation,0e0)) as emax,
 min(coalesce(annual_rainfall,0e0)) as rmin, max(coalesce(annual_rainfall,0e0)) as rmax, count(*) as n_rows from {src}),
q as (select emin, rmin, coalesce(case when emax - emin <> 0 then emax - emin end, 1e0) as erng,
 coalesce(case when rmax - rmin <> 0 then rmax - rmin end, 1e0) as rrng, n_rows from p)"""


def _dist_sql(qe: str, qr: str) -> str:
    de = f"((coalesce(elevation,0e0) - emin)/erng - ({qe} - emin)/erng)"
    dr = f"((coalesce(annual_rainfall,0e0) - rmin)/rrng - ({qr} - rmin)/rrng)"
    return f"sqrt({de}*{de} + {dr}*{dr})"


@query("similar_districts", "with " + Q.DISTRICTS + "," + _sim_sql_params() + f""",
d as (select districts.*, case when n_rows >= 2 then {_dist_sql('6e2', '8e2')} end as dist from districts, q)
select cast(row_number() over (order by dist nulls last, state, district) as integer) as rank, district_id, state, district,
 elevation, annual_rainfall, {Q.npround('dist', 4)} as Match_Distance
from d order by dist nulls last, state, district limit 10""")
def q_similar_districts(spark, sf_dir):
    return SIM.similar_districts(fx.districts(spark, sf_dir), 600.0, 800.0, n=10)


@query("similar_many_targets", "with " + Q.DISTRICTS + "," + _sim_sql_params() + """,
t as (select c_custkey as target_id, cast((c_custkey*53)%3001 as double) as te, cast(200+(c_custkey*101)%1801 as double) as tr from customer),
pairs as (select target_id, district_id, state, district, elevation, annual_rainfall,
  sqrt(((coalesce(elevation,0e0) - emin)/erng - (te - emin)/erng)*((coalesce(elevation,0e0) - emin)/erng - (te - emin)/erng)
     + ((coalesce(annual_rainfall,0e0) - rmin)/rrng - (tr - rmin)/rrng)*((coalesce(annual_rainfall,0e0) - rmin)/rrng - (tr - rmin)/rrng)) as dist
  from t, districts, q),
r as (select *, cast(row_number() over (partition by target_id order by dist, state, district, district_id) as integer) as rank from pairs)
select target_id, rank, district_id, state, district, elevation, annual_rainfall, round_even(dist*1e4, 0)/1e4 as Match_Distance
from r where rank <= 10""")
def q_similar_many_targets(spark, sf_dir):
    return SIM.similar_many(fx.districts(spark, sf_dir), fx.targets(spark, sf_dir), n=10)


@query("minmax_scaled", "with " + Q.DISTRICTS + "," + _sim_sql_params() + """
select district_id, (coalesce(elevation,0e0) - emin)/erng as elevation_scaled,
 (coalesce(annual_rainfall,0e0) - rmin)/rrng as annual_rainfall_scaled from districts, q""")
def q_minmax_scaled(spark, sf_dir):
    return SIM.minmax_scale(fx.districts(spark, sf_dir)).select("district_id", "elevation_scaled",
                                                                 "annual_rainfall_scaled")


# --------------------------------------------------------------------- profiling
NUM_PROFILE = ["Elevation", "Slope", "Rainfall", "Soil_Type", "Suitability", "Temperature", "NDVI",
               "Soil_Moisture", "Elevation_Zone"]
CORR_COLS = ["Elevation", "Slope", "Rainfall", "Temperature", "NDVI", "Soil_Moisture", "Suitability"]
HIST_COLS = ["Elevation", "Slope", "Rainfall", "Temperature", "NDVI", "Soil_Moisture"]


@query("class_balance", Q.SITES_CTE + """
select Suitability, count(*) as n from sites group by Suitability""")
def q_class_balance(spark, sf_dir):
    return PR.class_counts(sites(spark, sf_dir))


@query("class_ratio", Q.SITES_CTE + """
select count_if(Suitability = 0) as n0, count_if(Suitability = 1) as n1,
 round_even(cast(count_if(Suitability = 1) as double) / greatest(case when count_if(Suitability = 0) = 0 then 1 else count_if(Suitability = 0) end, 1) * 1e3, 0) / 1e3 as class_ratio
from sites""")
def q_class_ratio(spark, sf_dir):
    return PR.class_ratio(sites(spark, sf_dir))


@query("duplicates", Q.WIDE_CTE + """
select cast(coalesce(sum(n - 1), 0) as bigint) as n_dupes from (
 select count(*) as n from wide group by Elevation, Slope, Rainfall, Soil_Type)""")
def q_duplicates(spark, sf_dir):
    w = C.encode_soil_column(fx.sites_wide(spark, sf_dir), soil="names")
    return PR.duplicate_rows(w, ["Elevation", "Slope", "Rainfall", "Soil_Type"])


MISSING_COLS = ["site_id", "Elevation", "Slope", "Rainfall", "Soil_Type", "noise", "Suitability"]


@query("missing_cells", "with " + ",".join([Q.SITES_RAW, Q.SITES_NUM, Q.SITES_LAB]) + "\n" + "\nunion all\n".join(
    f"select '{c}' as \"column\", count_if({c} is null) as n_missing from sites_lab having count_if({c} is null) > 0"
    for c in MISSING_COLS))
def q_missing_cells(spark, sf_dir):
    d = C.coerce_numeric(fx.sites_labelled(spark, sf_dir), K.NUMERIC_INPUTS).select(*MISSING_COLS)
    return PR.missing_cells(d)


def _iqr_sql(cols) -> str:
    qs = ", ".join(f"quantile_cont({c}, 0.25) as q1_{c}, quantile_cont({c}, 0.75) as q3_{c}" for c in cols)
    parts = []
    for c in cols:
        lo, hi = f"(q1_{c} - 1.5*(q3_{c} - q1_{c}))", f"(q3_{c} + 1.5*(q3_{c} - q1_{c}))"
        parts.append(f"select '{c}' as \"column\", {Q.npround(f'q1_{c}', 9)} as q1, {Q.npround(f'q3_{c}', 9)} as q3, "
                     f"{Q.npround(lo, 9)} as lower, {Q.npround(hi, 9)} as upper, "
                     f"(select count_if({c} < {lo} or {c} > {hi}) from sites) as n_outliers from qq")
    return f", qq as (select {qs} from sites)\nselect * from (" + "\nunion all\n".join(parts) + ") where n_outliers > 0"


@query("iqr_outliers", Q.SITES_CTE + _iqr_sql(NUM_PROFILE))
def q_iqr_outliers(spark, sf_dir):
    o = PR.iqr_outliers(sites(spark, sf_dir).select(*NUM_PROFILE))
    return o.select("column", *[np_round(c, 9).alias(c) for c in ("q1", "q3", "lower", "upper")], "n_outliers")


@query("bounds", Q.SITES_CTE + "\n" + "\nunion all\n".join(
    f"select '{c}' as \"column\", coalesce(min({c}), {lo!r}) as min, coalesce(max({c}), {hi!r}) as max from sites"
    for c, (lo, hi) in K.FALLBACK_BOUNDS.items()))
def q_bounds(spark, sf_dir):
    return PR.numeric_bounds(sites(spark, sf_dir))


def _corr_sql(cols) -> str:
    cells = []
    for a in cols:
        for b in cols:
            r = f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
            cells.append(f"select '{a}' as x, '{b}' as y, {Q.npround(f'case when stddev_pop({a}) * stddev_pop({b}) > 0 then {r} end', 2)} as r from sites")
    return "\nunion all\n".join(cells)


@query("correlation", Q.SITES_CTE + "\n" + _corr_sql(CORR_COLS))
def q_correlation(spark, sf_dir):
    return PR.correlation(sites(spark, sf_dir), CORR_COLS)


def _hist_sql(cols, bins=K.HIST_BINS) -> str:
    parts = []
    for c in cols:
        parts.append(f"select '{c}' as feature, Suitability, {c} as value, (select min({c}) from sites) as lo, "
                     f"(select max({c}) from sites) as hi from sites where {c} is not null")
    long = "\nunion all\n".join(parts)
    return f""", long as ({long}),
binned as (select feature, Suitability, lo, hi, cast(case when hi - lo > 0 then least(floor((value - lo)/(hi - lo)*{bins}), {bins - 1}) else 0 end as integer) as bin from long)
select feature, Suitability, bin, lo + bin*((hi - lo)/{bins}) as bin_lo, lo + (bin + 1)*((hi - lo)/{bins}) as bin_hi, count(*) as n
from binned group by feature, Suitability, bin, lo, hi"""


@query("histograms", Q.SITES_CTE + _hist_sql(HIST_COLS))
def q_histograms(spark, sf_dir):
    return PR.histograms(sites(spark, sf_dir), HIST_COLS)


QUALITY_COLS = ["Elevation", "Slope", "Rainfall", "Soil_Type", "Suitability", "Temperature", "NDVI",
                "Soil_Moisture", "Elevation_Zone"]


@query("quality_report", Q.SITES_CTE + ", s as (select " + ", ".join(QUALITY_COLS) + " from sites)" + f"""
select 'n_rows' as metric, cast(null as varchar) as "column", cast(count(*) as double) as value from s
union all select 'n_cols', null, {float(len(QUALITY_COLS))!r}
union all select 'n_dupes', null, cast(coalesce(sum(n - 1), 0) as double) from (select count(*) as n from s group by {", ".join(QUALITY_COLS)})
union all select 'total_missing', null, 0e0
union all select 'class_balance', cast(Suitability as varchar), cast(count(*) as double) from s group by Suitability
union all select 'class_ratio', null, round_even(cast(count_if(Suitability = 1) as double) / greatest(case when count_if(Suitability = 0) = 0 then 1 else count_if(Suitability = 0) end, 1) * 1e3, 0) / 1e3 from s
union all select 'outliers', "column", cast(n_outliers as double) from (
""" + _iqr_sql(QUALITY_COLS).replace(", qq as (", "with qq as (").replace("from sites", "from s") + ")")
def q_quality_report(spark, sf_dir):
    return PR.quality_report(sites(spark, sf_dir).select(*QUALITY_COLS))


ROUGH_COLS = ["Elevation", "Slope", "Rainfall", "Suitability"]
ROUGH_CTE = "with " + ",".join([Q.SITES_RAW, Q.SITES_NUM, Q.SITES_LAB]) + """,
rough as (select Elevation, Slope, case when site_id % 83 = 0 then Rainfall * 2e1 else Rainfall end as Rainfall, Suitability
 from sites_lab)"""


def rough_sites(spark, sf_dir):
    """Sites before rows with missing cells go, with outliers of rainfall."""
    d = C.coerce_numeric(fx.sites_labelled(spark, sf_dir), K.NUMERIC_INPUTS)
    wet = F.when(F.col("site_id") % 83 == 0, F.col("Rainfall") * 20.0).otherwise(F.col("Rainfall"))
    return d.withColumn("Rainfall", wet).select(*ROUGH_COLS)


@query("iqr_outliers_rough", ROUGH_CTE + _iqr_sql(ROUGH_COLS).replace("from sites", "from rough"))
def q_iqr_outliers_rough(spark, sf_dir):
    o = PR.iqr_outliers(rough_sites(spark, sf_dir))
    return o.select("column", *[np_round(c, 9).alias(c) for c in ("q1", "q3", "lower", "upper")], "n_outliers")


@query("quality_report_rough", ROUGH_CTE + f"""
select 'n_rows' as metric, cast(null as varchar) as "column", cast(count(*) as double) as value from rough
union all select 'n_cols', null, {float(len(ROUGH_COLS))!r}
union all select 'n_dupes', null, cast(coalesce(sum(n - 1), 0) as double) from (select count(*) as n from rough group by {", ".join(ROUGH_COLS)})
union all select 'total_missing', null, cast({" + ".join(f"count_if({c} is null)" for c in ROUGH_COLS)} as double) from rough
""" + "".join(f"""union all select 'missing', '{c}', cast(count_if({c} is null) as double) from rough having count_if({c} is null) > 0
""" for c in ROUGH_COLS) + """union all select 'class_balance', cast(Suitability as varchar), cast(count(*) as double) from rough where Suitability is not null group by Suitability
union all select 'class_ratio', null, round_even(cast(count_if(Suitability = 1) as double) / greatest(case when count_if(Suitability = 0) = 0 then 1 else count_if(Suitability = 0) end, 1) * 1e3, 0) / 1e3 from rough
union all select 'outliers', "column", cast(n_outliers as double) from (
""" + _iqr_sql(ROUGH_COLS).replace(", qq as (", "with qq as (").replace("from sites", "from rough") + ")")
def q_quality_report_rough(spark, sf_dir):
    return PR.quality_report(rough_sites(spark, sf_dir))


# ------------------------------------------------------------- sampling, splits
from ..functions.hashing import unit_hash_sql  # noqa: E402
from ..operators import evaluate as EV  # noqa: E402
from ..operators import sampling as SA  # noqa: E402
from ..operators import split as SP  # noqa: E402


@query("sample_scatter", Q.SITES_CTE + f"""
select site_id, Elevation as x, Slope as y, case Suitability when 1 then 'Suitable' else 'Not Suitable' end as class
from sites order by {unit_hash_sql('site_id', 42)}, site_id limit {K.SCATTER_SAMPLE}""")
def q_sample_scatter(spark, sf_dir):
    return SA.scatter(sites(spark, sf_dir), "Elevation", "Slope", key="site_id", n=K.SCATTER_SAMPLE, seed=42)


def _placed_sql(source: str, seed: int, label: str = "Suitability") -> str:
    """Rows of ``source`` with their place (from 0) in their class and its size, by SQL ranks."""
    return (f"(select *, row_number() over (partition by {label} order by {unit_hash_sql('site_id', seed)}, site_id) - 1 as r, "
            f"count(*) over (partition by {label}) as n_class from {source})")


TEST_SQL = "r < floor(n_class * 0.2e0 + 0.5e0)"


@query("stratified_split_sizes", Q.SITES_CTE + f"""
select Suitability, count(*) as n, count_if({TEST_SQL}) as n_test, count_if(not ({TEST_SQL})) as n_train
from {_placed_sql('sites', K.SPLIT_SEED)} group by Suitability""")
def q_stratified_split_sizes(spark, sf_dir):
    return SP.split_sizes(sites(spark, sf_dir), key="site_id")


@query("split_rows", Q.SITES_CTE + f"""
select site_id, {TEST_SQL} as is_test from {_placed_sql('sites', K.SPLIT_SEED)}""")
def q_split_rows(spark, sf_dir):
    """The part of every row."""
    return SP.with_split(sites(spark, sf_dir), key="site_id").select("site_id", "is_test")


@query("fold_sizes", Q.SITES_CTE + f"""
select cast(r * 5 // n_class as integer) as fold, Suitability, count(*) as n
from {_placed_sql('sites', K.SPLIT_SEED + 1)} group by 1, 2""")
def q_fold_sizes(spark, sf_dir):
    return SP.fold_sizes(sites(spark, sf_dir), key="site_id")


@query("rare_class_split", Q.SITES_CTE + f""",
rare as (select site_id, cast(Elevation_Zone = 0 and Slope < 1e0 as integer) as flag from sites)
select flag, count(*) as n, count_if({TEST_SQL}) as n_test, count_if(not ({TEST_SQL})) as n_train
from {_placed_sql('rare', K.SPLIT_SEED, 'flag')} group by flag""")
def q_rare_class_split(spark, sf_dir):
    """A class of few rows keeps its share of the test part."""
    flag = ((F.col("Elevation_Zone") == 0) & (F.col("Slope") < 1)).cast("int")
    return SP.split_sizes(sites(spark, sf_dir).select("site_id", flag.alias("flag")), key="site_id", label="flag")


@query("class_weights", Q.SITES_CTE + f""",
tr as (select * from {_placed_sql('sites', K.SPLIT_SEED)} where not ({TEST_SQL}))
select Suitability, count(*) as n_class,
 cast((select count(*) from tr) as double) / ((select count(distinct Suitability) from tr) * count(*)) as weight
from tr group by Suitability""")
def q_class_weights(spark, sf_dir):
    train, _ = SP.train_test(sites(spark, sf_dir), key="site_id")
    return SP.class_weights(train)


# ------------------------------------------------------- evaluation (rule scorer)
def scored(spark, sf_dir):
    """Sites scored by the rule: y = label (with noise), p = rule score / 4, pred = p > 0.625."""
    s = S.with_prediction(sites(spark, sf_dir), S.RuleScorer())
    return s.select("site_id", F.col("Suitability").alias("y"), F.col(S.P1).alias("p"),
                    F.col("Prediction").alias("pred"))


SCORED_CTE = Q.SITES_CTE + "," + Q.SCORED


@query("binary_metrics", SCORED_CTE + """,
c as (select count_if(y = 1 and pred = 1) as tp, count_if(y = 0 and pred = 1) as fp,
  count_if(y = 1 and pred = 0) as fn, count_if(y = 0 and pred = 0) as tn from scored)
select tp, fp, fn, tn,
 coalesce(cast(tp + tn as double) / nullif(tp + tn + fp + fn, 0), 0e0) as accuracy,
 coalesce(cast(tp as double) / nullif(tp + fp, 0), 0e0) as precision,
 coalesce(cast(tp as double) / nullif(tp + fn, 0), 0e0) as recall,
 coalesce(cast(2*tp as double) / nullif(2*tp + fp + fn, 0), 0e0) as f1
from c""")
def q_binary_metrics(spark, sf_dir):
    return EV.binary_metrics(scored(spark, sf_dir))


@query("confusion", SCORED_CTE + """,
cells as (select * from (values (0, 0), (0, 1), (1, 0), (1, 1)) v(actual, predicted))
select cells.actual, cells.predicted, count(scored.y) as n
from cells left join scored on scored.y = cells.actual and scored.pred = cells.predicted
group by cells.actual, cells.predicted""")
def q_confusion(spark, sf_dir):
    return EV.confusion_matrix(scored(spark, sf_dir))


ROC_SQL = SCORED_CTE + """,
d as (select p as score, count_if(y = 1) as pos, count_if(y <> 1) as neg from scored group by p),
c as (select score, pos, neg, sum(pos) over (order by score desc rows between unbounded preceding and current row) as tp,
  sum(neg) over (order by score desc rows between unbounded preceding and current row) as fp from d),
t as (select count_if(y = 1) as P, count_if(y <> 1) as N from scored)"""


@query("roc_points", ROC_SQL + """
select 'inf'::double as threshold, 0e0 as fpr, 0e0 as tpr
union all
select score, cast(fp as double) / N, cast(tp as double) / P from c, t""")
def q_roc_points(spark, sf_dir):
    return EV.roc_points(scored(spark, sf_dir))


@query("roc_auc", ROC_SQL + """
select cast(sum(cast(neg * (2*tp - pos) as decimal(38,0))) as double) / (2e0 * cast(P as double) * cast(N as double)) as roc_auc
from c, t group by P, N""")
def q_roc_auc(spark, sf_dir):
    return EV.roc_auc(scored(spark, sf_dir))


_EDGES = " + ".join(f"cast(p > {i * (1.0 / K.CALIBRATION_BINS)!r} as integer)" for i in range(1, K.CALIBRATION_BINS))


@query("calibration", SCORED_CTE + f"""
select bin, count(*) as n, cast(count_if(y = 1) as double) / count(*) as frac_pos, {Q.exact_mean('p')} as mean_pred
from (select *, ({_EDGES}) as bin from scored) group by bin""")
def q_calibration(spark, sf_dir):
    return EV.calibration_curve(scored(spark, sf_dir))


@query("brier", SCORED_CTE + f"""
select {Q.npround(Q.exact_mean('(p - y)*(p - y)'), 9)} as brier from scored""")
def q_brier(spark, sf_dir):
    b = EV.brier_score(scored(spark, sf_dir))
    return b.select(np_round("brier", 9).alias("brier"))


@query("overfit_gap", SCORED_CTE + f""",
sp as (select *, {TEST_SQL} as is_test from {_placed_sql('scored', K.SPLIT_SEED, 'y')}),
a as (select cast(count_if(not is_test and y = pred) as double) / count_if(not is_test) as train_accuracy,
  cast(count_if(is_test and y = pred) as double) / count_if(is_test) as test_accuracy from sp)
select train_accuracy, test_accuracy, {Q.npround('train_accuracy - test_accuracy', 9)} as overfit_gap,
 case when train_accuracy - test_accuracy <= 0.03 then 'green' when train_accuracy - test_accuracy <= 0.06 then 'amber' else 'red' end as band,
 (train_accuracy - test_accuracy) > 0.05 as warning
from a""")
def q_overfit_gap(spark, sf_dir):
    return EV.overfit_gap(SP.with_split(scored(spark, sf_dir), key="site_id", label="y"))


# ----------------------------------------------------- forest (rows-only checks)
from . import model as M  # noqa: E402
from . import registry as R  # noqa: E402

# few, shallow trees keep the catalogue cheap; the bench fits the reference configuration
SMALL_FOREST = M.ForestConfig(numTrees=10, maxDepth=5, minInstancesPerNode=30)
_TRAINED: dict = {}


def trained(spark, sf_dir, cv_folds: int = 0) -> M.TrainResult:
    key = (spark.sparkContext.applicationId, sf_dir, cv_folds)
    if key not in _TRAINED:
        _TRAINED[key] = M.train_model(sites(spark, sf_dir), "site_id", SMALL_FOREST, cv_folds=cv_folds)
    return _TRAINED[key]


@query("rf_metrics")
def q_rf_metrics(spark, sf_dir):
    r = trained(spark, sf_dir, cv_folds=K.CV_FOLDS)
    keys = ["accuracy", "precision", "recall", "f1", "roc_auc", "brier_score", "train_accuracy", "overfit_gap",
            "cv_mean", "cv_std", "train_time_s"]
    row = [float(r.metrics[k]) if r.metrics.get(k) is not None else None for k in keys]
    out = spark.createDataFrame([row + [r.metrics["n_train"], r.metrics["n_test"]]],
                                ", ".join(f"{k} double" for k in keys) + ", n_train long, n_test long")
    return out.withColumns({"gap_band": gap_band("overfit_gap"),
                            "gap_warning": F.col("overfit_gap") > K.WARN_GAP,
                            "cv_warning": F.col("cv_std") > K.WARN_CV_STD})


@query("rf_confusion")
def q_rf_confusion(spark, sf_dir):
    return trained(spark, sf_dir).tables["confusion"]


@query("rf_roc")
def q_rf_roc(spark, sf_dir):
    return trained(spark, sf_dir).tables["roc"]


@query("rf_calibration")
def q_rf_calibration(spark, sf_dir):
    return trained(spark, sf_dir).tables["calibration"]


@query("rf_importances")
def q_rf_importances(spark, sf_dir):
    return trained(spark, sf_dir).tables["importances"]


@query("rf_cv")
def q_rf_cv(spark, sf_dir):
    return trained(spark, sf_dir, cv_folds=K.CV_FOLDS).tables["cv"]


@query("rf_learning_curve")
def q_rf_learning_curve(spark, sf_dir):
    s = sites(spark, sf_dir)
    data = M.assembler().transform(s.select(F.col("site_id").alias("_key"), K.LABEL_COL, *K.FEATURE_COLS))
    cfg = M.ForestConfig(numTrees=3, maxDepth=4, minInstancesPerNode=30)
    sizes = [0.1 + i * (0.9 / 7) for i in range(8)]
    return M.learning_curve(data, cfg, sizes, folds=3)


@query("rf_batch_score")
def q_rf_batch_score(spark, sf_dir):
    scorer = S.ForestScorer(trained(spark, sf_dir).model)
    return S.score_batch(fx.sites_wide(spark, sf_dir), scorer, soil="names").select(
        "site_id", "Prediction", "Confidence", "Label", "Conf_Tier")


@query("rf_split_sizes", Q.SITES_CTE + f"""
select count_if(not ({TEST_SQL})) as n_train, count_if({TEST_SQL}) as n_test from {_placed_sql('sites', K.SPLIT_SEED)}""")
def q_rf_split_sizes(spark, sf_dir):
    """Rows that a forest is fitted and tested on."""
    parts = SP.with_split(sites(spark, sf_dir), key="site_id")
    return parts.agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"))


@query("rf_test_classes", Q.SITES_CTE + f"""
select Suitability as actual, count(*) as n from {_placed_sql('sites', K.SPLIT_SEED)} where {TEST_SQL} group by Suitability""")
def q_rf_test_classes(spark, sf_dir):
    """Rows of each class that the forest's test confusion matrix counts."""
    return (trained(spark, sf_dir).tables["confusion"].groupBy("actual").agg(F.sum("n").alias("n")).where("n > 0"))


@query("rf_batch_rows", Q.WIDE_CTE + """
select site_id, count(*) as n from wide group by site_id""")
def q_rf_batch_rows(spark, sf_dir):
    """Every site of the batch is scored by the forest."""
    return q_rf_batch_score(spark, sf_dir).where("Prediction in (0, 1) and Confidence between 0.5 and 1").groupBy(
        "site_id").agg(F.count(F.lit(1)).alias("n"))


@query("rf_batch_summary")
def q_rf_batch_summary(spark, sf_dir):
    scorer = S.ForestScorer(trained(spark, sf_dir).model)
    return S.batch_summary(S.score_batch(fx.sites_wide(spark, sf_dir), scorer, soil="names"))


@query("rf_single_score")
def q_rf_single_score(spark, sf_dir):
    scorer = S.ForestScorer(trained(spark, sf_dir).model)
    s = S.score_single(_single_input(spark, sf_dir), scorer)
    return s.select("site_id", "prediction", "confidence", "label", "conf_tier", "conf_color",
                    F.size(F.filter("conditions", lambda c: c["passed"])).alias("n_passed"), "error")


def similar_scored(districts, elevation, rainfall, scorer, n=K.SIMILAR_TOP_N):
    """Top-N similar districts, each scored as a moderate-slope loamy site."""
    top = SIM.similar_districts(districts, elevation, rainfall, n)
    inp = top.select("rank", F.col("elevation").cast("double").alias("Elevation"),
                     F.lit(K.SIMILAR_SLOPE).alias("Slope"), F.col("annual_rainfall").cast("double").alias("Rainfall"),
                     F.lit(K.SIMILAR_SOIL).alias("Soil_Type"))
    s = S.score_single(inp, scorer).select(
        "rank", F.coalesce("label", F.lit("N/A")).alias("Predicted_Suitability"),
        np_round(F.coalesce("confidence", F.lit(0.0)), 3).alias("Prediction_Confidence"))
    return top.join(F.broadcast(s), "rank")  # both sides hold at most n rows


SIMILAR_SQL = ORACLE["similar_districts"]


@query("similar_scored", "with top as (" + SIMILAR_SQL + f"""),
f as (select *, {Q.npround(Q.ndvi('annual_rainfall'), 4)} as ndvi from top),
p as (select *, {Q.rule_p('elevation', repr(float(K.SIMILAR_SLOPE)), 'annual_rainfall', 'ndvi')} as p from f)
select rank, district_id, state, district, elevation, annual_rainfall, Match_Distance,
 case when p > 6.25e-1 then 'Suitable' else 'Not Suitable' end as Predicted_Suitability,
 {Q.npround('case when p > 6.25e-1 then p else 1e0 - p end', 3)} as Prediction_Confidence
from p""")
def q_similar_scored(spark, sf_dir):
    return similar_scored(fx.districts(spark, sf_dir), 600.0, 800.0, S.RuleScorer())


@query("rf_similar_scored")
def q_rf_similar_scored(spark, sf_dir):
    return similar_scored(fx.districts(spark, sf_dir), 600.0, 800.0, S.ForestScorer(trained(spark, sf_dir).model))


@query("rf_onehot_importances")
def q_rf_onehot_importances(spark, sf_dir):
    cfg = M.ForestConfig(numTrees=10, maxDepth=5, minInstancesPerNode=1, balanced=False)
    return M.onehot_importances(sites(spark, sf_dir), cfg)


def reloaded(spark, sf_dir):
    """The saved and reloaded model, and all sites scored by it (in-sample rows included)."""
    base = shared_path(spark, "registry")
    R.save_run(spark, trained(spark, sf_dir), base)
    model = R.load_model(spark, base)
    return model, S.with_prediction(sites(spark, sf_dir), S.ForestScorer(model)).select(
        F.col("Suitability").alias("y"), F.col(S.P1).alias("p"), F.col("Prediction").alias("pred"))


@query("rf_reload_eval")
def q_rf_reload_eval(spark, sf_dir):
    """Save, reload and re-evaluate on all rows."""
    _, s = reloaded(spark, sf_dir)
    bm = EV.binary_metrics(s).select("accuracy", "f1", "tp", "fp", "fn", "tn")
    return bm.withColumn("roc_auc", EV.roc_auc(s).select("roc_auc").scalar())


@query("rf_reload_confusion")
def q_rf_reload_confusion(spark, sf_dir):
    return EV.confusion_matrix(reloaded(spark, sf_dir)[1])


@query("rf_reload_roc")
def q_rf_reload_roc(spark, sf_dir):
    return EV.roc_points(reloaded(spark, sf_dir)[1])


@query("rf_reload_importances")
def q_rf_reload_importances(spark, sf_dir):
    return M.importances(reloaded(spark, sf_dir)[0])


@query("rf_reload_class_totals", Q.SITES_CTE + """
select Suitability as actual, count(*) as n from sites group by Suitability""")
def q_rf_reload_class_totals(spark, sf_dir):
    """Rows of each class that the reloaded model's confusion matrix counts."""
    return (EV.confusion_matrix(reloaded(spark, sf_dir)[1]).groupBy("actual")
            .agg(F.sum("n").alias("n")).where("n > 0"))


@query("rf_load_or_train")
def q_rf_load_or_train(spark, sf_dir):
    """Policy run twice over the orders table: first trains ('retrained'), then loads ('loaded')."""
    base = shared_path(spark, "registry")
    path = f"{sf_dir.rstrip('/')}/orders.parquet"  # the input the site table derives from
    out = []
    for _ in range(2):
        _, meta, status = R.load_or_train(spark, sites(spark, sf_dir), "site_id", path, base, config=SMALL_FOREST,
                                          cv_folds=0)
        out.append(meta.select(F.lit(status).alias("status"), "n_train", "n_test", "accuracy", "f1", "roc_auc"))
    return out[0].unionByName(out[1])


# ------------------------------------------------------------------- streaming
@query("stream_window_rate", "with " + ",".join([Q.SITES_RAW, Q.SITES_NUM]) + f""",
ev as (select o_orderkey as site_id, o_orderdate as ts from orders),
s as (select sites_num.*, ts from sites_num join ev using (site_id)
      where Elevation is not null and Slope is not null and Rainfall is not null),
p as (select ts, cast({Q.rule_p('Elevation', 'Slope', 'Rainfall', Q.ndvi('Rainfall'))} > 6.25e-1 as integer) as pred from s)
select cast(floor(epoch(ts) / 2592000) * 2592000 as bigint) as window_start_s,
 cast(floor(epoch(ts) / 2592000) * 2592000 + 2592000 as bigint) as window_end_s,
 count(*) as n_sites, count_if(pred = 1) as n_suitable
from p group by 1, 2""")
def q_stream_window_rate(spark, sf_dir):
    """Sites arrive as files (event time = order date); scored on arrival; 30-day suitable counts."""
    from ..streaming import run_to_table, score_stream, windowed_rate
    from ..streaming.scoring import ntz_as_utc
    base = shared_path(spark, "stream")
    src = fx.sites_raw(spark, sf_dir, ("o_orderdate",)).withColumn("ts", ntz_as_utc("o_orderdate")).drop("o_orderdate")
    src.repartition(4, "site_id").write.parquet(f"{base}/in")
    scored_stream = score_stream(spark, f"{base}/in", src.schema, S.RuleScorer(), max_files_per_trigger=2)
    # each file spans all seven years of order dates, so none of them may count as late
    return run_to_table(windowed_rate(scored_stream, "ts", watermark="3000 days"), f"{base}/out", f"{base}/ckpt")


from . import catalog_loads, catalog_reports  # noqa: E402,F401
