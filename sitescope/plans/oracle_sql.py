"""Independent ANSI-SQL formulations of the catalogue queries (run by DuckDB).

These restate each operator's semantics in SQL over the same driver tables; the
correctness gate compares them with the Spark DataFrame results.
"""

from __future__ import annotations

NUM_RE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def coerce(x: str) -> str:
    v = f"(case when regexp_matches(cast({x} as varchar), '{NUM_RE}') then try_cast(trim(cast({x} as varchar)) as double) end)"
    return f"(case when isnan({v}) then null else {v} end)"


def clip(x: str, lo: str = "0e0", hi: str = "1e0") -> str:
    return f"(case when ({x}) is not null then least(greatest(({x}), {lo}), {hi}) end)"


def npround(x: str, d: int) -> str:
    if d == 0:
        return f"round_even(({x}), 0)"
    s = f"1e{d}"
    return f"(round_even(({x})*{s}, 0)/{s})"


def exact_mean(x: str) -> str:
    return f"(cast(sum(cast(({x}) as decimal(38,12))) as double) / nullif(cast(count({x}) as double), 0))"


def ndvi(r: str) -> str:
    return clip(f"2e-1 + ({r})/25e2")


def temperature(e: str) -> str:
    return f"(3e1 - 6e-3*({e}))"


def moisture(r: str, s: str) -> str:
    return f"(({r})/2e3 - ({s})/1e2)"


def zone(e: str) -> str:
    return f"cast(case when ({e})<=5e2 then 0 when ({e})<=15e2 then 1 when ({e})<=25e2 then 2 else 3 end as integer)"


def rule_score(e: str, s: str, r: str, n: str) -> str:
    return (f"({clip(f'1e0 - ({e})/2e3')} + {clip(f'1e0 - ({s})/25e0')} + "
            f"{clip(f'(({r}) - 4e2)/1e3')} + {clip(f'(({n}) - 2e-1)/6e-1')})")


SOIL_CASE = "(case {x} when 'Clay' then 0 when 'Loamy' then 1 when 'Sandy' then 2 when 'Silty' then 3 end)"


def soil_strict(x: str) -> str:
    return SOIL_CASE.format(x=x)


def soil_lenient(x: str) -> str:
    return f"cast(coalesce({soil_strict(x)}, 1) as integer)"


def title(x: str) -> str:
    runs = rf"regexp_extract_all(lower(trim({x})), '(\P{{L}}+|\p{{L}}+)', 1)"
    return (f"(case when {x} is not null then array_to_string(list_transform({runs}, "
            f"lambda r: upper(substr(r, 1, 1)) || substr(r, 2)), '') end)")


SITES_RAW = """
sites_raw as (
 select o_orderkey as site_id,
  case when o_orderkey%97=0 then 'n/a' else cast(cast((o_custkey*37+o_orderkey*11)%30001 as double)/1e1 as varchar) end as Elevation,
  case when o_orderkey%89=0 then null else cast(cast((o_orderkey*7+o_custkey*13)%451 as double)/1e1 as varchar) end as Slope,
  cast(2e2+cast(cast(round(o_totalprice*1e2) as bigint)%18001 as double)/1e1 as varchar) as Rainfall,
  case o_orderkey%5 when 0 then 'Clay' when 1 then 'Loamy' when 2 then 'Sandy' when 3 then 'Silty' else 'Gravel' end as Soil_Type,
  cast((o_custkey*7919+o_orderkey*10473)%2001-1000 as double)/1e3*0.7e0 as noise
 from orders)"""

SITES_NUM = f"""
sites_num as (
 select site_id, {coerce('Elevation')} as Elevation, {coerce('Slope')} as Slope, {coerce('Rainfall')} as Rainfall,
  Soil_Type, noise from sites_raw)"""

SITES_LAB = f"""
sites_lab as (
 select *, cast(({rule_score('Elevation', 'Slope', 'Rainfall', ndvi('Rainfall'))} + noise) > 2.5e0 as integer) as Suitability
 from sites_num)"""

SITES = f"""
sites as (
 select site_id, Elevation, Slope, Rainfall, {soil_lenient('Soil_Type')} as Soil_Type, Soil_Type as Soil_Type_Label,
  Suitability, {temperature('Elevation')} as Temperature, {ndvi('Rainfall')} as NDVI,
  {moisture('Rainfall', 'Slope')} as Soil_Moisture, {zone('Elevation')} as Elevation_Zone, noise
 from sites_lab
 where Elevation is not null and Slope is not null and Rainfall is not null and Suitability is not null)"""

SITES_CTE = "with " + ",".join([SITES_RAW, SITES_NUM, SITES_LAB, SITES])

SITES_WIDE = f"""
sites_wide as (
 select l_orderkey*8+l_linenumber as site_id,
  cast(((l_partkey*37+l_orderkey*11+l_linenumber*101)%30001) as double)/1e1 as Elevation,
  cast(((l_orderkey*7+l_suppkey*13+l_linenumber*29)%451) as double)/1e1 as Slope,
  2e2+cast((cast(round(l_extendedprice*1e2) as bigint)%18001) as double)/1e1 as Rainfall,
  case cast(l_quantity as bigint)%5 when 0 then 'Clay' when 1 then 'Loamy' when 2 then 'Sandy' when 3 then 'Silty' else 'Gravel' end as Soil_Type,
  cast((l_partkey*7919+l_orderkey*10473+l_linenumber*31)%2001-1000 as double)/1e3*0.7e0 as noise
 from lineitem)"""

WIDE_FEAT = f"""
wide as (
 select site_id, Elevation, Slope, Rainfall, {soil_lenient('Soil_Type')} as Soil_Type, Soil_Type as Soil_Type_Label,
  {temperature('Elevation')} as Temperature, {ndvi('Rainfall')} as NDVI,
  {moisture('Rainfall', 'Slope')} as Soil_Moisture, {zone('Elevation')} as Elevation_Zone, noise
 from sites_wide)"""

WIDE_CTE = "with " + ",".join([SITES_WIDE, WIDE_FEAT])

OBSERVATIONS = """
observations as (
 select n_name as state, concat(c_mktsegment,' ',cast(c_custkey%7 as varchar)) as district,
  cast((c_custkey*53+n_nationkey*211)%2700 as double) as elevation,
  cast(o_orderkey%161 as double)/1e1 as rainfall,
  5e0+cast(o_orderkey%250 as double)/1e1 as avg_temp,
  8e0+cast((c_nationkey*7919)%26000 as double)/1e3 as latitude,
  69e0+cast((c_nationkey*104729)%26000 as double)/1e3 as longitude
 from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey)"""

DISTRICTS = """
districts as (
 select s_suppkey as district_id, n_name as state, concat('District ',cast(s_suppkey as varchar)) as district,
  cast((s_suppkey*53)%2700 as double) as elevation,
  cast(278+(s_suppkey*977)%5400 as double) as annual_rainfall
 from supplier join nation on s_nationkey=n_nationkey)"""


def rule_p(e="Elevation", s="Slope", r="Rainfall", n="NDVI") -> str:
    return f"({rule_score(e, s, r, n)} / 4e0)"


WIDE_SCORED = f"""
wide_scored as (
 select *, case when pred = 1 then p else 1e0 - p end as conf from (
  select *, cast(p > 6.25e-1 as integer) as pred from (select *, {rule_p()} as p from wide)))"""


def tier(c: str) -> str:
    return (f"(case when {c} >= 8.5e-1 then 'High Confidence' when {c} >= 6.5e-1 then 'Moderate Confidence' "
            f"else 'Low Confidence — Borderline Case' end)")


SCORED = f"""
scored as (
 select site_id, Suitability as y, {rule_p()} as p, cast({rule_p()} > 6.25e-1 as integer) as pred from sites)"""
