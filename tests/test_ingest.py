"""Checked loads: rejects with reasons, counts from the writing job, one scan."""

import pytest
from pyspark.sql import functions as F

from sitescope import constants as K
from sitescope.operators.clean import clean_sites
from sitescope.sources import ingest as I
from sitescope.sources import read_table
from sitescope.sources.validate import SchemaError

HEAD = "Elevation,Slope,Rainfall,Soil_Type,Suitability,Extra"
LINES = ["600,8,800,Loamy,1,a", " 3000 ,45,200,Sandy,0,b", "n/a,1,500,Clay,1,c", "10,2,1e3,Gravel,1.0,d", "10,2,,Clay,x,e",
         "1,2,3,Clay,7,f", "1,2,3,Clay,-0.7,g", "1,2,3,Clay,1,h,i", "1,2,3", "1,2,3,Clay,1e30,j"]


def csv(tmp_path, lines, head=HEAD, name="sites.csv"):
    (tmp_path / name).write_text("\n".join([head, *lines]) + "\n")
    return str(tmp_path / name)


def test_kept_and_rejected_rows(spark, tmp_path):
    load = I.ingest_sites(spark, csv(tmp_path, LINES), out=str(tmp_path / "out"))
    rejects = {r["Extra"] or r["record"]: (r["reason"], r["detail"]) for r in load.rejects.collect()}
    assert rejects == {"c": (I.MISSING, "Elevation"), "e": (I.MISSING, "Rainfall,Suitability"), "f": (I.BAD_LABEL, "7"),
                       "h": (I.CORRUPT, None), "1,2,3": (I.CORRUPT, None), "j": (I.MISSING, "Suitability")}
    assert {r["record"] for r in load.rejects.where("reason = 'corrupt record'").collect()} == {"1,2,3,Clay,1,h,i", "1,2,3"}
    rows = {r["Extra"]: r for r in load.rows.collect()}
    assert set(rows) == {"a", "b", "d", "g"} and rows["g"]["Suitability"] == 0 and rows["d"]["Rainfall"] == 1000.0
    assert rows["d"]["Soil_Type"] == 1 and rows["d"]["Soil_Type_Label"] == "Gravel"
    c = load.counts
    assert (c["rows_in"], c["kept"], c["dropped"], c["n_corrupt"], c["n_missing"], c["n_label"]) == (10, 4, 6, 2, 3, 1)
    assert (c["missing_Elevation"], c["missing_Rainfall"], c["missing_Suitability"]) == (1, 1, 2)
    assert (c["class_0"], c["class_1"]) == (2, 2)
    assert load.warnings() == ["6 of 10 rows were rejected", "class 0 has 2 rows only; a model of it may be unreliable",
                               "class 1 has 2 rows only; a model of it may be unreliable"]


def test_kept_rows_equal_the_plain_cleaning(spark, tmp_path):
    lines = [line for line in LINES if line[-1] not in "fij" and line != "1,2,3"]
    path = csv(tmp_path, lines)
    want = clean_sites(read_table(spark, path)).collect()
    got = I.ingest_sites(spark, path, out=str(tmp_path / "out")).rows
    assert sorted(map(str, got.select(*want[0].__fields__).collect())) == sorted(map(str, want))


def test_codes_and_gaps_are_decided_by_the_load(spark, tmp_path):
    head = "Elevation,Slope,Rainfall,Soil_Type,Suitability,Temperature,NDVI,part,reason"
    path = csv(tmp_path, ["600,8,800,0,1,20.5,0.5,p,q", "500,5,900,2,0,,0.25,p,q", "x,5,900,,0,1,,p,q"], head)
    load = I.ingest_sites(spark, path, out=str(tmp_path / "out"))
    rows = load.rows.orderBy("Elevation").collect()
    assert [r["Soil_Type"] for r in rows] == [2, 0] and [r["Soil_Type_Label"] for r in rows] == ["Sandy", "Clay"]
    assert [r["NDVI"] for r in rows] == [0.25, 0.5]                      # its only gap is in a rejected row
    assert [round(r["Temperature"], 6) for r in rows] == [27.0, 26.4]      # a gap in a kept row: derived whole
    assert [(r["part"], r["reason"]) for r in rows] == [("p", "q")] * 2     # columns that share the load's names
    plan = load.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" not in plan


def test_one_scan_with_metrics(spark, tmp_path):
    df, corrupt = I.scan_records(spark, csv(tmp_path, LINES))
    staged, _, _ = I.stage_load(df, corrupt)
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan and "Exchange" not in plan


def test_whole_table_rejected_and_guards(spark, tmp_path):
    with pytest.raises(ValueError, match="labels other than 0 and 1"):
        I.ingest_sites(spark, csv(tmp_path, LINES), out=str(tmp_path / "o1"), bad_label="reject")
    with pytest.raises(ValueError, match="no rows"):
        I.ingest_sites(spark, csv(tmp_path, []), out=str(tmp_path / "o2"))
    with pytest.raises(SchemaError):
        I.ingest_sites(spark, csv(tmp_path, ["1,2"], "Elevation,Slope", "b.csv"))
    load = I.ingest_sites(spark, csv(tmp_path, ["n/a,1,2,Clay,1,a"], name="c.csv"), out=str(tmp_path / "o3"))
    assert load.rows.count() == 0 and load.rejects.count() == 1 and load.report().where("warning").count() == 1


def test_common_classes_give_no_warning(spark, tmp_path):
    lines = [f"{i},2,{300 + i},Clay,{i % 2},x" for i in range(2 * K.RARE_CLASS_ROWS)]
    load = I.ingest_sites(spark, csv(tmp_path, lines), out=str(tmp_path / "out"))
    assert load.warnings() == [] and load.report().where("warning").count() == 0


def test_batch_and_districts(spark, tmp_path):
    path = csv(tmp_path, ["600,8,800,Loamy", "x,8,800,Loamy", "1,2"], "Elevation,Slope,Rainfall,Soil_Type")
    load = I.ingest_batch(spark, path, out=str(tmp_path / "b"))
    assert load.rows.count() == 1 and load.counts["n_missing"] == 1 and load.counts["n_corrupt"] == 1
    path = csv(tmp_path, ["MG, ri-bhoi ,1000,", "AN,x,,2000", "AN"], "state,district,elevation,annual_rainfall", "d.csv")
    load = I.ingest_districts(spark, path, out=str(tmp_path / "d"))
    assert {r["district"] for r in load.rows.collect()} == {"Ri-Bhoi", "X"} and load.counts["missing_elevation"] == 1
    assert load.rejects.select("record").first()[0] == "AN"


def test_json_and_parquet_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"Elevation": "1", "Slope": "2", "Rainfall": "3", "Soil_Type": "Clay", "Suitability": "1"}\n{"Elev\n')
    schema = "Elevation string, Slope string, Rainfall string, Soil_Type string, Suitability string"
    load = I.ingest_sites(spark, str(tmp_path / "s.json"), out=str(tmp_path / "j"), schema=schema)
    assert load.rows.count() == 1 and load.counts["n_corrupt"] == 1
    df = spark.createDataFrame([(1.0, 2.0, float("nan"), 3, 1), (1.0, 2.0, 3.0, 3, 1)],
                               "Elevation double, Slope double, Rainfall double, Soil_Type int, Suitability int")
    df.write.parquet(str(tmp_path / "p"))
    load = I.ingest_sites(spark, str(tmp_path / "p"), out=str(tmp_path / "q"))
    assert load.rows.select("Soil_Type_Label").first()[0] == "Silty" and load.counts["missing_Rainfall"] == 1
    assert load.rows.where(F.col("Elevation_Zone").isNull()).count() == 0
