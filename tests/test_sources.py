"""File scans (CSV as text), validation errors and sinks."""

import pytest

from sitescope.operators import score as S
from sitescope.sources import (
    batch_template, ensure_min_rows, ensure_not_empty, load_batch, load_districts, load_sites, read_table,
    write_table,
)
from sitescope.sources.validate import SchemaError


def _csv(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_load_sites_csv(spark, tmp_path):
    path = _csv(tmp_path, "sites.csv",
                "Elevation,Slope,Rainfall,Soil_Type,Suitability,Extra\n"
                "600,8,800,Loamy,1,a\n"
                " 3000 ,45,200,Sandy,0,b\n"
                "n/a,1,500,Clay,1,c\n"
                "10,2,1e3,Gravel,1.0,d\n")
    rows = load_sites(spark, path).orderBy("Elevation").collect()
    assert len(rows) == 3 and rows[0].Extra == "d"             # extra columns carried
    assert rows[0].Soil_Type == 1 and rows[0].Soil_Type_Label == "Gravel" and rows[0].Rainfall == 1000.0
    assert rows[2].Elevation == 3000.0 and rows[2].Elevation_Zone == 3


def test_load_sites_missing_columns(spark, tmp_path):
    path = _csv(tmp_path, "bad.csv", "Elevation,Slope\n1,2\n")
    with pytest.raises(SchemaError, match="no column"):
        load_sites(spark, path)


def test_load_districts_csv(spark, tmp_path):
    path = _csv(tmp_path, "d.csv", "state,district,elevation,annual_rainfall\n"
                                   "MG, ri-bhoi ,1000,\nAN,x,,2000\n")
    rows = {r.district: r for r in load_districts(spark, path).collect()}
    assert set(rows) == {"Ri-Bhoi", "X"}
    assert rows["Ri-Bhoi"].annual_rainfall == 0.0 and rows["Ri-Bhoi"].avg_temp == pytest.approx(24.0)
    assert rows["X"].elevation == 0.0 and rows["X"].state == "An" and rows["X"].latitude is None


def test_batch_roundtrip_and_guards(spark, tmp_path):
    out = str(tmp_path / "batch_csv")
    write_table(batch_template(spark), out, fmt="csv")
    b = load_batch(spark, out, fmt="csv")
    scored = S.score_batch(b, S.RuleScorer())
    assert scored.count() == 4
    dest = str(tmp_path / "scored")
    write_table(scored, dest, partition_by="Label")
    assert read_table(spark, dest).count() == 4
    assert ensure_not_empty(b) is b
    with pytest.raises(ValueError, match="training needs"):
        ensure_min_rows(b, 200, "Dataset")
    with pytest.raises(ValueError, match="no rows"):
        ensure_not_empty(b.limit(0))
