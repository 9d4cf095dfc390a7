"""Forest training, scoring paths and the registry (tolerance and smoke checks)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from sitescope.operators import score as S
from sitescope.plans import catalog
from sitescope.plans import model as M
from sitescope.plans import registry as R


@pytest.fixture(scope="module")
def result(spark):
    cfg = M.ForestConfig(numTrees=20, maxDepth=8, minInstancesPerNode=30)
    return M.train_model(catalog.sites(spark, SF_MID), "site_id", cfg, cv_folds=3)


def test_metrics_in_range(result):
    m = result.metrics
    assert m["n_train"] + m["n_test"] > 14000
    assert 0.15 < m["n_test"] / (m["n_train"] + m["n_test"]) < 0.25
    assert m["accuracy"] > 0.8 and m["roc_auc"] > 0.85 and 0 < m["f1"] <= 1
    assert abs(m["overfit_gap"]) < 0.05
    assert len(m["cv_scores"]) == 3 and m["cv_std"] >= 0
    assert result.tables["importances"].count() == 8
    assert result.tables["confusion"].count() == 4


def test_smoke_points(spark, result):
    pts = [(1, 600.0, 8.0, 800.0, "Loamy"), (2, 3000.0, 45.0, 200.0, "Sandy"), (3, 0.0, 0.0, 2000.0, "Loamy"),
           (4, 600.0, 8.0, 800.0, "Gravel")]
    df = spark.createDataFrame(pts, "id long, Elevation double, Slope double, Rainfall double, Soil_Type string")
    rows = {r.id: r for r in S.score_single(df, S.ForestScorer(result.model)).collect()}
    for i in (1, 2, 3):
        assert rows[i].error is None and rows[i].label in ("Suitable", "Not Suitable")
        assert 0.5 <= rows[i].confidence <= 1.0 and len(rows[i].conditions) == 6
    assert rows[4].error.startswith("no soil code for Gravel") and rows[4].prediction is None
    assert rows[3].label == "Suitable"


def test_batch_keeps_inputs(spark, result):
    df = spark.createDataFrame([(450, 5, 900, "Loamy", "x"), (1200, 12, 650, "Clay", "y"), ("bad", 1, 1, "Clay", "z")],
                               "Elevation string, Slope int, Rainfall int, Soil_Type string, note string")
    out = S.score_batch(df, S.ForestScorer(result.model))
    assert "note" in out.columns and out.count() == 2
    r = out.orderBy("note").first()
    assert r.Label in ("Suitable", "Not Suitable") and r.Conf_Tier is not None


def test_registry_roundtrip_and_staleness(spark, result, tmp_path):
    base = str(tmp_path / "reg")
    assert R.load_model(spark, base) is None
    data = str(tmp_path / "data")
    spark.range(3).write.parquet(data)
    assert R.is_model_stale(spark, data, base)
    run_id = R.save_run(spark, result, base)
    assert not R.is_model_stale(spark, data, base)
    model = R.load_model(spark, base)
    assert model is not None
    assert R.latest_run(spark, base).first().run_id == run_id
    assert R.metrics_table(spark, base, "confusion", run_id).count() == 4
    assert not R.is_model_stale(spark, str(tmp_path / "missing"), base)
    import time
    time.sleep(1.1)
    spark.range(3).write.mode("overwrite").parquet(data)
    assert R.is_model_stale(spark, data, base)


def test_similar_scored(spark, result):
    out = catalog.similar_scored(catalog.fx.districts(spark, SF_MID), 600.0, 800.0, S.ForestScorer(result.model))
    rows = out.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 11))
    assert all(r.Predicted_Suitability in ("Suitable", "Not Suitable") for r in rows)


def test_large_partitions_are_dealt_out_and_fits_bounded(spark, monkeypatch):
    """One partition of many rows is cut; fits run one by one; forest and folds are as many, every row counted."""
    df = catalog.sites(spark, SF_MID).coalesce(1)
    rows = df.count()
    asm = M.assembler().transform(df.select(F.col("site_id").alias("_key"), M.K.LABEL_COL, *M.K.FEATURE_COLS))
    assert M.spread(df).rdd.getNumPartitions() == 1  # small: left as read
    cfg = M.ForestConfig(numTrees=4, maxDepth=3, subForests=4)
    wide = M.cross_val_f1(asm, cfg, 2)
    monkeypatch.setattr(M, "ROWS_AT_ONCE", 1)
    threads = []
    run = M._parallel
    monkeypatch.setattr(M, "_parallel", lambda fn, items, n: threads.append(n) or run(fn, items, n))
    assert M.cross_val_f1(asm, cfg, 2) == wide and set(threads) == {1}
    monkeypatch.setattr(M, "PARTITION_ROWS", 1000)
    cut = M.spread(df.select("site_id", M.K.LABEL_COL))
    sizes = [r["count"] for r in cut.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == rows and max(sizes) <= 1010
    r = M.train_model(df, "site_id", cfg, cv_folds=0)
    assert r.metrics["n_train"] + r.metrics["n_test"] == rows and r.model.num_trees == 4


def test_weights_are_literals_and_classes_known(spark):
    """The weights equal the joined ones; rows without a label go; the label names its classes."""
    df = M.assembler().transform(spark.createDataFrame(
        [(i, None if i == 9 else int(i < 3), *[float(i)] * 8) for i in range(10)],
        "_key long, Suitability int, " + ", ".join(f"{c} double" for c in M.K.FEATURE_COLS)))
    got, n = M._weighted(df)
    want = M.SP.with_class_weight(df)
    assert n == 9
    assert sorted(r.weight for r in got.collect()) == sorted(r.weight for r in want.collect())
    assert got.schema[M.K.LABEL_COL].metadata["ml_attr"]["num_vals"] == 2


def test_filtered_scores_run_each_tree_once(spark, result):
    """A filter on class and confidence stays above the forest's score, which equals the mean of the forests' own."""
    scored = S.score_batch(catalog.fx.sites_wide(spark, SF_MID).limit(500), S.ForestScorer(result.model), soil="names")
    kept = scored.where("Prediction in (0, 1) and Confidence between 0.5 and 1").select("site_id")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "UDF" in line]
    assert plan.count("UDF(") <= 2 * len(result.model.forests) + 1 and kept.count() == 500
    rows = result.model.assembler.transform(catalog.sites(spark, SF_MID).limit(50)).select("site_id", "features")
    want, total = {}, result.model.num_trees
    for f in result.model.forests:
        for r in f.copy().transform(rows).collect():  # a copy has no training summary, which holds the session
            want[r.site_id] = want.get(r.site_id, 0.0) + r.probability[1] * (f.getNumTrees / total)
    got = result.model.transform(rows, assembled=True)
    assert got.columns == ["site_id", "probability_1"]
    assert {r.site_id: pytest.approx(r.probability_1, abs=1e-12) for r in got.collect()} == want


def test_fits_read_kept_parts(spark, monkeypatch):
    """The rows' parts are kept beside them: no pass of a fit places its rows by their keys again."""
    plans = []
    run = M._weighted
    monkeypatch.setattr(M, "_weighted", lambda part: plans.append(part._jdf.queryExecution().optimizedPlan().toString()) or run(part))
    df = catalog.sites(spark, SF_MID).limit(3000)
    cfg = M.ForestConfig(numTrees=2, maxDepth=2, subForests=2)
    r = M.train_model(df, "site_id", cfg, cv_folds=2)
    asm = M.assembler().transform(df.select(F.col("site_id").alias("_key"), M.K.LABEL_COL, *M.K.FEATURE_COLS))
    assert M.cross_val_f1(asm, cfg, 2) == r.metrics["cv_scores"]
    above = [plan.split("InMemoryRelation")[0] for plan in plans]
    assert len(above) == 5 and all("Filter" in plan and "%" not in plan for plan in above)


def test_shallow_trees_keep_no_node_ids():
    """Whether rows are walked or their nodes kept is decided by depth; a caller can always walk."""
    def kept(**k):
        return M.ForestConfig(**k).estimator().getCacheNodeIds()
    assert kept(maxDepth=12) and not kept(maxDepth=5) and not kept(maxDepth=12, cacheNodeIds=False)
