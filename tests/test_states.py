"""Stored districts, roll-up states, duplicates by digest, reduced curves, late rows, node tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sitescope.operators import districts as D
from sitescope.operators import evaluate as EV
from sitescope.operators import profile as PR
from sitescope.operators import profile_state as PS
from sitescope.operators import rollup_state as RS
from sitescope.sources import fixtures as fx
from sitescope.sources import lookup_stored, store_districts, stored_districts
from sitescope.streaming import late_rows, run_wave


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_lookup_is_planned_on_the_layout(spark, tmp_path):
    data = [("10", "a", 1.0), ("10", "b", 2.0), ("x/y=z", "a", 3.0), ("", "a", 4.0), (None, "a", 5.0), ("B", None, 6.0)]
    path = store_districts(spark.createDataFrame(data, "state string, district string, elevation double"), str(tmp_path / "d"))
    for state, district, value in data[:4]:
        assert lookup_stored(spark, path, state, district).select("elevation").first()[0] == value
    assert lookup_stored(spark, path, "no", "a").count() == 0 and stored_districts(spark, path).count() == len(data)
    plan = lookup_stored(spark, path, "10", "b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(state_part" in plan and "EqualTo(district,b)" in plan


def test_any_split_into_loads_gives_the_rollup(spark, tmp_path):
    obs = fx.observations(spark, SF_SMALL).withColumn("rainfall", F.col("rainfall") / 7).repartition(3)
    want = rows(D.rollup_observations(obs))
    rng = random.Random(2)
    for trial, loads in enumerate((1, 5)):
        path = str(tmp_path / f"s{trial}")
        parts = obs.randomSplit([rng.random() + 0.1 for _ in range(loads)], seed=trial)
        for i, part in enumerate(parts):
            RS.add_load(part, path, i)
        RS.add_load(parts[0], path, 0)  # again
        assert rows(RS.rollup_from_state(spark, path)) == want


def test_loads_with_other_columns(spark, tmp_path):
    path = str(tmp_path / "s")
    RS.add_load(spark.createDataFrame([("a", "x"), (None, "y")], "state string, district string"), path, "one")
    RS.add_load(spark.createDataFrame([("a", "x", 2.0), ("b", "y", 4.0)], "state string, district string, rainfall double"), path, "two")
    got = {(r["state"], r["district"]): (r["annual_rainfall"], r["elevation"]) for r in RS.rollup_from_state(spark, path).collect()}
    assert got == {("a", "x"): (730.0, 200.0), ("b", "y"): (1460.0, 200.0)}


def test_duplicates_are_verified(spark, monkeypatch):
    data = [(1, "a"), (1, "a"), (1, "a"), (2, "b"), (2, None), (2, None), (None, "c"), (None, "c"), (3, "d")]
    df = spark.createDataFrame(data, "x int, y string")
    for most in (1 << 20, 0):  # broadcast, shuffled
        monkeypatch.setattr(PR, "MOST_DIGESTS", most)
        assert PR.duplicate_rows(df).first()[0] == 4
        assert PR.duplicate_rows(df, digest=F.lit(7).cast("long")).first()[0] == 4  # every digest collides
        assert PR.duplicate_rows(df, ["x"]).first()[0] == 5
    assert PR.duplicate_rows(df.limit(0)).first()[0] == 0


def test_reduced_curve_keeps_the_area(spark):
    rng = random.Random(4)
    data = [(int(rng.random() < p / 40), p / 40) for p in (rng.randrange(41) for _ in range(600))]
    data += [(1, 2 + i / 100) for i in range(50)] + [(0, 3 + i / 100) for i in range(50)]  # straight runs
    df = spark.createDataFrame(data, "y int, p double")

    def area(points):
        pts = sorted((r["fpr"], r["tpr"]) for r in points.collect())
        return len(pts), sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))

    counts = {}
    for y, p in data:
        counts.setdefault(p, [0, 0])[1 - y] += 1
    steps = [counts[p] for p in sorted(counts, reverse=True)]
    keep = [i for i in range(len(steps)) if i in (0, len(steps) - 1) or steps[i + 1] != steps[i]]
    full, reduced = area(EV.roc_points(df)), area(EV.roc_points_reduced(df))
    assert reduced[0] == len(keep) + 1 < full[0] and abs(full[1] - reduced[1]) < 1e-12
    assert EV.roc_points_reduced(df.where("y = 1 and p > 2.4")).count() == 3


def test_automatic_bins(spark):
    df = spark.createDataFrame([(i % 2, float(i), 5.0, None if i else 1.0) for i in range(1000)], "Suitability int, a double, b double, c double")
    got = PR.auto_histograms(df, ["a", "b", "c"]).collect()
    widths = {r["feature"]: r["bin_hi"] - r["bin_lo"] for r in got}
    assert widths == {"a": 100.0, "b": 1.0, "c": 1.0} and sum(r["n"] for r in got if r["feature"] == "a") == 1000
    steps = [spark.range(1).select(PR.nice_step(F.lit(x))).first()[0] for x in (0.0123, 1.5, 4.0, 99.0, 1.0)]
    assert [round(s, 9) for s in steps] == [0.01, 2.0, 5.0, 100.0, 1.0]


def test_late_rows_and_final_windows(spark, tmp_path):
    day = 86400
    waves = [[(1, 5), (2, 40)], [(3, 200), (4, 10)], [(5, 20), (6, 210), (7, 400)], [(8, 250), (9, 390)]]
    schema = "site_id int, ts timestamp, Prediction int"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], schema).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    for wave in waves:
        frame = spark.createDataFrame([(i, d) for i, d in wave], "site_id int, day int")
        frame.select("site_id", F.timestamp_seconds(F.col("day") * day).alias("ts"), F.lit(1).alias("Prediction")).coalesce(1) \
            .write.mode("append").parquet(path)
        run_wave(stream, "ts", out)
    # watermarks before the waves: none, 40 - 90, 200 - 90, 400 - 90 days
    late = {r["site_id"] for r in late_rows(spark, out, stream.schema).collect()}
    assert late == {5, 8}
    final = {(r["window_start_s"] // day): r["n_sites"] for r in spark.read.parquet(f"{out}/final").collect()}
    assert final == {0: 2, 30: 1, 180: 1, 210: 1}
    run_wave(stream, "ts", out)  # nothing new: nothing changes
    assert spark.read.parquet(f"{out}/final").count() == 4 and late_rows(spark, out, stream.schema).count() == 2


SPREAD = [0.0, -0.0, 1.0, -1.0, 1e300, -1e300, 5e-324, -5e-324, math.inf, -math.inf, 1e-5, 1e-5 * (1 + 1e-15), 3.0, 7.0]


def test_buckets_ascend(spark):
    rng = np.random.default_rng(3)
    values = SPREAD + [float(x) for x in np.concatenate([rng.normal(size=300), 2.0 ** rng.uniform(-1070, 1020, 300), 2.0 ** np.arange(-50, 50)])]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = sorted((r["x"], r["b"]) for r in df.select("x", PS.value_bucket(F.col("x")).alias("b")).collect())
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:])) and {b for x, b in got if x == 0} == {0}
    assert spark.range(1).select(PS.value_bucket(F.lit(float("nan")))).first()[0] is None


@pytest.mark.parametrize("kind", ["normal", "narrow", "ties", "mixed"])
def test_exact_quartiles_and_fences(spark, kind):
    rng = np.random.default_rng(8)
    x = {"normal": rng.normal(50, 20, 4001), "narrow": 1.7e9 + rng.random(4001), "ties": rng.integers(0, 4, 4001) * 1.0,
         "mixed": np.concatenate([rng.normal(0, 1, 2000), rng.exponential(1e6, 2001)])}[kind]
    df = spark.createDataFrame([(float(v), None) for v in x] + [(None, 1.0), (float("nan"), None)], "x double, y double").repartition(4)
    q1, q3 = np.percentile(x, [25, 75])
    got = {r["column"]: r for r in PR.iqr_outliers(df, keep_zero=True).collect()}
    assert (got["x"]["q1"], got["x"]["q3"]) == pytest.approx((q1, q3), rel=1e-15)
    lo, hi = got["x"]["lower"], got["x"]["upper"]
    assert got["x"]["n_outliers"] == int(((x < lo) | (x > hi)).sum()) and got["y"]["n_outliers"] == 0
    deciles = PR.quantiles(df, ["x"], [0.0, 0.1, 0.5, 0.9, 1.0])["x"]
    assert deciles == pytest.approx(list(np.percentile(x, [0, 10, 50, 90, 100])), rel=1e-14)


def test_states_of_loads_add_up(spark, tmp_path):
    rng = random.Random(5)
    data = [(rng.gauss(3, 9) if rng.random() < 0.9 else None, rng.choice("ab") if rng.random() < 0.8 else None, rng.randrange(2)) for _ in range(900)]
    data += data[:40]
    df = spark.createDataFrame(data, "x double, name string, Suitability int").repartition(3)
    path = str(tmp_path / "profile")
    parts = [spark.createDataFrame(data[i::4], df.schema) for i in range(4)]
    for i in (0, 1, 2, 3, 2):
        PS.add_profile(parts[i], path, i)
    state = PS.stored_profile(spark, path)
    assert rows(PS.merge_states(state)) == rows(PS.merge_states(PS.profile_state(df)))
    assert rows(PR.quality_report(df, state=state)) == rows(PR.quality_report(df))
    report = {(r["metric"], r["column"]): r["value"] for r in PR.quality_report(df, state=state).collect()}
    assert report["n_rows", None] == 940 and report["n_dupes", None] == 940 - len(set(data))
    assert report["missing", "name"] == sum(r[1] is None for r in data)
    assert report["class_balance", "1"] == sum(r[2] for r in data)


def test_report_reads_its_table_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(5000).select((F.col("id") % 997).cast("double").alias("x"), F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("Suitability"))
    df = df.mapInArrow(counted, df.schema)
    PR.quality_report(df).collect()
    assert read.value == 2 * 5000  # no row repeats: none is read a third time


def test_report_of_empty_and_infinite_columns(spark):
    empty = spark.createDataFrame([], "x double, Suitability int")
    assert {r["metric"]: r["value"] for r in PR.quality_report(empty).collect()}["n_rows"] == 0
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(SPREAD)], "x double, Suitability int")
    assert PR.quality_report(df).count() > 0
    many = spark.createDataFrame([(math.inf, 1)] * 9 + [(1.0, 0)], "x double, Suitability int")
    assert PR.quantiles(many, ["x"], [0.25, 0.75])["x"] == [math.inf, math.inf] and PR.quality_report(many).count() > 0
