"""Tree nearest-district search equals brute force, including hot cells and duplicates."""

import math
import random

from sitescope.operators import similar as SIM


def brute(districts, targets, n):
    es = [d[3] or 0.0 for d in districts]
    rs = [d[4] or 0.0 for d in districts]
    emin, rmin = min(es), min(rs)
    erng = (max(es) - emin) or 1.0
    rrng = (max(rs) - rmin) or 1.0
    out = {}
    for tid, te, tr in targets:
        cand = []
        for did, st, dn, e, r in districts:
            de = ((e or 0.0) - emin) / erng - (te - emin) / erng
            dr = ((r or 0.0) - rmin) / rrng - (tr - rmin) / rrng
            cand.append((math.sqrt(de * de + dr * dr), st, dn, did))
        cand.sort()
        out[tid] = [c[3] for c in cand[:n]]
    return out


def run(spark, districts, targets, n, leaf=None):
    dd = spark.createDataFrame(districts, "district_id long, state string, district string, elevation double, annual_rainfall double")
    tt = spark.createDataFrame(targets, "target_id long, elevation double, rainfall double")
    got = {}
    for r in SIM.similar_many(dd, tt, n=n, leaf=leaf).orderBy("target_id", "rank").collect():
        got.setdefault(r.target_id, []).append(r.district_id)
    return got


def test_grid_equals_brute_force_skewed(spark):
    rnd = random.Random(7)
    districts = []
    for i in range(300):
        if i < 100:      # a third of all districts in one hot spot (many exact duplicates)
            e, r = 1000.0 + (i % 3), 900.0
        elif i < 150:
            e, r = rnd.uniform(0, 100), rnd.uniform(300, 400)
        else:
            e, r = rnd.uniform(0, 3000), rnd.uniform(200, 5000)
        districts.append((i, f"S{i % 7}", f"D{i}", e, r if i != 5 else None))
    targets = [(t, rnd.uniform(-500, 3500), rnd.uniform(0, 6000)) for t in range(60)]
    targets += [(100, 1000.0, 900.0), (101, 50.0, 350.0)]
    want = brute(districts, targets, 10)
    assert run(spark, districts, targets, 10) == want
    assert run(spark, districts, targets, 10, leaf=12) == want


def test_fewer_districts_than_n(spark):
    districts = [(1, "A", "x", 10.0, 20.0), (2, "A", "y", 30.0, 40.0)]
    targets = [(1, 0.0, 0.0)]
    assert run(spark, districts, targets, 10) == {1: [1, 2]}


def test_dense_distinct_cluster(spark):
    rnd = random.Random(11)
    districts = [(i, "S", f"D{i:03d}", 1500.0 + rnd.random(), 800.0 + rnd.random()) for i in range(120)]
    districts += [(1000 + i, "T", f"E{i:03d}", rnd.uniform(0, 3000), rnd.uniform(200, 5000)) for i in range(240)]
    targets = [(t, rnd.uniform(1400, 1600), rnd.uniform(700, 900)) for t in range(30)]
    targets += [(100 + t, rnd.uniform(0, 3000), rnd.uniform(200, 5000)) for t in range(30)]
    assert run(spark, districts, targets, 10, leaf=20) == brute(districts, targets, 10)


def test_diagonal_districts(spark):
    rnd = random.Random(5)
    districts = []
    for i in range(600):
        e = rnd.uniform(0, 3000)
        districts.append((i, "S", f"D{i:03d}", e, 200 + 1.5 * e + rnd.uniform(-5, 5)))
    targets = [(t, rnd.uniform(0, 3000), rnd.uniform(200, 5000)) for t in range(60)]
    assert run(spark, districts, targets, 10, leaf=20) == brute(districts, targets, 10)


def test_tied_axis_and_missing_target(spark):
    districts = [(i, "S", f"D{i:03d}", 700.0, float(i % 90)) for i in range(400)]
    districts += [(1000 + i, "T", f"E{i:03d}", float(i), 45.0) for i in range(100)]
    targets = [(1, 700.0, 44.5), (2, 50.0, 45.0), (3, 400.0, 10.0)]
    got = run(spark, districts, [*targets, (4, None, 10.0)], 10, leaf=20)
    assert got == brute(districts, targets, 10)
    assert run(spark, [], targets, 10) == {}


def test_targets_are_exchanged_once(spark):
    """Broadcast levels and districts leave the targets where their key dealt them: one exchange, of narrow rows."""
    rnd = random.Random(3)
    districts = [(i, "S", f"D{i:03d}", rnd.uniform(0, 3000), rnd.uniform(200, 5000)) for i in range(400)]
    dd = spark.createDataFrame(districts, "district_id long, state string, district string, elevation double, annual_rainfall double")
    tt = spark.createDataFrame([(t, rnd.uniform(0, 3000), rnd.uniform(200, 5000)) for t in range(50)],
                               "target_id long, elevation double, rainfall double")
    out = SIM.similar_many(dd, tt, n=5, leaf=20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    by_target = [line for line in plan.splitlines() if " Exchange hashpartitioning(target_id" in line or "-Exchange hashpartitioning(target_id" in line]
    assert len(by_target) == 1 and "REPARTITION_BY_NUM" in by_target[0], plan
    assert "hashpartitioning(_node" not in plan
