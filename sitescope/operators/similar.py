"""Nearest districts in min-max-scaled (elevation, annual_rainfall) space.

The scaler is fitted on the districts with one aggregate that Spark runs once
as a scalar subquery; the query point is scaled with the same parameters (not
clipped). One target: a distance column and a top-N
(``TakeOrderedAndProject``: each partition keeps N rows, no global sort). Many
targets: an exact tree search (see ``similar_many``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import np_round
from ..session import materialize
from .ranges import width

FEATURES = ("elevation", "annual_rainfall")
FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
LEAF = 64  # districts of a leaf, at most
BROADCAST_NODES = 4_096  # levels of the tree with so many nodes at most are broadcast
BROADCAST_POINTS = 100_000  # districts that remain, if so many at most, are broadcast
PART_TARGETS = 10_000  # targets of a partition


def minmax_scalar(districts: DataFrame, cols=FEATURES):
    """One scalar subquery: struct of min/max per column (missing -> 0) and the row count."""
    aggs = []
    for c in cols:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        aggs += [F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max")]
    aggs.append(F.count(F.lit(1)).alias("n_rows"))
    return districts.select(F.struct(*aggs)).scalar()


def minmax_params(districts: DataFrame, cols=FEATURES, attached: str = "_mm"):
    """Attach the scaler parameters once as a struct column ``attached``.

    Returns (frame, {col: (min, range)} Columns reading that struct); zero
    range -> 1. Referencing the attached column (not the subquery) keeps one
    subquery execution per plan.
    """
    d = districts.withColumn(attached, minmax_scalar(districts, cols))
    out = {}
    for c in cols:
        lo, hi = F.col(f"{attached}.{c}_min"), F.col(f"{attached}.{c}_max")
        out[c] = (lo, F.coalesce(F.when(hi - lo != 0, hi - lo), F.lit(1.0)))
    out["n_rows"] = F.col(f"{attached}.n_rows")
    return d, out


def scaled(x, lo, rng):
    return (x - lo) / rng


def minmax_scale(districts: DataFrame, cols=FEATURES) -> DataFrame:
    """Add ``<col>_scaled`` columns (missing -> 0 before scaling)."""
    d, p = minmax_params(districts, cols)
    return d.withColumns({
        f"{c}_scaled": scaled(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), *p[c]) for c in cols}).drop("_mm")


def _distance(p, qe, qr):
    e = F.coalesce(F.col("elevation").cast("double"), F.lit(0.0))
    r = F.coalesce(F.col("annual_rainfall").cast("double"), F.lit(0.0))
    de = scaled(e, *p["elevation"]) - scaled(qe, *p["elevation"])
    dr = scaled(r, *p["annual_rainfall"]) - scaled(qr, *p["annual_rainfall"])
    return F.sqrt(de * de + dr * dr)


def similar_districts(districts: DataFrame, elevation: float, rainfall: float, n: int = K.SIMILAR_TOP_N,
                      tie_keys=("state", "district")) -> DataFrame:
    """Top-N districts nearest to one (elevation, rainfall) point, 1-based ``rank``.

    Distance is rounded to 4 dp for display; ties break on (state, district).
    With fewer than two districts the table comes back unranked by distance
    (Match_Distance NULL), as the reference returns it unchanged.
    """
    missing = [c for c in FEATURES if c not in districts.columns]
    if missing:
        raise ValueError(f"district table lacks {missing}")
    d, p = minmax_params(districts)
    dist = _distance(p, F.lit(float(elevation)), F.lit(float(rainfall)))
    d = d.withColumn("_dist", F.when(p["n_rows"] >= 2, dist)).drop("_mm")
    top = d.orderBy(F.col("_dist").asc_nulls_last(), *tie_keys).limit(n)
    w = Window.orderBy(F.col("_dist").asc_nulls_last(), *tie_keys)  # over <= n rows
    return top.select(F.row_number().over(w).alias("rank"), *districts.columns,
                      np_round("_dist", 4).alias("Match_Distance"))


def _leaves(points: DataFrame, leaf: int) -> tuple[DataFrame, int]:
    """(points with a long ``_path``, levels): a tree whose nodes are cut into FANOUT parts of
    about equal count, by x and y in turn, until none holds more than ``leaf`` points.

    A level's cuts are approximate quantiles within each node, kept as a table beside
    the points, so a dense or diagonal cluster is cut as finely as it needs. Each
    level adds four bits to the path.
    """
    now, levels, idle = materialize(points.withColumn("_path", F.lit(0).cast("long"))), 0, 0
    nodes = materialize(now.groupBy("_path").agg(F.count(F.lit(1)).alias("_m")))
    probs = [i / FANOUT for i in range(1, FANOUT)]
    while idle < 2 and levels < 15:
        full = nodes.where(F.col("_m") > leaf).select("_path")
        if full.isEmpty():
            break
        axis = "_dx" if levels % 2 == 0 else "_dy"
        cuts = now.join(full, "_path", "left_semi").groupBy("_path").agg(F.percentile_approx(axis, probs, 1000).alias("_cuts"))
        part = F.coalesce(F.size(F.filter(F.array_distinct("_cuts"), lambda e: e < F.col(axis))), F.lit(0))
        now = materialize(now.join(cuts, "_path", "left").withColumn(
            "_path", F.col("_path") * FANOUT + F.greatest(part, F.lit(0))).drop("_cuts"))
        before, nodes, levels = nodes, materialize(now.groupBy("_path").agg(F.count(F.lit(1)).alias("_m"))), levels + 1
        idle = idle + 1 if nodes.count() == before.count() else 0
    return now, levels


def similar_many(districts: DataFrame, targets: DataFrame, n: int = K.SIMILAR_TOP_N,
                 target_key: str = "target_id", district_key: str = "district_id",
                 leaf: int | None = None) -> DataFrame:
    """Exact top-N nearest districts for every target, without all pairs.

    Districts lie in the leaves of a tree (``_leaves``) whose nodes know their
    number of districts and the box around them. All targets go down the tree
    together, a level per step. At each step a target's N-th distance is at most
    the farthest corner of the nearest boxes that hold N districts together, and
    boxes wholly beyond that go. What remains after the last level is a few
    leaves per target, whose districts are scored. Boxes bound distances exactly,
    ties included, so the result is exact whatever the cuts.

    Districts at one exact position are pruned to the first N by name first: no
    target can tell them apart. The top-N per target is a ``row_number`` with a
    limit, which Spark evaluates partially before the shuffle
    (``WindowGroupLimit``). A target without a coordinate gets no rows.

    Targets are dealt out by their key once, before they meet any box. Broadcast
    joins leave them there, so the windows per target need no further exchange:
    only the narrow targets are shuffled, not their boxes and districts. Levels of
    more nodes, and more districts, than may be broadcast are joined by shuffles.
    """
    mm = minmax_scalar(districts).alias("_mm")
    params = districts.sparkSession.range(1).select(mm).first()["_mm"]  # one row of 5 numbers

    def scale(value, c):
        lo, hi = float(params[f"{c}_min"] or 0.0), float(params[f"{c}_max"] or 0.0)
        return scaled(value, F.lit(lo), F.lit((hi - lo) or 1.0))

    pts = districts.withColumns({
        "_dx": scale(F.coalesce(F.col("elevation").cast("double"), F.lit(0.0)), "elevation"),
        "_dy": scale(F.coalesce(F.col("annual_rainfall").cast("double"), F.lit(0.0)), "annual_rainfall")})
    wpos = Window.partitionBy("_dx", "_dy").orderBy("state", "district", district_key)
    pts = pts.withColumn("_nth", F.row_number().over(wpos)).where(F.col("_nth") <= n).drop("_nth")
    pts, levels = _leaves(pts, leaf or max(LEAF, 2 * n))

    # from the leaves up: per level a row per node, with its boxes one level down
    boxes = pts.groupBy(F.col("_path").alias("_node")).agg(
        F.count(F.lit(1)).alias("m"), *[f(c).alias(name) for c in ("_dx", "_dy") for f, name in (
            (F.min, f"{c}0"), (F.max, f"{c}1"))])
    kids = []
    for _ in range(levels):
        up = F.shiftright("_node", FANOUT_BITS)
        kids.append(boxes.groupBy(up.alias("_up")).agg(F.collect_list(F.struct(*boxes.columns)).alias("_kids")))
        boxes = boxes.groupBy(up.alias("_node")).agg(
            F.sum("m").alias("m"), *[F.min(c).alias(c) for c in ("_dx0", "_dy0")],
            *[F.max(c).alias(c) for c in ("_dx1", "_dy1")])

    # every target starts at the root; as a computed 0 the node stays a join key, where a literal would be folded away
    front = targets.select(target_key, scale(F.col("elevation").cast("double"), "elevation").alias("_tx"),
                           scale(F.col("rainfall").cast("double"), "annual_rainfall").alias("_ty"),
                           F.pmod(F.hash(target_key), F.lit(1)).cast("long").alias("_node"))
    # a stated number: the targets are small here, but meet up to 16 boxes of each node
    front = front.repartition(max(width(targets), -(-targets.count() // PART_TARGETS)), target_key)
    own = Window.partitionBy(target_key)
    nearest = own.orderBy("_far", "_node").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def away(dx, dy):
        return F.sqrt(dx * dx + dy * dy)

    for depth, level in enumerate(reversed(kids)):
        if FANOUT ** depth <= BROADCAST_NODES:  # so many rows at most, of FANOUT boxes each
            level = F.broadcast(level)
        seen = front.join(level, front["_node"] == level["_up"]).select(target_key, "_tx", "_ty", F.inline("_kids"))
        short = [F.greatest(F.col(f"{d}0") - F.col(t), F.col(t) - F.col(f"{d}1"), F.lit(0.0)) for d, t in (("_dx", "_tx"), ("_dy", "_ty"))]
        long = [F.greatest(F.abs(F.col(f"{d}0") - F.col(t)), F.abs(F.col(f"{d}1") - F.col(t))) for d, t in (("_dx", "_tx"), ("_dy", "_ty"))]
        seen = seen.withColumns({"_close": away(*short), "_far": away(*long)})
        seen = seen.withColumn("_bound", F.when(F.sum("m").over(nearest) >= n, F.col("_far")))
        seen = seen.withColumn("_bound", F.min("_bound").over(own))
        front = seen.where(F.col("_bound").isNull() | (F.col("_close") <= F.col("_bound"))).select(
            target_key, "_tx", "_ty", "_node")
    if not levels or pts.count() <= BROADCAST_POINTS:  # no levels: the root is a leaf of few districts
        pts = F.broadcast(pts)
    found = front.join(pts, front["_node"] == pts["_path"]).withColumn(
        "_d", away(F.col("_dx") - F.col("_tx"), F.col("_dy") - F.col("_ty"))).where("_d is not null")
    order = own.orderBy("_d", "state", "district", district_key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(
        target_key, "rank", district_key, "state", "district", "elevation", "annual_rainfall",
        np_round("_d", 4).alias("Match_Distance"))
