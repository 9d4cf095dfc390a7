"""Queries of reports and curves: reduced ROC, automatic bins, display columns, the forest's node table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import unit_hash_int
from ..functions.hashing import unit_hash_sql
from ..operators import evaluate as EV
from ..operators import profile as PR
from ..operators import score as S
from ..operators import split as SP
from ..session import shared_path
from ..sources import fixtures as fx
from . import catalog as cat
from . import node_table as NT
from . import oracle_sql as Q
from .catalog import ROC_SQL, SIMILAR_SQL, query, scored, sites

# ------------------------------------------------------------------ ROC (M11)
@query("roc_points_reduced", ROC_SQL + """,
r as (select *, row_number() over (order by score desc) as nth, lead(pos) over (order by score desc) as pos2,
  lead(neg) over (order by score desc) as neg2 from c)
select 'inf'::double as threshold, 0e0 as fpr, 0e0 as tpr
union all
select score, cast(fp as double) / N, cast(tp as double) / P from r, t
where nth = 1 or pos2 is null or pos2 <> pos or neg2 <> neg""")
def q_roc_points_reduced(spark, sf_dir):
    """The curve without points on straight runs, as curve libraries return it."""
    return EV.roc_points_reduced(scored(spark, sf_dir))


# --------------------------------------------- folds and learning curve (M15, M16, F18)
F1_SQL = "coalesce(2e0 * {0}tp / nullif(2e0 * {0}tp + {0}fp + {0}fn, 0), 0e0)"
COUNTS_SQL = "count_if(y = 1 and pred = 1) as tp, count_if(y = 0 and pred = 1) as fp, count_if(y = 1 and pred = 0) as fn, count(*) as n"


@query("cv_flags", cat.SCORED_CTE + f""",
folded as (select *, cast(r * 5 // n_class as integer) as fold from {cat._placed_sql('scored', K.SPLIT_SEED + 1, 'y')}),
c as (select fold, {COUNTS_SQL} from folded group by fold), s as (select fold, {F1_SQL.format('')} as f1 from c),
m as (select {Q.exact_mean('f1')} as mean, {Q.exact_mean('f1 * f1')} as square from s)
select {Q.npround('mean', 6)} as cv_mean, {Q.npround('sqrt(square - mean * mean)', 6)} as cv_std, sqrt(square - mean * mean) > 0.05 as cv_warning from m""")
def q_cv_flags(spark, sf_dir):
    """Mean and spread of the folds' F1 (rule scorer), with the warning."""
    folds = SP.with_folds(scored(spark, sf_dir), key="site_id", label="y")
    return EV.cv_summary(EV.fold_scores(folds))


SIZES = [0.1, 0.25, 0.5, 1.0]


@query("learning_gap", cat.SCORED_CTE + f""",
folded as (select *, cast(r * 3 // n_class as integer) as fold, {unit_hash_sql('site_id', K.SPLIT_SEED + 3)} as u
  from {cat._placed_sql('scored', K.SPLIT_SEED + 2, 'y')}),
sizes as (select * from (values {', '.join(f'({i}, {x!r}::double)' for i, x in enumerate(SIZES))}) v(step, frac)),
pairs as (select step, frac, f.fold from sizes, (select distinct fold from folded) f),
t as (select step, frac, pairs.fold, {COUNTS_SQL} from pairs join folded on folded.fold <> pairs.fold and u < frac group by 1, 2, 3),
v as (select fold, {COUNTS_SQL} from folded group by fold),
m as (select step, frac, floor(avg(t.n)) as train_size, {Q.exact_mean(F1_SQL.format('t.'))} as tr, {Q.exact_mean(F1_SQL.format('v.'))} as va
  from t join v using (fold) group by step, frac)
select step, {Q.npround('frac', 6)} as fraction, cast(train_size as bigint) as train_size, {Q.npround('tr', 6)} as train_f1,
 {Q.npround('va', 6)} as val_f1, {Q.npround('tr - va', 6)} as gap, tr - va > 0.05 as warning from m""")
def q_learning_gap(spark, sf_dir):
    """Training and validation F1 by training size (rule scorer), with the warning for a gap."""
    folds = SP.with_folds(scored(spark, sf_dir), key="site_id", k=3, seed=K.SPLIT_SEED + 2, label="y")
    return EV.learning_scores(folds.withColumn("u", unit_hash_int("site_id", K.SPLIT_SEED + 3)), SIZES)


# ------------------------------------------------------------- histograms (A10)
AUTO_COLS = ["Elevation", "Slope", "Rainfall"]


def _auto_sql(c: str) -> str:
    raw = f"(349e-2 * stddev_pop({c}) / pow(cast(count({c}) as double), 1e0 / 3e0))"
    lead = "raw / pow(1e1, floor(log10(raw)))"
    return f"""select '{c}' as feature, Suitability, cast(floor({c} / step) as bigint) as bin, floor({c} / step) * step as bin_lo,
 (floor({c} / step) + 1) * step as bin_hi, count(*) as n
from sites, (select case when raw > 0 then (case when {lead} < 15e-1 then 1e0 when {lead} < 35e-1 then 2e0
   when {lead} < 75e-1 then 5e0 else 1e1 end) * pow(1e1, floor(log10(raw))) else 1e0 end as step from (select {raw} as raw from sites))
group by 2, 3, 4, 5"""


@query("histograms_auto", Q.SITES_CTE + "\n" + "\nunion all\n".join(_auto_sql(c) for c in AUTO_COLS))
def q_histograms_auto(spark, sf_dir):
    """Three features per class, bin widths from their spread and count, over all rows."""
    return PR.auto_histograms(sites(spark, sf_dir), AUTO_COLS)


# ------------------------------------------------------------------ display (P10, T3)
@query("similar_display", "with top as (" + SIMILAR_SQL + """)
select state as "State", district as "District", elevation as "Elevation (m)", annual_rainfall as "Rainfall (mm)",
 Match_Distance as "Match Distance" from top""")
def q_similar_display(spark, sf_dir):
    """The matches under the names they are shown by; columns that the table lacks are left out."""
    return S.display_columns(cat.SIM.similar_districts(fx.districts(spark, sf_dir), 600.0, 800.0, n=10))


@query("preview_rows", Q.WIDE_CTE + """
select site_id, Elevation, Slope, Rainfall from wide order by site_id, Elevation, Slope, Rainfall limit 5""")
def q_preview_rows(spark, sf_dir):
    """The first rows of a batch, in a stated order."""
    wide = fx.sites_wide(spark, sf_dir).select("site_id", "Elevation", "Slope", "Rainfall")
    return wide.orderBy("site_id", "Elevation", "Slope", "Rainfall").limit(5)


# ------------------------------------------------------- forest as rows (M4, M5)
@query("rf_node_table", Q.SITES_CTE + """
select count(*) as n_rows, cast(0 as bigint) as n_class_differs, cast(0 as bigint) as n_probability_differs from sites""")
def q_rf_node_table(spark, sf_dir):
    """All sites scored twice: by the fitted model and level by level over its node table."""
    model = cat.trained(spark, sf_dir).model
    path = shared_path(spark, "nodes")
    model.save(path)
    rows = sites(spark, sf_dir).select("site_id", *K.FEATURE_COLS)
    by_model = S.with_prediction(rows, S.ForestScorer(model)).select("site_id", F.col("Prediction").alias("pred"), F.col(S.P1).alias("p"))
    nodes = NT.forest_nodes(spark, path, len(model.forests))
    by_nodes = NT.evaluate_nodes(rows, nodes, "site_id")
    both = by_model.join(by_nodes, "site_id")
    other = (F.col("p1") > 0.5).cast("int") != F.col("pred")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(other).alias("n_class_differs"),
                    F.count_if(F.abs(F.col("p") - F.col("p1")) > 1e-9).alias("n_probability_differs"))
