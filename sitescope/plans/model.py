"""Random-forest training and evaluation with MLlib.

Training assembles the 8 features once into a persisted frame that the main
fit, the cross-validation fits and the learning-curve fits share; MLlib grows
all trees of a forest together, one level per pass over the data. Every
metric is a Spark aggregate over the scored test part; only metric rows reach
the driver.

Each fit keeps its own binned copy of its rows, so the number of fits that run
at once falls as the rows grow (``ROWS_AT_ONCE``), and large partitions are
dealt out anew (``PARTITION_ROWS``). Neither changes what is fitted: trees,
seeds and rows are the same however many fits run at once. The test part and
the fold of a row are computed once and kept with it.
"""

from __future__ import annotations

import threading
import time
from contextlib import nullcontext
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import evaluate as EV
from ..operators import split as SP
from ..sources.validate import ensure_min_rows, require_columns

PARTITION_ROWS = 250_000  # rows of a partition that is fitted on, at most
ROWS_AT_ONCE = 16_000_000  # rows of all the fits that run at once (about 180 bytes each); a single fit may have more
WALK_DEPTH = 6  # trees up to this depth are walked from their root: a few comparisons, against a stored copy per level
MOST_CLASSES = 100  # MLlib's bound on a label without metadata


@dataclass
class ForestConfig:
    numTrees: int = K.FOREST_PARAMS["numTrees"]
    maxDepth: int = K.FOREST_PARAMS["maxDepth"]
    minInstancesPerNode: int = K.FOREST_PARAMS["minInstancesPerNode"]
    featureSubsetStrategy: str = K.FOREST_PARAMS["featureSubsetStrategy"]
    seed: int = K.FOREST_PARAMS["seed"]
    maxBins: int = 64
    balanced: bool = True
    maxMemoryInMB: int = 512
    # in trees deeper than WALK_DEPTH, keeps the node that each row has reached in each tree (4 bytes a row and tree,
    # spilled to disk if need be) instead of walking every tree from its root for every level; the forest is the same
    cacheNodeIds: bool = True
    # independently seeded sub-forests; part of the model's definition, so the
    # same at every input size and on every cluster
    subForests: int = 8

    def estimator(self, weighted: bool = True) -> RandomForestClassifier:
        rf = RandomForestClassifier(
            featuresCol="features", labelCol=K.LABEL_COL, numTrees=self.numTrees, maxDepth=self.maxDepth,
            minInstancesPerNode=self.minInstancesPerNode, featureSubsetStrategy=self.featureSubsetStrategy,
            seed=self.seed, maxBins=self.maxBins, maxMemoryInMB=self.maxMemoryInMB,
            cacheNodeIds=self.cacheNodeIds and self.maxDepth > WALK_DEPTH)
        if weighted and self.balanced:
            rf = rf.setWeightCol("weight")
        return rf


class ForestEnsemble:
    """A random forest fitted as independently seeded sub-forests.

    Trees of a random forest are independent given their bootstrap draws, so k
    sub-forests of n/k trees with distinct seeds form one forest of n trees;
    its class-1 probability is the mean over all trees, i.e. the mean of the
    sub-forest probabilities (equal sizes). Fitting the sub-forests from
    concurrent driver threads lets Spark overlap MLlib's per-level jobs, which
    alone leave most cores idle on small inputs.
    """

    def __init__(self, assembler: VectorAssembler, forests: list):
        self.assembler, self.forests = assembler, forests

    @property
    def num_trees(self) -> int:
        return sum(f.getNumTrees for f in self.forests)

    def transform(self, df: DataFrame, out: str = "probability_1", assembled: bool = False) -> DataFrame:
        """Add ``out``. ``assembled``: ``df`` has the feature vector instead of the feature columns."""
        x = df if assembled else self.assembler.transform(df)
        cols = []
        for i, f in enumerate(self.forests):
            # without a raw column, a forest's votes become its probability in one call
            x = f.copy().setProbabilityCol(f"_prob{i}").setRawPredictionCol("").setPredictionCol("").transform(x)
            cols.append((vector_to_array(F.col(f"_prob{i}"))[1], f.getNumTrees))
        total = float(sum(n for _, n in cols))
        x = x.drop(out).withColumn("_score", sum(c * (n / total) for c, n in cols))
        # a filter on the score stops at the generator: pushed below, it would run all trees each time it names the score
        held = F.inline(F.array(F.struct(F.col("_score").alias(out))))
        return x.select("*", held).drop("features", "_score", *[f"_prob{i}" for i in range(len(self.forests))])

    def feature_importances(self) -> list[float]:
        total = float(self.num_trees)
        acc = [0.0] * len(self.assembler.getInputCols())
        for f in self.forests:
            w = f.getNumTrees / total
            for j, v in enumerate(f.featureImportances.toArray().tolist()):
                acc[j] += w * v
        return acc

    def save(self, path: str) -> None:
        PipelineModel(stages=[self.assembler]).write().overwrite().save(f"{path}/assembler")
        for i, f in enumerate(self.forests):
            f.write().overwrite().save(f"{path}/forest-{i:03d}")

    @classmethod
    def load(cls, spark, path: str) -> "ForestEnsemble":
        from pyspark.ml.classification import RandomForestClassificationModel
        asm = PipelineModel.load(f"{path}/assembler").stages[0]
        jvm = spark.sparkContext._jvm
        fs_path = jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(st.getPath().getName() for st in fs.listStatus(fs_path)
                       if st.getPath().getName().startswith("forest-"))
        return cls(asm, [RandomForestClassificationModel.load(f"{path}/{n}") for n in names])


def _at_once(rows: int, wanted: int) -> int:
    """Fits of ``rows`` rows that run at once: as many as wanted, while their rows stay within bounds."""
    return max(1, min(wanted, ROWS_AT_ONCE // max(rows, 1)))


def _weighted(train: DataFrame) -> tuple[DataFrame, int]:
    """(label, features, weight) of a training part, and its rows.

    The weights, a number per class, are literals: each of a fit's passes would otherwise count
    the classes again. The label says how many classes it has, for which MLlib looks at all rows else.
    """
    classes = SP.class_weights(train).where(F.col(K.LABEL_COL).isNotNull()).limit(MOST_CLASSES + 1).collect()
    if not classes or len(classes) > MOST_CLASSES:
        return SP.with_class_weight(train).select(K.LABEL_COL, "features", "weight"), train.count()
    label = F.col(K.LABEL_COL)
    weight = F.lit(None).cast("double")
    for c in classes:
        weight = F.when(label == F.lit(c[K.LABEL_COL]), F.lit(c["weight"])).otherwise(weight)
    last = max(float(c[K.LABEL_COL]) for c in classes)
    if last.is_integer() and 0 <= last < MOST_CLASSES:
        label = label.alias(K.LABEL_COL, metadata={"ml_attr": {"type": "nominal", "num_vals": int(last) + 1}})
    weighted = train.where(F.col(K.LABEL_COL).isNotNull()).select(label, "features", weight.alias("weight"))
    return weighted, sum(c["n_class"] for c in classes)


def fit_forest(train: DataFrame, config: "ForestConfig", sub_forests: int | None = None,
               rows: int | None = None, gate=None) -> list:
    """Fit ``config.numTrees`` trees as sub-forests (seeds seed, seed+1, ...), in parallel as far as
    the number of rows allows (all at once where ``rows`` is not given). ``gate``: a context that a fit
    runs in, for a bound shared with other forests."""
    k = max(1, min(sub_forests or config.subForests, config.numTrees))
    sizes = [config.numTrees // k + (1 if i < config.numTrees % k else 0) for i in range(k)]

    def one(i):
        cfg = ForestConfig(**{**config.__dict__, "numTrees": sizes[i], "seed": config.seed + i})
        with gate or nullcontext():
            return cfg.estimator().fit(train)
    return _parallel(one, list(range(k)), _at_once(rows or 0, k))


@dataclass
class TrainResult:
    model: ForestEnsemble
    metrics: dict = field(default_factory=dict)       # scalars
    tables: dict = field(default_factory=dict)        # name -> small DataFrame


def assembler() -> VectorAssembler:
    # "keep": a missing input becomes NaN in the vector; scoring masks such rows
    return VectorAssembler(inputCols=K.FEATURE_COLS, outputCol="features", handleInvalid="keep")


def _probability_frame(pred: DataFrame) -> DataFrame:
    """(y, p, pred) from either an MLlib model output or an ensemble output."""
    p = F.col("probability_1") if "probability_1" in pred.columns else vector_to_array("probability")[1]
    pr = (p > 0.5).cast("int") if "probability_1" in pred.columns else F.col("prediction").cast("int")
    return pred.select(F.col(K.LABEL_COL).alias("y"), p.alias("p"), pr.alias("pred"),
                       *[c for c in ("_key",) if c in pred.columns])


def _f1_and_rows(pred: DataFrame) -> tuple[float, int]:
    r = EV.binary_metrics(_probability_frame(pred)).select(
        "f1", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("rows")).first()
    return float(r["f1"]), int(r["rows"])


def _f1(pred: DataFrame) -> float:
    return _f1_and_rows(pred)[0]


def _fitted(part: DataFrame, config: "ForestConfig", sub_forests: int | None = None, gate=None) -> list:
    """Sub-forests of a training part, read from the kept table: a copy of it beside the binned
    rows would push these out of memory."""
    rows, n = _weighted(part)
    return fit_forest(rows, config, sub_forests, n, gate)


def _parallel(fn, items, parallelism: int):
    """Run independent fits from driver threads; Spark schedules their jobs together
    (the same approach as MLlib's CrossValidator ``parallelism``)."""
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(fn, items))


def spread(df: DataFrame) -> DataFrame:
    """``df`` as read, or dealt out anew if a partition holds over PARTITION_ROWS rows.

    A file of few large pieces else gives few tasks, each with a cached block that grows with the
    table. Rows are dealt in turn, whatever their keys, and ordered within a partition, so that a
    recomputed partition draws the same bootstrap sample.
    """
    sizes = df.select(F.spark_partition_id().alias("part")).groupBy("part").count()
    held = sizes.agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    if (held["most"] or 0) <= PARTITION_ROWS:
        return df
    order = [vector_to_array(c) if c == "features" else F.col(c) for c in df.columns]
    return df.repartition(-(-held["rows"] // PARTITION_ROWS)).sortWithinPartitions(*order)


class _Persisted:
    """Persist a frame, well spread, for the duration of a block unless it is cached already."""

    def __init__(self, df: DataFrame):
        self.df, self.owned = df, not df.is_cached

    def __enter__(self) -> DataFrame:
        if self.owned:
            self.df = spread(self.df).persist(StorageLevel.MEMORY_AND_DISK)
        return self.df

    def __exit__(self, *exc):
        if self.owned:
            self.df.unpersist()


def train_model(df: DataFrame, key: str, config: ForestConfig | None = None, cv_folds: int = K.CV_FOLDS,
                learning_curve_sizes: list[float] | None = None, learning_curve_trees: int = K.LEARNING_CURVE_TREES,
                learning_curve_folds: int = 3, sub_forests: int | None = None,
                partitions: int | None = None) -> TrainResult:
    """Stratified 80/20 split, balanced weights, forest fit, full evaluation.

    ``partitions`` deals the assembled rows out anew, for a table stored in too few
    files to occupy the cluster; by default they stay as read.
    """
    config = config or ForestConfig()
    require_columns(df, K.FEATURE_COLS, "training features")
    require_columns(df, [K.LABEL_COL, key], "training table")
    ensure_min_rows(df, K.MIN_TRAIN_ROWS, "Dataset")

    asm = assembler()
    table = df.select(F.col(key).alias("_key"), K.LABEL_COL, *K.FEATURE_COLS)
    table = table.repartition(partitions, "_key") if partitions else spread(table)
    # the vector holds the features: they are kept once
    kept = asm.transform(table).select("_key", K.LABEL_COL, "features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        data = SP.with_split(kept, "_key")
        if cv_folds and cv_folds > 1:
            data = SP.with_folds(data, "_key", cv_folds)
        # each row's part is kept beside it: the passes of the fits only compare it
        first, kept = kept, data.persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()
        first.unpersist()
        data = kept
        train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
        t0 = time.perf_counter()
        forests = _fitted(train, config, sub_forests)
        train_time = time.perf_counter() - t0
        model = ForestEnsemble(asm, forests)

        # each scored part is (y, p, pred) only; the test part is persisted, as every metric reads it
        scored_test = _probability_frame(model.transform(test.drop("_key"), assembled=True)) \
            .persist(StorageLevel.MEMORY_AND_DISK)
        scored_train = _probability_frame(model.transform(train.drop("_key"), assembled=True))
        bm = EV.binary_metrics(scored_test).first().asDict()
        train_acc = float(EV.binary_metrics(scored_train).select("accuracy").first()[0])
        roc_points, auc = EV.roc_curve_and_auc(scored_test)
        brier = EV.brier_score(scored_test).first()[0]
        counts = data.agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test")).first()

        metrics = {
            "accuracy": bm["accuracy"], "precision": bm["precision"], "recall": bm["recall"], "f1": bm["f1"],
            "roc_auc": float(auc) if auc is not None else None, "brier_score": float(brier) if brier is not None else None,
            "train_accuracy": train_acc, "overfit_gap": train_acc - bm["accuracy"],
            "n_train": int(counts["n_train"]), "n_test": int(counts["n_test"]),
            "train_time_s": round(train_time, 2),
            "trained_at": datetime.now().isoformat(timespec="seconds"),
        }
        tables = {
            "confusion": EV.confusion_matrix(scored_test),
            "roc": roc_points,
            "calibration": EV.calibration_curve(scored_test),
            "importances": importances(model),
        }
        if cv_folds and cv_folds > 1:
            scores = _fold_f1(kept, metrics["n_train"] + metrics["n_test"], config, cv_folds)
            import statistics
            metrics["cv_scores"] = scores
            metrics["cv_mean"] = statistics.fmean(scores)
            metrics["cv_std"] = statistics.pstdev(scores)
            tables["cv"] = df.sparkSession.createDataFrame(
                [(i, s) for i, s in enumerate(scores)], "fold int, f1 double")
        if learning_curve_sizes:
            lc_cfg = ForestConfig(**{**config.__dict__, "numTrees": learning_curve_trees})
            tables["learning_curve"] = learning_curve(kept, lc_cfg, learning_curve_sizes, learning_curve_folds)
        # materialise the small tables before the shared frame is released
        tables = {k: _freeze(v) for k, v in tables.items()}
        scored_test.unpersist()
        return TrainResult(model=model, metrics=metrics, tables=tables)
    finally:
        kept.unpersist()


def _freeze(df: DataFrame) -> DataFrame:
    """Metric tables are checkpointed into the shared folder (the ROC table can
    have one row per distinct score, so nothing is collected)."""
    from ..session import materialize
    return materialize(df)


def _fit_rows(data: DataFrame) -> DataFrame:
    return data if data.is_cached else data.select("_key", K.LABEL_COL, "features")


def cross_val_f1(data: DataFrame, config: ForestConfig, k: int = K.CV_FOLDS, parallelism: int = 4) -> list[float]:
    """k-fold (stratified folds over all rows) F1 of class 1; weights from each training part.

    ``data``: _key, label and features.
    """
    with _Persisted(_fit_rows(data)) as kept:
        folded = SP.with_folds(kept, "_key", k).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return _fold_f1(folded, folded.count(), config, k, parallelism)
        finally:
            folded.unpersist()


def _fold_f1(folded: DataFrame, rows: int, config: ForestConfig, k: int, parallelism: int = 4) -> list[float]:
    """F1 per fold of ``rows`` rows that are kept with their ``fold``.

    Where fewer fits may run at once than a fold has, two folds share them: one is scored while the other is fitted.
    """
    fits = _at_once(rows, parallelism * _subs(config))
    gate = threading.BoundedSemaphore(fits)

    def one(f):
        m = ForestEnsemble(assembler(), _fitted(folded.where(F.col("fold") != f), config, gate=gate))
        return _f1(m.transform(folded.where(F.col("fold") == f), assembled=True))
    return _parallel(one, list(range(k)), max(_at_once(rows * _subs(config), parallelism), min(2, fits, parallelism)))


def _subs(config: ForestConfig) -> int:
    return max(1, min(config.subForests, config.numTrees))


def learning_curve(data: DataFrame, config: ForestConfig, sizes: list[float], folds: int = 3,
                   parallelism: int = 4) -> DataFrame:
    """Mean train/validation F1 per training-size fraction (nested samples by hash).

    ``data``: _key, label and features.
    """
    from ..functions import unit_hash_int
    with _Persisted(_fit_rows(data)) as kept:
        folded = SP.with_folds(kept, "_key", folds, seed=K.SPLIT_SEED + 2).withColumn(
            "_u", unit_hash_int("_key", K.SPLIT_SEED + 3))
        def one(job):
            frac, f = job
            tr, n = _weighted(folded.where((F.col("fold") != f) & (F.col("_u") < F.lit(float(frac)))))
            tr = tr.persist(StorageLevel.DISK_ONLY)  # memory is for the binned rows
            try:
                m = ForestEnsemble(assembler(), fit_forest(tr, config, rows=n))
                tr_f1, n_tr = _f1_and_rows(m.transform(tr, assembled=True))
                return frac, n_tr, tr_f1, _f1(m.transform(folded.where(F.col("fold") == f), assembled=True))
            finally:
                tr.unpersist()
        res = _parallel(one, [(frac, f) for frac in sizes for f in range(folds)],
                        _at_once(kept.count() * _subs(config), parallelism))
    rows = []
    for frac in sizes:
        part = [r for r in res if r[0] == frac]
        rows.append((float(frac), int(sum(r[1] for r in part) / len(part)), sum(r[2] for r in part) / len(part),
                     sum(r[3] for r in part) / len(part)))
    return data.sparkSession.createDataFrame(rows, "fraction double, train_size long, train_f1 double, val_f1 double")


def importances(model, names=None) -> DataFrame:
    """(feature, importance) from the fitted forest, sorted by importance descending."""
    names = names or K.FEATURE_COLS
    if isinstance(model, ForestEnsemble):
        vals = model.feature_importances()
    else:
        vals = model.stages[-1].featureImportances.toArray().tolist()
    from pyspark.sql import SparkSession
    ss = SparkSession.getActiveSession()
    return ss.createDataFrame(list(zip(names, [float(v) for v in vals])), "feature string, importance double") \
        .orderBy(F.desc("importance"), "feature")


def onehot_importances(df: DataFrame, config: ForestConfig | None = None) -> DataFrame:
    """Forest over the six numeric features plus one-hot soil dummies; importance per dummy slot.

    ``df`` has Elevation, Slope, Rainfall, Temperature, NDVI, Soil_Moisture, Soil_Type (code 0-3) and the label.
    """
    config = config or ForestConfig(numTrees=50, maxDepth=12, minInstancesPerNode=1, balanced=False)
    numeric = ["Elevation", "Slope", "Rainfall", "Temperature", "NDVI", "Soil_Moisture"]
    ohe = OneHotEncoder(inputCols=["Soil_Type"], outputCols=["soil_vec"], dropLast=False)
    asm = VectorAssembler(inputCols=numeric + ["soil_vec"], outputCol="features")
    rf = config.estimator(weighted=False)
    model = Pipeline(stages=[ohe, asm, rf]).fit(df)
    n_soil = model.stages[0].categorySizes[0]
    inv = {v: k for k, v in K.SOIL_CODES.items()}
    names = numeric + [f"Soil_Type_{inv.get(i, i)}" for i in range(n_soil)]
    vals = model.stages[-1].featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(names, [float(v) for v in vals])),
                                           "feature string, importance double").orderBy(F.desc("importance"), "feature")
