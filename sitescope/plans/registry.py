"""Model persistence, run metadata, staleness and the load-or-train policy.

Models are directories of MLlib forest models (see ``ForestEnsemble``); each run appends one
row to a ``model_runs`` Parquet table and its metric tables under
``metrics/<name>`` keyed by ``run_id``. Staleness compares the newest input
file modification time (Spark's ``_metadata`` column, an aggregate over the
file listing that also works on object stores) with the run's save time.
"""

from __future__ import annotations

import logging
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import ForestConfig, ForestEnsemble, TrainResult, train_model

LOG = logging.getLogger(__name__)

RUN_SCHEMA = ("run_id string, trained_at string, saved_at timestamp, n_train long, n_test long, accuracy double, "
              "f1 double, roc_auc double, cv_mean double, cv_std double, overfit_gap double, train_time_s double, "
              "model_path string")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_run(spark: SparkSession, result: TrainResult, base: str) -> str:
    """Persist model, metadata row and metric tables; returns the run id."""
    run_id = uuid.uuid4().hex[:16]
    model_path = f"{base}/models/{run_id}"
    result.model.save(model_path)
    m = result.metrics
    row = (run_id, m.get("trained_at", ""), datetime.now(), int(m.get("n_train", 0)), int(m.get("n_test", 0)),
           float(m.get("accuracy") or 0.0), float(m.get("f1") or 0.0), float(m.get("roc_auc") or 0.0),
           float(m.get("cv_mean") or 0.0), float(m.get("cv_std") or 0.0), float(m.get("overfit_gap") or 0.0),
           float(m.get("train_time_s") or 0.0), model_path)
    spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(f"{base}/model_runs")
    for name, table in result.tables.items():
        table.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(f"{base}/metrics/{name}")
    return run_id


def runs(spark: SparkSession, base: str) -> DataFrame | None:
    if not _exists(spark, f"{base}/model_runs"):
        return None
    return spark.read.schema(RUN_SCHEMA).parquet(f"{base}/model_runs")


def latest_run(spark: SparkSession, base: str) -> DataFrame | None:
    """The newest run's metadata row (one-row DataFrame), or None."""
    r = runs(spark, base)
    return None if r is None else r.orderBy(F.desc("saved_at"), F.desc("run_id")).limit(1)


def load_model(spark: SparkSession, base: str, run_id: str | None = None) -> ForestEnsemble | None:
    """The saved model of a run (default: the newest), or None where there is none. A store that
    cannot be read, or a model that is there but broken, is an error and no missing model."""
    r = runs(spark, base)
    if r is None:
        return None
    row = (r.where(F.col("run_id") == run_id) if run_id else r.orderBy(F.desc("saved_at"), F.desc("run_id"))) \
        .select("model_path").limit(1).first()
    if row is None:
        return None
    if not _exists(spark, row["model_path"]):
        return None
    return ForestEnsemble.load(spark, row["model_path"])


def metrics_table(spark: SparkSession, base: str, name: str, run_id: str) -> DataFrame:
    return spark.read.parquet(f"{base}/metrics/{name}").where(F.col("run_id") == run_id).drop("run_id")


def input_modified_at(spark: SparkSession, dataset_path: str):
    """Newest modification time over the dataset's files, whatever their format, or None
    when it does not exist. Only file listings are read, no contents."""
    if not _exists(spark, dataset_path):
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(dataset_path)
    return files.select(F.max("modificationTime")).first()[0]


def is_model_stale(spark: SparkSession, dataset_path: str, base: str) -> bool:
    """No model -> stale; no dataset -> not stale; else dataset newer than the model (strict)."""
    last = latest_run(spark, base)
    saved = None if last is None else last.select("saved_at").first()
    if saved is None:
        return True
    mtime = input_modified_at(spark, dataset_path)
    if mtime is None:
        return False
    return mtime > saved["saved_at"]


def load_or_train(spark: SparkSession, df: DataFrame, key: str, dataset_path: str, base: str,
                  force: bool = False, config: ForestConfig | None = None, **train_kw):
    """(model, metrics one-row DataFrame, status) with status loaded / retrained / error.

    A fresh saved model is returned with the metrics stored for it (no retraining).
    """
    if not force and not is_model_stale(spark, dataset_path, base):
        model = load_model(spark, base)
        if model is not None:
            return model, latest_run(spark, base), "loaded"
    try:
        result = train_model(df, key, config, **train_kw)
        run_id = save_run(spark, result, base)
        return result.model, runs(spark, base).where(F.col("run_id") == run_id), "retrained"
    except Exception:
        model = load_model(spark, base)
        if model is not None:
            LOG.exception("training failed; the last saved model is returned")
            empty = spark.createDataFrame([], RUN_SCHEMA)
            return model, empty, "error"
        raise
