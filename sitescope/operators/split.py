"""Stratified train/test split, cross-validation folds and class weights.

Rows of a class are ordered by a hash of their key (then the key). The first
``round(fraction * n)`` of its n rows are the test part, and the row at place r
is in fold ``r * k div n``, so every class is cut exactly, to within one row.

No row is ranked but those next to a cut: rows are counted per class and hash
bucket, the counts name the bucket that holds each cut, and only the rows of
those buckets are ordered. The cuts (a few per class) become literals, against
which each row compares its own hash: no join, no shuffle of the table. A
recomputed partition gets the same assignment. Where a class has fewer than two
rows, the whole table is cut as one class.

Defined results: null keys order first; rows that repeat a key stay together,
so a cut that falls among them moves by their number; an empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import unit_hash, unit_hash_int
from ..session import materialize

BUCKETS = 16_384


def _u(df: DataFrame, key: str, seed: int) -> Column:
    integral = df.schema[key].dataType.typeName() in ("long", "integer", "short", "byte")
    return unit_hash_int(key, seed) if integral else unit_hash(key, seed=seed)


def _below(df: DataFrame, key: str, label: str, seed: int, cuts: int, place) -> DataFrame:
    """Add int ``_part``: how many of the class's cuts 1..``cuts`` lie at or before the row.

    ``place(n, i)`` is the 0-based place of the first row after cut i in a class of n rows.
    """
    u = F.coalesce(_u(df, key, seed), F.lit(-1.0))
    own = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("?"))
    at = df.select(own.alias("c"), F.floor(u * BUCKETS).cast("int").alias("b"), u.alias("u"), F.col(key).alias("k"))
    counts = materialize(at.groupBy("c", "b").agg(F.count(F.lit(1)).alias("m")))  # at most BUCKETS + 1 rows per class
    smallest = counts.groupBy("c").agg(F.sum("m").alias("n")).agg(F.min("n")).first()[0]
    if smallest is not None and smallest < 2:
        own = F.lit("")
        at, counts = at.withColumn("c", own), counts.groupBy(own.alias("c"), "b").agg(F.sum("m").alias("m"))

    so_far = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.select("c", "b", (F.sum("m").over(so_far) - F.col("m")).alias("before"), "m",
                           F.sum("m").over(Window.partitionBy("c")).alias("n"))
    wanted = counts.select("*", F.explode(F.array(*[F.lit(i) for i in range(1, cuts + 1)])).alias("i")).withColumn(
        "r", place(F.col("n"), F.col("i"))).where("r >= before and r < before + m").select("c", "b", "before", "r").collect()
    if not wanted:
        return df.withColumn("_part", F.lit(0))
    # at most `cuts` rows per class: a bounded broadcast
    places = df.sparkSession.createDataFrame(wanted, "c string, b int, before long, r long").groupBy("c", "b").agg(
        F.first("before").alias("before"), F.collect_set("r").alias("rs"))
    nth = F.row_number().over(Window.partitionBy("c", "b").orderBy("u", "k")) - 1 + F.col("before")
    near = at.join(F.broadcast(places), ["c", "b"]).withColumn("r", nth).where(F.array_contains("rs", F.col("r")))
    found = {(row["c"], row["r"]): row for row in near.select("c", "r", "u", "k").collect()}
    cuts_of: dict[str, list] = {}
    for row in wanted:
        cut = found[row["c"], row["r"]]
        cuts_of.setdefault(row["c"], []).append((cut["u"], cut["k"]))
    # the number is a column of its own, computed once a row, and compared before the key: no struct is built for a row
    x, kind = df.withColumn("_part_u", u), df.schema[key].dataType
    part = F.lit(0)
    for c, ends in cuts_of.items():
        before = sum((_reached(F.col("_part_u"), F.col(key), cut_u, cut_k, kind).cast("int") for cut_u, cut_k in ends), F.lit(0))
        part = F.when(_is(label, c), before).otherwise(part)
    return x.withColumn("_part", part).drop("_part_u")


def _is(label: str, c: str) -> Column:
    """Whether a row is of class ``c``: "" holds all, "?" those without a label, "=..." the others."""
    if not c.startswith("="):
        return F.col(label).isNull() if c else F.lit(True)
    return F.coalesce(F.col(label).cast("string") == F.lit(c[1:]), F.lit(False))


def _reached(u: Column, key: Column, cut_u: float, cut_k, kind) -> Column:
    """Whether (u, key) is at or past a cut; null keys order first."""
    past = F.lit(True) if cut_k is None else F.coalesce(key >= F.lit(cut_k).cast(kind), F.lit(False))
    return (u > F.lit(cut_u)) | ((u == F.lit(cut_u)) & past)


def with_split(df: DataFrame, key: str, test_fraction: float = K.TEST_FRACTION, seed: int = K.SPLIT_SEED,
               label: str = K.LABEL_COL) -> DataFrame:
    """Add boolean ``is_test``."""
    def n_test(n, _i):
        return F.floor(n * F.lit(float(test_fraction)) + F.lit(0.5))
    parts = _below(df, key, label, seed, 1, n_test)
    return parts.withColumn("is_test", F.col("_part") == 0).drop("_part")


def train_test(df: DataFrame, key: str, test_fraction: float = K.TEST_FRACTION, seed: int = K.SPLIT_SEED,
               label: str = K.LABEL_COL):
    s = with_split(df, key, test_fraction, seed, label)
    return s.where(~F.col("is_test")).drop("is_test"), s.where(F.col("is_test")).drop("is_test")


def with_folds(df: DataFrame, key: str, k: int = K.CV_FOLDS, seed: int = K.SPLIT_SEED + 1,
               label: str = K.LABEL_COL) -> DataFrame:
    """Add int ``fold`` in 0..k-1."""
    if k < 2:
        return df.withColumn("fold", F.lit(0))
    def first_of(n, i):
        return F.ceil(n * i / F.lit(k))
    return _below(df, key, label, seed, k - 1, first_of).withColumnRenamed("_part", "fold")


def split_sizes(df: DataFrame, key: str, label: str = K.LABEL_COL, test_fraction: float = K.TEST_FRACTION,
                seed: int = K.SPLIT_SEED) -> DataFrame:
    s = with_split(df, key, test_fraction, seed, label)
    return s.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"),
                                F.count_if(~F.col("is_test")).alias("n_train"))


def fold_sizes(df: DataFrame, key: str, label: str = K.LABEL_COL, k: int = K.CV_FOLDS,
               seed: int = K.SPLIT_SEED + 1) -> DataFrame:
    return with_folds(df, key, k, seed, label).groupBy("fold", label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(train: DataFrame, label: str = K.LABEL_COL) -> DataFrame:
    """Balanced weights n / (n_classes * n_class) per class, from one pass (a row per class)."""
    g = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    classes = Window.partitionBy(F.lit(0))  # over one row per class
    total, n_classes = F.sum("n_class").over(classes), F.count(label).over(classes)
    return g.select(label, "n_class", (total.cast("double") / (n_classes * F.col("n_class"))).alias("weight"))


def with_class_weight(train: DataFrame, label: str = K.LABEL_COL, weight_col: str = "weight") -> DataFrame:
    """Attach the balanced weight to each row; the 2-row weight table is a broadcast with a fixed size."""
    w = class_weights(train, label).select(label, F.col("weight").alias(weight_col))
    return train.join(F.broadcast(w), label)
