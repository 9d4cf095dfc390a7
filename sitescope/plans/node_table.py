"""A fitted forest as a table of nodes, and a level-wise evaluator over it.

Nodes are rows: tree, node, the feature and threshold of the split, the children,
and at a leaf the share of class 1. The evaluator does not call the model library:
each row stands at a node of each tree, and one join per level moves all of them
down. The node table's size is bounded by the forest's configuration (trees times
2^(depth + 1)), not by the data, and is checked before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.aggregates import exact_mean

# 200 trees of depth 12 have 1.6 million nodes at most, about 40 bytes each
MOST_NODES = 2_000_000
FOREST_STRIDE = 100_000  # trees of one sub-forest are numbered from a multiple of it


def forest_nodes(spark: SparkSession, model_path: str, n_forests: int) -> DataFrame:
    """(tree, node, feature, threshold, left, right, p1) of a saved forest of ``n_forests`` sub-forests."""
    out = None
    for i in range(n_forests):
        saved = spark.read.parquet(f"{model_path}/forest-{i:03d}/data").select("treeID", "nodeData.*")
        inner = F.col("leftChild") >= 0
        stats = F.col("impurityStats")
        one = saved.select(
            (F.col("treeID") + i * FOREST_STRIDE).alias("tree"), F.col("id").alias("node"),
            F.when(inner, F.col("split.featureIndex")).alias("feature"),
            F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
            F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
            F.when(~inner, F.try_divide(F.get(stats, F.lit(1)), F.aggregate(stats, F.lit(0.0), lambda a, b: a + b))).alias("p1"))
        out = one if out is None else out.unionByName(one)
    return out


def tree_depth(nodes: DataFrame) -> int:
    """Splits on the way to the deepest leaf, found level by level in the node table."""
    level = nodes.where("node = 0").select("tree", "node")
    depth = 0
    while True:
        inner = level.join(F.broadcast(nodes), ["tree", "node"]).where("left is not null")
        level = inner.select("tree", F.explode(F.array("left", "right")).alias("node"))
        if level.isEmpty():
            return depth
        depth += 1


def evaluate_nodes(df: DataFrame, nodes: DataFrame, key: str, features=tuple(K.FEATURE_COLS)) -> DataFrame:
    """(key, p1) for each row of ``df`` (``key`` unique): the mean of its leaves' shares of class 1 over the trees."""
    size, trees = nodes.count(), [r["tree"] for r in nodes.where("node = 0").select("tree").collect()]  # a number per tree
    if size > MOST_NODES:
        raise ValueError(f"{size} nodes are more than {MOST_NODES}")
    table = F.broadcast(nodes.select("tree", F.col("node").alias("at"), "feature", "threshold", "left", "right", "p1"))
    values = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select(F.col(key).alias("key"), values.alias("x"), F.explode(F.lit(trees)).alias("tree")).withColumn("at", F.lit(0))
    for _ in range(tree_depth(nodes)):
        down = F.when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        rows = rows.join(table, ["tree", "at"]).select("key", "x", "tree", F.coalesce(down, F.col("at")).alias("at"))
    leaves = rows.join(table, ["tree", "at"])
    # decimals: the mean does not depend on the order of the trees
    return leaves.groupBy("key").agg(exact_mean("p1").alias("p1")).withColumnRenamed("key", key)
