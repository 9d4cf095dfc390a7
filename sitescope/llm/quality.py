"""Quality classifier: a sparse ensemble of rules, scored by column expressions.

Statistics of a text are Spark columns. A small forest is grown on labelled
rows; the path to each of its nodes is a conjunctive rule over statistics. A
lasso logistic regression over the rules leaves few with a weight, and these
compile into one Spark column expression, so scoring needs no Python and reads
nothing but the text.

The fit uses at most about ``sample_rows`` labelled rows, chosen by a hash of
the id; scoring covers every row.

Defined results: null and empty texts have zero statistics and get a score
like any other; rows that repeat keep one result each; labels that are null,
neither 0 nor 1, or without a document are left out, and with one class alone
(or no label) the score is that class's share (or 0.5) for all; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, plain_text, written

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
SYMBOLS = "#$%&*|@<>{}[]=_~^+\\/`"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that is never learned from (null ids count as empty text)."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % 5 == 0


def _share(text: Column, characters: str, n: Column) -> Column:
    return (n - F.char_length(F.translate(text, characters, ""))) / F.greatest(n, F.lit(1))


def statistics(df: DataFrame, text: Column, prefix: str) -> tuple[DataFrame, list[str]]:
    """``df`` with the statistics of ``text`` as double columns, and their names."""
    t, w, n = (fresh(df, f"{prefix}{x}") for x in ("text", "words", "n"))
    df = df.withColumn(t, text)
    df = df.withColumns({w: F.filter(F.split(F.col(t), r"[\x20\x09-\x0D]+"), lambda x: x != ""), n: F.char_length(F.col(t))})
    words, size = F.col(w), F.greatest(F.size(w), F.lit(1))
    lines = F.char_length(F.col(t)) - F.char_length(F.replace(F.col(t), F.lit("\n"), F.lit(""))) + 1
    stats = {
        "log_words": F.log1p(F.size(w)),
        "word_length": F.col(n) / size,
        "distinct": F.size(F.array_distinct(words)) / size,
        "repeated": F.size(F.filter(words, lambda x, i: (i > 0) & (x == F.get(words, i - 1)))) / size,
        "wordless": F.size(F.filter(words, lambda x: ~x.rlike(r"\p{L}"))) / size,
        "words_a_line": size / lines,
        "symbols": _share(F.col(t), SYMBOLS, F.col(n)),
        "exclamations": _share(F.col(t), "!", F.col(n)),
        "capitals": _share(F.col(t), CAPITALS, F.col(n)),
        "digits": _share(F.col(t), "0123456789", F.col(n)),
    }
    names = {k: fresh(df, f"{prefix}{k}") for k in stats}
    return df.withColumns({names[k]: v.cast("double") for k, v in stats.items()}).drop(t, w, n), list(names.values())


@dataclass(frozen=True)
class Model:
    """Weighted rules: each a tuple of (statistic number, is below or equal, threshold)."""
    prior: float | None
    intercept: float
    rules: tuple[tuple[float, tuple[tuple[int, bool, float], ...]], ...]

    def score(self, names: list[str]) -> Column:
        if self.prior is not None:
            return F.lit(float(self.prior))
        total = F.lit(float(self.intercept))
        for weight, rule in self.rules:
            total = total + F.when(condition(rule, names), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def condition(rule: tuple[tuple[int, bool, float], ...], names: list[str]) -> Column:
    out = None
    for stat, below, threshold in rule:
        part = F.col(names[stat]) <= threshold if below else F.col(names[stat]) > threshold
        out = part if out is None else out & part
    return out


def paths(node, above: tuple = ()) -> list[tuple]:
    """The conjunction that leads to each node below a tree's root."""
    out = [above] if above else []
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        stat, threshold = int(split.featureIndex()), float(split.threshold())
        out += paths(node.leftChild(), (*above, (stat, True, threshold)))
        out += paths(node.rightChild(), (*above, (stat, False, threshold)))
    return out


def tightened(rule: tuple) -> tuple:
    """One bound per statistic and side: conditions that another implies go."""
    best: dict[tuple[int, bool], float] = {}
    for stat, below, threshold in rule:
        key = (stat, below)
        best[key] = threshold if key not in best else (min if below else max)(best[key], threshold)
    return tuple(sorted((s, b, t) for (s, b), t in best.items()))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = 16, depth: int = 4,
        penalty: float = 0.002, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from labels whose id is not held out; ``sample_rows`` bounds them."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).cast("long").alias("label_id"), F.col("quality").cast("double").alias("label")).distinct()
    n = usable.count()
    keep = 1_000_000 * sample_rows // max(n, 1)
    # about sample_rows rows of two numbers: a bounded broadcast
    sample = usable.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < keep)
    joined = docs.select(docs[id_col].cast("long").alias("label_id"), plain_text(docs, text_col).alias("text")).join(
        F.broadcast(sample), "label_id")
    rows, names = statistics(joined.select("label", "text"), F.col("text"), "")
    rows = written(rows.select("label", *names), "labelled")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model(next(iter(counts), 0.5), 0.0, ())
    # few rows: one partition makes the fit the same wherever it runs
    rows = rows.coalesce(1).sortWithinPartitions("label", *names).select(
        "label", *names, array_to_vector(F.array(*names)).alias("statistics")).cache()
    try:
        forest = RandomForestClassifier(labelCol="label", featuresCol="statistics", numTrees=trees, maxDepth=depth,
                                        minInstancesPerNode=5, maxBins=64, featureSubsetStrategy="sqrt", seed=seed).fit(rows)
        rules = sorted({tightened(p) for tree in forest.trees for p in paths(tree._call_java("rootNode"))})
        if not rules:
            return Model(counts.get(1.0, 0) / sum(counts.values()), 0.0, ())
        held = rows.select("label", array_to_vector(F.array(
            *[F.when(condition(r, names), 1.0).otherwise(0.0) for r in rules])).alias("rules"))
        lasso = LogisticRegression(labelCol="label", featuresCol="rules", elasticNetParam=1.0, regParam=penalty,
                                   maxIter=100).fit(held)
    finally:
        rows.unpersist()
    weights = lasso.coefficients.toArray()
    return Model(None, float(lasso.intercept),
                 tuple((float(x), r) for x, r in zip(weights, rules, strict=True) if abs(x) > 1e-9))


def score(docs: DataFrame, model: Model, column: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the score of each text in ``column``."""
    prefix = "stat_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    with_stats, names = statistics(docs, plain_text(docs, text_col), prefix)
    # the one-row generator keeps a filter on the score from being pushed below the statistics, where each
    # of its rules would compute them anew
    return with_stats.select(*[f"`{c}`" for c in docs.columns], F.explode(F.array(model.score(names))).alias(column))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, same columns."""
    column = fresh(docs, "quality_score")
    return score(docs, fit(docs, labels), column).where(F.col(column) >= threshold).select(*[f"`{c}`" for c in docs.columns])


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
