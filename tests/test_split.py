"""The stratified cut equals a ranking of every class by hash and key."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitescope.functions import unit_hash, unit_hash_int
from sitescope.operators import split as SP
from sitescope.operators.clean import label_to_int
from sitescope.operators.profile import correlation


def table(spark, n, positives):
    return spark.range(n).select("id", (F.col("id") < positives).cast("int").alias("y"))


@pytest.mark.parametrize("n,positives", [(20_000, 20), (50, 45), (7, 2)])
def test_cut_equals_ranks(spark, n, positives):
    df = table(spark, n, positives)
    for seed, k in ((42, 5), (7, 3)):
        w = Window.partitionBy("y").orderBy(unit_hash_int("id", seed), "id")
        ranked = df.select("id", (F.row_number().over(w) - 1).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("y")).alias("n"))
        want = {r.id: (r.r < int(r.n * 0.2 + 0.5), r.r * k // r.n) for r in ranked.collect()}
        tests = {r.id: r.is_test for r in SP.with_split(df, "id", seed=seed, label="y").collect()}
        folds = {r.id: r.fold for r in SP.with_folds(df, "id", k, seed=seed, label="y").collect()}
        assert {i: (tests[i], folds[i]) for i in tests} == want


def test_single_row_class_falls_back(spark):
    sizes = SP.split_sizes(table(spark, 101, 1), "id", "y").collect()
    assert sum(r.n for r in sizes) == 101 and sum(r.n_test for r in sizes) == 20


def test_text_keys_nulls_and_empty(spark):
    rows = [(None if i % 10 == 0 else f"k{i}", None if i % 3 == 0 else i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, y int")
    got = SP.with_split(df, "k", label="y").groupBy("y").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 300
    # rows that repeat the null key stay together
    assert all(abs(r.t - round(r.n * 0.2)) <= 10 for r in got)
    assert SP.with_folds(df.limit(0), "k", label="y").count() == 0


def test_bad_label_fails_whatever_is_read(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2), (2.0, 3.0, 1)], "a double, b double, Suitability int")
    checked = label_to_int(df)
    for job in (checked.count, checked.select("a").collect, lambda: correlation(checked, ["a", "b"]).collect()):
        with pytest.raises(Exception, match="only 0 and 1"):
            job()
