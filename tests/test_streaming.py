"""File-stream scoring equals batch scoring; the windowed rate counts every site."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from sitescope.operators import score as S
from sitescope.session import shared_path
from sitescope.sources import fixtures as fx
from sitescope.streaming import run_to_table, score_stream, windowed_rate
from sitescope.streaming.scoring import ntz_as_utc


def test_stream_matches_batch(spark):
    base = shared_path(spark, "stream-test")
    ev = fx.table(spark, SF_SMALL, "orders").select(F.col("o_orderkey").alias("site_id"),
                                                    ntz_as_utc("o_orderdate").alias("ts"))
    src = fx.sites_raw(spark, SF_SMALL).join(ev, "site_id")
    src.repartition(3).write.parquet(f"{base}/in")
    stream = score_stream(spark, f"{base}/in", src.schema, S.RuleScorer(), max_files_per_trigger=1)
    q = (stream.select("site_id", "Prediction").writeStream.format("parquet").option("path", f"{base}/scored")
         .option("checkpointLocation", f"{base}/ck1").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.site_id, r.Prediction) for r in spark.read.parquet(f"{base}/scored").collect()}
    batch = S.score_batch(fx.sites_raw(spark, SF_SMALL), S.RuleScorer())
    want = {(r.site_id, r.Prediction) for r in batch.select("site_id", "Prediction").collect()}
    assert got == want and len(got) > 0

    rate = run_to_table(windowed_rate(score_stream(spark, f"{base}/in", src.schema, S.RuleScorer()), "ts"),
                        f"{base}/rate", f"{base}/ck2")
    tot = rate.agg(F.sum("n_sites").alias("n"), F.sum("n_suitable").alias("s")).first()
    assert tot.n == len(want) and tot.s == sum(p for _, p in want)
    assert rate.where(F.col("window_end_s") - F.col("window_start_s") != 30 * 86400).count() == 0
