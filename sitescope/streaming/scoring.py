"""Score arriving sites and keep a per-window suitability rate.

Scoring is row-wise once feature derivation fills missing cells per row
(``mode="row"``), so the batch scorer applies unchanged to ``readStream``
input. The windowed rate is a tumbling ``window`` aggregate with a
watermark in update mode, so state for windows older than the watermark is
dropped; rows later than the watermark are not counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean_batch
from ..operators.score import with_prediction


def score_stream(spark: SparkSession, source: str, schema, scorer, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of scored sites (Prediction, probability_1) from a file source."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return with_prediction(clean_batch(reader.load(source), mode="row"), scorer).drop("_conf")


def ntz_as_utc(c) -> F.Column:
    """TIMESTAMP_NTZ wall clock read as UTC, whatever the session time zone."""
    c = F.col(c) if isinstance(c, str) else c
    secs = (F.unix_date(F.to_date(c)).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
            + F.second(c))
    return F.timestamp_seconds(secs)


def windowed_rate(scored: DataFrame, event_time: str, window: str = "30 days",
                  watermark: str = "90 days") -> DataFrame:
    """Per tumbling window: sites, suitable sites and their share."""
    w = F.window(event_time, window)
    g = scored.withWatermark(event_time, watermark).groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("n_sites"), F.count_if(F.col("Prediction") == 1).alias("n_suitable"))
    return g.select(F.unix_seconds(F.col("w.start")).alias("window_start_s"),
                    F.unix_seconds(F.col("w.end")).alias("window_end_s"), "n_sites", "n_suitable")


def run_to_table(stream: DataFrame, out_path: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """Run the stream over everything available now and return its latest rows.

    Update mode: each micro-batch writes the windows that it changed to a folder
    of its own, which a repeated batch writes anew and no reader overwrites; the
    latest batch that holds a window has its row. ``keys`` name a window
    (default: its start and end).
    """
    keys = keys or ["window_start_s", "window_end_s"]
    rest = [c for c in stream.columns if c not in keys]

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")

    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out_path}/batch=-1")
    q = (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    latest = spark.read.parquet(out_path).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("now"))
    return latest.select(*keys, "now.*")


def final_windows(scored: DataFrame, event_time: str, window: str = "30 days", watermark: str = "90 days") -> DataFrame:
    """``windowed_rate`` for append mode: a window comes out once, when the watermark has passed its end
    and its state is evicted. It is final: what arrives for it afterwards is late and is not counted."""
    return windowed_rate(scored, event_time, window, watermark)


def run_wave(source: DataFrame, event_time: str, out: str, window_s: int = 30 * 86400, delay_s: int = 90 * 86400) -> None:
    """Process what has arrived since the last run: final windows and late rows.

    ``source`` is a scored stream. Under ``out``:

    - ``final``: windows as they become final, appended by the streaming aggregate,
      whose state holds open windows only;
    - ``late``: the rows that came after their window was evicted, as they arrived,
      a folder per batch;
    - ``seen``: the latest event time of each batch, from which the batch's
      watermark follows exactly as the aggregate's does: the latest event time of all
      earlier batches less the delay. A repeated batch writes its folders anew.

    Both queries read the same batches: each run takes what is new as one.
    """
    spark = source.sparkSession
    spark.createDataFrame([], "latest long").write.mode("overwrite").parquet(f"{out}/seen/batch=-1")
    spark.createDataFrame([], source.schema).write.mode("overwrite").parquet(f"{out}/late/batch=-1")

    def split(batch: DataFrame, epoch: int) -> None:
        ts = F.unix_seconds(event_time)
        earlier = spark.read.schema("latest long, batch long").parquet(f"{out}/seen").where(F.col("batch") < epoch)
        latest = earlier.agg(F.max("latest")).first()[0]  # one number
        mark = None if latest is None else latest - delay_s
        end = F.floor(ts / window_s) * window_s + window_s
        batch.where(F.lit(False) if mark is None else end <= mark).write.mode("overwrite").parquet(f"{out}/late/batch={epoch}")
        batch.agg(F.max(ts).alias("latest")).write.mode("overwrite").parquet(f"{out}/seen/batch={epoch}")

    final = final_windows(source, event_time, f"{window_s} seconds", f"{delay_s} seconds")
    queries = [final.writeStream.outputMode("append").format("parquet").option("path", f"{out}/final")
               .option("checkpointLocation", f"{out}/state/final").trigger(availableNow=True).start(),
               source.writeStream.option("checkpointLocation", f"{out}/state/late").foreachBatch(split)
               .trigger(availableNow=True).start()]
    for q in queries:
        q.awaitTermination()


def late_rows(spark: SparkSession, out: str, schema) -> DataFrame:
    """Rows that came too late, with the batch they came in."""
    return spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(f"{out}/late")
