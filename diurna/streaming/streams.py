"""Structured Streaming counterparts: arrivals, daily state, baselines and sleep sessions.

Watermarks need a zoned timestamp, so wall-clock columns are cast under the UTC
session zone. Late rows beyond the watermark are dropped from state and show in
the query progress; `upkeep.admit` sets them aside beforehand and `upkeep.repair` makes
their days anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from diurna.functions import exprs as E

DELAY = "1 day"


def new_files(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", pattern: str = "*",
              recursive: bool = True, per_trigger: int = 1000) -> DataFrame:
    """Files as they appear; the checkpoint remembers which were taken, across restarts."""
    reader = (
        spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive).option("maxFilesPerTrigger", per_trigger))
    return reader.load(folder)


def process_arrivals(stream: DataFrame, handler: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch job on each arrival; every batch owns one folder, so a replay overwrites itself."""
    def run(batch: DataFrame, epoch: int) -> None:
        handler(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(stream: DataFrame, ts: str) -> DataFrame:
    return stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", DELAY)


def daily_totals(stream: DataFrame, ts: str = "start_ts", value: str = "value") -> DataFrame:
    """Count and sum per user and day."""
    return _timed(stream, ts).groupBy("user_id", F.window("at", "1 day")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(value).alias("total")
    ).select("user_id", F.to_date("window.start").alias("date"), "records", "total")


def baseline_state(stream: DataFrame, metric: str, value: str = "value") -> DataFrame:
    """Count, mean and deviation per user and metric; the state keeps squared deviations from the mean."""
    v = F.col(value)
    return stream.groupBy("user_id", metric).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def sleep_sessions(stream: DataFrame, gap_minutes: int = 225) -> DataFrame:
    """Merged sleep sessions; the gap of each episode is its own length plus the merge threshold.

    Matches the batch windows unless an episode lies inside an earlier, longer one; for those
    too see `sessions.merged_windows`.
    """
    length = F.ceil((E.micros("end_ts") - E.micros("start_ts")) / E.MINUTE_US)
    gap = F.concat((length + gap_minutes).cast("string"), F.lit(" minutes"))
    return _timed(stream.withColumn("gap", gap), "start_ts").groupBy("user_id", F.session_window("at", F.col("gap"))).agg(
        F.count(F.lit(1)).alias("episodes"), F.max("end_ts").alias("window_end")
    ).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("window_start"), "window_end", "episodes")


def sliding_statistics(stream: DataFrame, ts: str = "start_ts", value: str = "value", size: str = "7 days",
                       step: str = "1 day") -> DataFrame:
    return _timed(stream, ts).groupBy("user_id", F.window("at", size, step)).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("records")
    ).select("user_id", F.to_date("window.end").alias("window_end"), "mean", "std", "records")


def first_per_date(stream: DataFrame, ts: str = "start_ts") -> DataFrame:
    """Later rows of a date already seen are ignored while it is within the watermark."""
    return _timed(stream, ts).withColumn("date", F.to_date("at")).dropDuplicatesWithinWatermark(["user_id", "date"]).drop("at")


def day_buckets(stream: DataFrame, ts: str = "effective_ts", value: str = "value") -> DataFrame:
    """Continuous day buckets per user and metric, final once the watermark has passed."""
    return _timed(stream, ts).groupBy("user_id", "feature_name", F.window("at", "1 day")).agg(
        F.avg(value).alias("avg_value"), F.stddev_samp(value).alias("std_value"), F.count(F.lit(1)).alias("n"),
        F.max("at").alias("latest")
    ).select("user_id", "feature_name", F.to_date("window.start").alias("bucket"), "avg_value", "std_value", "n", "latest")
