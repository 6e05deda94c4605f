import datetime as dt

import pytest
from pyspark.sql import functions as F

from diurna import schemas as S
from diurna.operators import intervals as I
from diurna.sources.adapters import TestTables
from diurna.streaming import streams


@pytest.fixture
def landed(spark, sample, folder):
    t = TestTables(spark, sample)
    t.activity.repartition(3).write.parquet(f"{folder}/in/activity")
    t.sleep.repartition(3).write.parquet(f"{folder}/in/sleep")
    return t


def drain(stream, name, mode, folder):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", f"{folder}/ck_{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_daily_totals_equal_batch(spark, landed, folder):
    src = streams.new_files(spark, f"{folder}/in/activity", S.ACTIVITY, pattern="*.parquet")
    drain(streams.daily_totals(src), "totals", "complete", folder)
    batch = landed.activity.groupBy("user_id", F.to_date("start_ts").alias("date")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("value").alias("total"))
    assert rows(spark.table("totals")) == rows(batch)


def test_baseline_state_equals_batch(spark, landed, folder):
    src = streams.new_files(spark, f"{folder}/in/activity", S.ACTIVITY)
    drain(streams.baseline_state(src, "activity_type"), "state", "complete", folder)
    batch = landed.activity.groupBy("user_id", "activity_type").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    pick = lambda df: {(r.user_id, r.activity_type): tuple(r)[2:] for r in df.collect()}
    got, want = pick(spark.table("state")), pick(batch)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_sleep_sessions_equal_batch_windows_without_nesting(spark, folder):
    base = dt.datetime(2024, 1, 1)
    h = lambda x: base + dt.timedelta(hours=x)
    data = [(1, "w", h(a), h(b), "ASLEEP", i) for i, (a, b) in enumerate([(0, 2), (5.75, 8), (12, 13), (30, 31), (34, 36)])]
    df = spark.createDataFrame(data, S.SLEEP)
    df.write.parquet(f"{folder}/s")
    drain(streams.sleep_sessions(streams.new_files(spark, f"{folder}/s", S.SLEEP)), "sess", "complete", folder)
    batch = I.merge_sleep_windows(df).select("user_id", "window_start", "window_end", "episodes")
    assert rows(spark.table("sess")) == rows(batch)


def test_append_buckets_are_closed_days_only(spark, landed, folder):
    src = streams.new_files(spark, f"{folder}/in/activity", S.ACTIVITY).withColumn("feature_name", F.col("activity_type"))
    drain(streams.day_buckets(src, ts="start_ts"), "buckets", "append", folder)
    batch = landed.activity.groupBy("user_id", "activity_type", F.to_date("start_ts").alias("d")).agg(
        F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    want = {(r.user_id, r.activity_type, r.d): (round(r.m, 6), r.n) for r in batch.collect()}
    got = {(r.user_id, r.feature_name, r.bucket): (round(r.avg_value, 6), r.n) for r in spark.table("buckets").collect()}
    last = max(k[2] for k in want)
    closed = {k: v for k, v in want.items() if k[2] < last - dt.timedelta(days=1)}
    assert closed.items() <= got.items() <= want.items()


def test_sliding_windows(spark, landed, folder):
    src = streams.new_files(spark, f"{folder}/in/activity", S.ACTIVITY)
    drain(streams.sliding_statistics(src), "slide", "complete", folder)
    batch = landed.activity.groupBy("user_id", F.window(F.col("start_ts").cast("timestamp"), "7 days", "1 day")).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("records")).select(
        "user_id", F.to_date("window.end").alias("window_end"), "mean", "std", "records")
    assert rows(spark.table("slide")) == rows(batch)


def test_first_row_per_date_and_restart(spark, landed, folder):
    src = streams.new_files(spark, f"{folder}/in/sleep", S.SLEEP)
    drain(streams.first_per_date(src), "first", "append", folder)
    got = spark.table("first")
    assert got.count() == got.select("user_id", "date").distinct().count()
    assert got.count() == landed.sleep.select("user_id", F.to_date("start_ts")).distinct().count()


def test_arrivals_are_processed_once(spark, landed, folder):
    def run():
        src = streams.new_files(spark, f"{folder}/in/sleep", S.SLEEP, per_trigger=2)
        streams.process_arrivals(src, I.merge_sleep_windows, f"{folder}/out", f"{folder}/ck").awaitTermination(120)
        return spark.read.parquet(f"{folder}/out").count()

    first = run()
    assert first > 0 and run() == first
    landed.sleep.limit(5).write.mode("append").parquet(f"{folder}/in/sleep")
    assert run() > first
