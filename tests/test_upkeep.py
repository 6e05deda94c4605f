"""Arrivals in any order, late rows and merged sleep windows against the batch results."""

import dataclasses
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from diurna import schemas as S
from diurna.operators import intervals as I
from diurna.operators import rolling as R
from diurna.sources.stored import StoredTable
from diurna.streaming import sessions, streams, upkeep

BASE = dt.datetime(2024, 1, 1)
METRICS = ["sleep_percentage", "long_num"]


def at(hours):
    return BASE + dt.timedelta(hours=hours)


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def land(spark, folder, data):
    spark.createDataFrame(data, S.SLEEP).coalesce(1).write.mode("append").parquet(folder)


# ---- T5: merged windows ----

def test_windows_split_and_measures_equal_the_batch(spark):
    chance = random.Random(1)
    data = []
    for user in range(6):
        t = 0.0
        for _ in range(chance.randint(1, 25)):
            t += chance.choice([0, 0.5, 3, 3.75, 4, 9])
            data.append((user, "w", at(t), at(t + chance.choice([0.25, 1, 3, 8, 20])), "ASLEEP", len(data)))
    batch = {(r.user_id, r.window_start): tuple(r)[2:] for r in I.merge_sleep_windows(spark.createDataFrame(data, S.SLEEP)).collect()}
    us = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    got = {}
    for user in range(6):
        instants = {}
        for _, _, a, b, _, _ in (d for d in data if d[0] == user):
            end, n = instants.get(us(a), (us(b), 0))
            instants[us(a)] = (max(end, us(b)), n + 1)
        for w in sessions.split([(s, *v) for s, v in instants.items()], round(3.75 * 3_600_000_000)):
            start, *measures = sessions.window_row(w)
            got[user, start.to_pydatetime()] = (measures[0].to_pydatetime(), *measures[1:])
    assert got.keys() == batch.keys()
    for k, want in batch.items():
        assert got[k] == pytest.approx(want) if not isinstance(want[0], dt.datetime) else got[k][1:] == pytest.approx(want[1:]) and got[k][0] == want[0]


def test_streamed_windows_equal_batch_with_nesting_and_disorder(spark, folder):
    # user 1: a short episode inside a long one, then one that bridges two windows and comes after both
    first = [(1, "w", at(0), at(9), "ASLEEP", 1), (1, "p", at(1), at(1.5), "REM", 2), (1, "w", at(12), at(13), "ASLEEP", 3), (2, "w", at(2), at(3), "ASLEEP", 4)]
    second = [(1, "w", at(4), at(9), "DEEP", 5), (2, "w", at(0), at(1), "ASLEEP", 6), (2, "w", at(2), at(2.5), "ASLEEP", 7), (None, "w", at(2), at(3), "ASLEEP", 8)]
    third = [(1, "w", at(40), at(47), "ASLEEP", 9), (2, "w", at(60), at(61), "ASLEEP", 10)]
    last = [(3, "w", at(400), at(401), "ASLEEP", 11)]
    for part in (first, second, third, last):
        land(spark, f"{folder}/in", part)
        q = sessions.merged_windows(streams.new_files(spark, f"{folder}/in", S.SLEEP)).writeStream.format("parquet").option(
            "path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    batch = I.merge_sleep_windows(spark.createDataFrame([r for r in first + second + third if r[0]], S.SLEEP))
    got = spark.read.parquet(f"{folder}/out")
    # the window of the newest rows is still open
    assert rows(got.select(*batch.columns)) == rows(batch)


# ---- T2: arrivals ----

def handler(spark, folder):
    some = spark.createDataFrame([], S.SLEEP)
    daily = I.daily_window_metrics(some)
    look = R.mean_std_z(daily, METRICS).select("user_id", "date", *[f"{m}_{k}" for m in METRICS for k in ("mean", "std", "zscore")])
    table = lambda name, schema, keys, **kw: StoredTable(spark, f"{folder}/{name}", schema, keys, buckets=2, bucket_by=("user_id",), **kw)
    return upkeep.Upkeep(
        table("records", S.SLEEP, ("user_id", "rec_id")), table("daily", daily.schema, ("user_id", "date"), month_of="date"),
        table("features", look.schema, ("user_id", "date"), month_of="date"), I.daily_window_metrics,
        lambda d: R.mean_std_z(d, METRICS).select(*look.columns), 30, F.to_date("start_ts"), [F.col("end_ts")], f"{folder}/work")


def nights(user, days, first_id):
    return [(user, "w", at(24 * d + 22), at(24 * d + 22 + 4 + (d * 7 + user) % 5), "ASLEEP", first_id + k) for k, d in enumerate(days)]


def test_arrivals_in_any_order_give_the_batch_table(spark, folder):
    early = nights(1, [d for d in range(75) if d != 3], 0) + nights(2, range(0, 40, 2), 200)
    late = nights(1, [3], 500)  # changes the features of the 30 rows from day 3 on
    moved = [(2, "w", at(24 * 50), at(24 * 50 + 6), "ASLEEP", 204)]  # a stored record with another date and a later end
    handle = handler(spark, folder)

    def run():
        src = streams.new_files(spark, f"{folder}/in", S.SLEEP)
        upkeep.maintain(src, handle, f"{folder}/ck").awaitTermination(300)

    land(spark, f"{folder}/in", early)
    run()
    before = {r[:2]: r for r in rows(handle.features.read())}
    parts = handle.features.parts()
    land(spark, f"{folder}/in", late)
    run()
    after = {r[:2]: r for r in rows(handle.features.read())}
    changed = {k for k in after if after[k] != before.get(k)}
    days = sorted((k[1] - BASE.date()).days for k in changed if k[0] == 1)
    assert {k[0] for k in changed} == {1} and days[0] == 3 and days[-1] == 32 and len(days) >= 29
    # March is out of reach and its part untouched
    assert {at for at, p in handle.features.parts().items() if p != parts[at]} <= {a for a in parts if a[1] in ("2024-01", "2024-02")}
    land(spark, f"{folder}/in", moved)
    run()
    handle(spark.createDataFrame(moved, S.SLEEP), 2)  # the last batch once more
    records = [r for r in early + late if r[5] != 204] + moved
    whole = spark.createDataFrame(records, S.SLEEP)
    assert rows(handle.daily.read()) == rows(I.daily_window_metrics(whole))
    assert rows(handle.features.read()) == rows(handle.look_back(I.daily_window_metrics(whole)))
    assert rows(handle.records.read()) == rows(whole)


def test_a_batch_that_died_half_way_is_played_again(spark, folder):
    handle = handler(spark, folder)
    handle(spark.createDataFrame(nights(1, range(8), 0), S.SLEEP), 0)
    moved = spark.createDataFrame([(1, "w", at(24 * 20), at(24 * 20 + 5), "ASLEEP", 2)], S.SLEEP)
    dying = dataclasses.replace(handle, summarise=lambda d: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # records are stored already, daily rows not
        dying(moved, 1)
    handle(moved, 1)
    assert rows(handle.daily.read()) == rows(I.daily_window_metrics(handle.records.read()))
    assert rows(handle.features.read()) == rows(handle.look_back(I.daily_window_metrics(handle.records.read())))
    assert handle.daily.read().filter("date = date'2024-01-03'").count() == 0


# ---- late rows ----

def test_stream_and_repair_equal_the_batch(spark, folder):
    def totals(df):
        return df.groupBy("user_id", F.to_date("start_ts").alias("date")).agg(F.count(F.lit(1)).alias("records"), F.sum("value").alias("total"))

    def record(user, hour, value):
        return (user, "p", at(hour), at(hour + 0.1), "STEP_COUNT", float(value), "count", int(hour * 100) + user)

    batches = [[record(u, h, h) for u in (1, 2) for h in range(0, 72, 6)], [record(1, h, h) for h in range(72, 120, 5)] + [record(2, 20, 5), record(2, 60, 7)],
               [record(1, 24.5, 9), record(3, 1, 1), record(2, 94.0, 3), record(2, 93.0, 3), record(1, 130, 2)], [record(1, 500, 0)]]
    for n, part in enumerate(batches):
        spark.createDataFrame(part, S.ACTIVITY).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        src = streams.new_files(spark, f"{folder}/in", S.ACTIVITY)
        upkeep.admit(src, f"{folder}/adm", f"{folder}/ck").awaitTermination(240)
        q = streams.daily_totals(upkeep.on_time(spark, f"{folder}/adm", S.ACTIVITY)).writeStream.format("parquet").option(
            "path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck2").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        assert all(s.numRowsDroppedByWatermark == 0 for p in [q.lastProgress] if p for s in p.stateOperators)
    # watermarks: 66 - 24 = 42, then 117 - 24 = 93
    want_late = [0, 1, 3, 0]
    assert [r.late for r in upkeep.admission(spark, f"{folder}/adm").orderBy("epoch").collect()] == want_late
    late, good = (upkeep.admitted(spark, f"{folder}/adm", S.ACTIVITY, x) for x in (True, False))
    assert late.count() == sum(want_late) and good.count() + late.count() == sum(map(len, batches))
    whole = spark.createDataFrame([r for part in batches for r in part], S.ACTIVITY)
    done = spark.read.parquet(f"{folder}/out")
    table = StoredTable(spark, f"{folder}/daily", done.schema, ("user_id", "date"), buckets=2, bucket_by=("user_id",), month_of="date")
    table.upsert(done, [F.col("records")])
    closed = F.col("date") < F.lit("2024-01-21").cast("date")  # the newest row's day is still open
    assert rows(table.read()) != rows(totals(whole).filter(closed))
    upkeep.repair(table, late, good.unionByName(late), totals, F.to_date("start_ts"))
    assert rows(table.read().filter(closed)) == rows(totals(whole).filter(closed))
