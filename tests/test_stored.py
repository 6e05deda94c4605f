"""Stored tables: touched parts, one-step versions, lookups."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from diurna.sources.stored import StoredTable

SCHEMA = "user_id long, date date, value double, seen long"


@pytest.fixture
def daily(spark, folder):
    rows = [(u, dt.date(2024, 1, 1) + dt.timedelta(days=d), float(u * d), 1) for u in range(40) for d in range(0, 90, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    table = StoredTable(spark, f"{folder}/t", df.schema, ("user_id", "date"), buckets=8, bucket_by=("user_id",), month_of="date")
    table.upsert(df, [F.col("seen")])
    return table


def pick(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(table):
    return {p: p.stat().st_mtime_ns for p in Path(table.folder).rglob("part-*.parquet")}


def test_a_small_batch_rewrites_only_its_parts(spark, daily):
    before, rows, parts = files(daily), pick(daily.read()), daily.parts()
    assert len(rows) == 1200 and len(parts) == 24
    batch = spark.createDataFrame([(3, dt.date(2024, 1, 1), -1.0, 2), (3, dt.date(2024, 1, 2), -2.0, 2), (3, dt.date(2024, 1, 4), -9.0, 0)], SCHEMA)
    daily.upsert(batch, [F.col("seen")])
    after = daily.parts()
    assert len({at for at in after if after[at] != parts.get(at)}) == 1
    assert {p: t for p, t in files(daily).items() if p in before} == before
    assert len(files(daily)) - len(before) <= 2
    want = {(r[0], r[1]): r for r in rows} | {(3, dt.date(2024, 1, 1)): (3, dt.date(2024, 1, 1), -1.0, 2), (3, dt.date(2024, 1, 2)): (3, dt.date(2024, 1, 2), -2.0, 2)}
    assert pick(daily.read()) == sorted(want.values(), key=str)


def test_a_killed_run_leaves_the_old_version(spark, daily, monkeypatch):
    rows, version = pick(daily.read()), daily.versions()
    batch = spark.createDataFrame([(3, dt.date(2024, 1, 1), -1.0, 2)], SCHEMA)

    def killed(self, parts):
        # data and half of the list are written when the run dies
        folder = Path(self.folder) / "versions" / "00000002"
        folder.mkdir()
        (folder / "part-00000.json").write_text('{"bucket":0')
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_commit", killed)
        with pytest.raises(RuntimeError):
            daily.upsert(batch, [F.col("seen")])
    assert daily.versions() == version and pick(daily.read()) == rows
    daily.upsert(batch, [F.col("seen")])  # the run that is started again
    assert daily.versions() == [1, 3]
    got = pick(daily.read())
    assert (3, dt.date(2024, 1, 1), -1.0, 2) in got and len(got) == len(rows)
    assert pick(daily.read(version=1)) == rows
    daily.tidy(keep=1)
    assert daily.versions() == [3] and pick(daily.read()) == got
    assert len(list((Path(daily.folder) / "data").iterdir())) == 2


def test_replaced_keys(spark, daily):
    scope = spark.createDataFrame([(5, dt.date(2024, 1, 4)), (5, dt.date(2024, 2, 6)), (6, dt.date(2030, 1, 1)), (None, None)], "user_id long, date date")
    rows = spark.createDataFrame([(5, dt.date(2024, 2, 6), 0.5, 9), (None, None, 1.0, 1)], SCHEMA)
    before = pick(daily.read())
    daily.replace(scope, rows)
    left = [r for r in before if r[:2] not in ((5, dt.date(2024, 1, 4)), (5, dt.date(2024, 2, 6)))]
    assert pick(daily.read()) == sorted([*left, (5, dt.date(2024, 2, 6), 0.5, 9), (None, None, 1.0, 1)], key=str)
    daily.replace(scope, rows)  # a replay changes nothing
    assert len(pick(daily.read())) == len(left) + 2


def test_empty_batches_and_tables(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    table = StoredTable(spark, f"{folder}/e", schema, ("user_id", "date"))
    none = spark.createDataFrame([], SCHEMA)
    assert table.upsert(none, [F.col("seen")]) == 0 and table.read().collect() == []
    assert table.lookup(none).collect() == []
    with pytest.raises(ValueError):
        StoredTable(spark, folder, schema, ("user_id",), month_of="date")


def test_lookup_opens_one_bucket_and_skips_row_groups(spark, folder):
    df = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.col("id").alias("v"))
    table = StoredTable(spark, f"{folder}/l", df.schema, ("k",), buckets=16, bloom=("k",))
    table.upsert(df, [F.col("v")])
    one = table.lookup(spark.createDataFrame([("k77",)], "k string"))
    assert [r.v for r in one.collect()] == [77]
    assert len(one.inputFiles()) < len(table.read().inputFiles()) / 8
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "k77" in plan
    some = table.lookup(spark.createDataFrame([("k5",), ("absent",), ("k19999",), ("k5",)], "k string"))
    assert sorted(r.v for r in some.collect()) == [5, 19999]
    assert table.lookup(spark.createDataFrame([("absent",)], "k string")).collect() == []


def test_baseline_as_known_at_a_time(spark):
    import random

    from diurna.operators import cohort

    chance = random.Random(3)
    day, now = (lambda n: dt.date(2023, 1, 1) + dt.timedelta(days=n)), (lambda n: dt.datetime(2023, 1, 1) + dt.timedelta(days=n))
    versions = [(chance.randint(1, 4), day(chance.randint(0, 300)), now(chance.randint(0, 400) + chance.random()), float(i)) for i in range(400)]
    versions += [(1, None, now(3), -1.0), (2, day(5), None, -2.0), (9, day(5), now(500), -3.0)]
    asked = [(chance.randint(1, 5), day(chance.randint(-5, 420)), now(chance.randint(-5, 420)), i) for i in range(300)]
    asked += [asked[0], (9, day(6), now(499), -1), (9, day(6), now(501), -2), (None, day(6), now(1), -3)]
    got = cohort.as_known(
        spark.createDataFrame(asked, "user_id long, date date, known_at timestamp_ntz, no long"),
        spark.createDataFrame(versions, "user_id long, as_of date, effective_ts timestamp_ntz, mean double"), ["user_id"]).collect()

    def best(user, date, at):
        seen = [(a, e, m) for u, a, e, m in versions if u == user and a and e and a <= date and e <= at]
        return max(seen)[2] if seen else None

    assert sorted((tuple(r)[:4], r.mean) for r in got if r.user_id) == sorted((q, best(*q[:3])) for q in asked if q[0])
    assert len(got) == len(asked)
    # a correction is seen by those who ask after it came, and only by them
    rows = [(7, day(10), now(11), 1.0), (7, day(10), now(40), 2.0), (7, day(20), now(60), 3.0)]
    v = spark.createDataFrame(rows, "user_id long, as_of date, effective_ts timestamp_ntz, mean double")
    q = spark.createDataFrame([(7, day(30), now(n)) for n in (5, 30, 45, 61)], "user_id long, date date, known_at timestamp_ntz")
    assert [r.mean for r in cohort.as_known(q, v, ["user_id"]).orderBy("known_at").collect()] == [None, 1.0, 2.0, 3.0]
