"""Steps against sleep of users whose days never vary: corr divides by zero there, the SQL gives 0."""

import datetime as dt

import numpy as np
import pytest

import __spark_entry__ as entry
from diurna.operators import rolling as R

BASE = dt.date(2024, 1, 1)
VARIED = [(4.0, 1.0), (1.0, 2.0), (3.0, 2.5), (9.0, 3.0), (2.0, 1.5)]


def correlated(spark, users, lag=0):
    """Users as lists of (x, y), a day each."""
    rows = [(u, BASE + dt.timedelta(days=i), x, y) for u, days in enumerate(users) for i, (x, y) in enumerate(days)]
    df = spark.createDataFrame(rows, "user_id long, date date, x double, y double")
    return {r.user_id: tuple(r)[1:] for r in R.correlation(df.drop("y"), df.drop("x"), "x", "y", lag).collect()}


def expected(days):
    x, y = zip(*days)
    ranks = lambda v: [sum(a < b for a in v) + (v.count(b) + 1) / 2 for b in v]
    return np.corrcoef(x, y)[0, 1], np.corrcoef(ranks(x), ranks(y))[0, 1]


def test_constant_series_correlate_with_nothing(spark):
    still_x, still_y = [(0.1, y) for _, y in VARIED], [(x, 0.1) for x, _ in VARIED]
    got = correlated(spark, [VARIED, still_x, still_y, [(0.1, 0.1)] * 7, VARIED[:1], [(None, 1.0), (None, 2.0), (None, 3.0)]])
    assert got[0][0] == 5 and got[0][1:3] == pytest.approx(expected(VARIED), abs=1e-12) and 0 < got[0][3] < 1
    assert {u: got[u] for u in range(1, 5)} == {u: (n, 0.0, 0.0, 1.0, False) for u, n in ((1, 5), (2, 5), (3, 7), (4, 1))}
    assert got[5] == (3, 0.0, 0.0, 1.0, False)


def test_rows_without_a_value_stay_out(spark):
    got = correlated(spark, [[*VARIED, (None, 50.0)], [(0.1, 1.0), (None, 2.0), (0.1, 3.0)]])
    assert got[0][0] == 6 and got[0][1] == pytest.approx(expected(VARIED)[0], abs=1e-12)
    assert got[1][:2] == (3, 0.0)


def test_lagged_query_on_a_user_who_varies_on_the_last_day_only(spark, folder):
    """The lag leaves the last day's steps out, so what varies without it is constant with it."""
    rows = []
    for user, walked in ((1, [5.0, 5.0, 5.0, 5.0, 8.0]), (2, [4.0, 1.0, 3.0, 9.0, 2.0])):
        for i, value in enumerate(walked):
            morning, night = (dt.datetime(2024, 1, 1 + i, h) for h in (10, 22))
            rows += [(100 * user + 2 * i, morning, user, "click", value), (1000 * user + 10 * i + 5, night, user, "view", 0.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    queries = entry.queries()
    now, next_day = ({r.user_id: r for r in queries[f"steps_sleep_{q}"](spark, folder).collect()} for q in ("correlation", "lagged_correlation"))
    assert now[1].n == 5 and now[1].pearson_r != 0
    assert tuple(next_day[1]) == (1, 4, 0.0, 0.0, 1.0, False)
    slept = [20 + (2000 + 10 * i + 5) * 37 % 460 for i in range(5)]
    assert next_day[2].n == 4 and tuple(next_day[2])[2:4] == pytest.approx(
        expected([*zip((4.0, 1.0, 3.0, 9.0), slept[1:])]), abs=1e-6)
