"""Three risks from one fit: no night is scored by a model that saw it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from diurna.operators import modelling as MO
from diurna.operators import thresholds as TH

LABELS = {"depression": "a_label", "hypomanic": "b_label", "manic": "c_label"}
SCHEMA = "user_id long, date date, x double, y double, a_label int, b_label int, c_label int"


def nights(seed=1, users=12, days=50):
    chance = random.Random(seed)
    out = []
    for u in range(users):
        for d in range(days):
            x, y = chance.random(), chance.random()
            noisy = lambda p: int(chance.random() < p)
            out.append((u, dt.date(2024, 1, 1) + dt.timedelta(days=d), x if d % 17 else None, y, noisy(0.9 if x > 0.5 else 0.1),
                        noisy(0.85 if y < 0.3 else 0.1), None if d % 9 == 0 else noisy(0.5)))
    return out


def scored(spark, rows, folder):
    df = spark.createDataFrame(rows, SCHEMA)
    flagged = df.join(MO.split_flags(df), ["user_id", "date"])
    models = MO.fit_risks(flagged, ["x", "y"], LABELS, folder)
    return {(r.user_id, r.date): r for r in MO.score_risks(flagged, models, list(LABELS)).collect()}


@pytest.fixture(scope="module")
def base(spark):
    import tempfile

    return scored(spark, nights(), tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/cells")


def auc(pairs):
    up, down = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))


def test_each_risk_is_learned_out_of_fold(base):
    rows = {(r[0], r[1]): r for r in nights()}
    assert len(base) == 12 * 30  # the last three fifths of every user's nights
    assert auc([(s.depression, rows[k][4]) for k, s in base.items()]) > 0.8
    assert auc([(s.hypomanic, rows[k][5]) for k, s in base.items()]) > 0.8
    assert 0.35 < auc([(s.manic, rows[k][6]) for k, s in base.items() if rows[k][6] is not None]) < 0.65
    assert all(0 < r[c] < 1 for r in base.values() for c in ("depression", "hypomanic", "manic")) and all(0 <= r.confidence <= 1 for r in base.values())


def test_labels_of_a_night_do_not_reach_its_score(spark, base, folder):
    # the labels of the last block of every user are turned round: nothing may change for these nights
    first = dt.date(2024, 1, 1) + dt.timedelta(days=40)
    turned = [r[:4] + tuple(None if v is None else 1 - v for v in r[4:]) if r[1] >= first else r for r in nights()]
    again = scored(spark, turned, folder + "/cells")
    assert again.keys() == base.keys()
    assert all(tuple(again[k])[2:] == pytest.approx(tuple(base[k])[2:], abs=1e-9) for k in base)
    # those of the first nights teach every fold
    turned = [r[:4] + tuple(None if v is None else 1 - v for v in r[4:]) if r[1] < dt.date(2024, 1, 11) else r for r in nights()]
    other = scored(spark, turned, folder + "/cells2")
    assert all(abs(other[k].depression - base[k].depression) > 1e-6 for k in base)


def test_parameters_of_the_narrowest_scope_win(spark):
    rows = [(None, None, "elevated_steps", 9000.0), (None, "b", "elevated_steps", 8000.0), (1, None, "elevated_steps", 7000.0),
            (2, None, "sleep_sensitivity", 2.0), (3, "b", "extreme_steps", 1.0), (4, None, "extreme_steps", 8500.0), (5, None, "wrong", 1.0),
            (6, None, "extreme_steps", None), (7, None, "reduced_sleep", 1.0), (7, None, "reduced_sleep", 2.0)]
    parameters = spark.createDataFrame(rows, TH.PARAMETERS)
    reasons = {(r.user_id, r["name"]): r.reason for r in TH.checked(parameters).collect()}
    assert reasons[3, "extreme_steps"] == "two scopes" and reasons[5, "wrong"] == "unknown name"
    assert reasons[6, "extreme_steps"] == "no value" and reasons[7, "reduced_sleep"] == "set twice" and reasons[1, "elevated_steps"] is None
    users = spark.range(1, 9).select(F.col("id").alias("user_id"))
    members = users.filter("user_id <> 4").select("user_id", F.when(F.col("user_id") < 3, "b").otherwise("c").alias("cohort"))
    got = {r.user_id: r for r in TH.attach(users, parameters, members).collect()}
    assert [got[u].limits.elevated_steps for u in range(1, 9)] == [7000, 8000, 9000, 9000, 9000, 9000, 9000, 9000]
    assert got[2].personal and not got[1].personal and got[2].limits.sleep_sensitivity == 2.0
    assert got[4].limits_rise is False and got[5].limits_rise and got[7].limits.reduced_sleep == 5.0
    none = TH.attach(users, spark.createDataFrame([], TH.PARAMETERS)).collect()
    assert all(r.limits.asDict() == TH.DEFAULTS for r in none)
