import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from diurna import schemas as S
from diurna.functions import exprs as E
from diurna.operators import circadian as C
from diurna.operators import cohort as CO
from diurna.operators import daily as D
from diurna.operators import features as X
from diurna.operators import intervals as I
from diurna.operators import missing as M
from diurna.operators import modelling as MO
from diurna.operators import ordering as O
from diurna.operators import light as P
from diurna.operators import rolling as R

BASE = dt.datetime(2024, 1, 1)


def t(hours):
    return BASE + dt.timedelta(seconds=round(hours * 3600))


def sleep(spark, *rows):
    """Rows of (start hour, end hour[, state[, user]])."""
    data = [(r[3] if len(r) > 3 else 1, "w", t(r[0]), t(r[1]), r[2] if len(r) > 2 else "ASLEEP", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, S.SLEEP)


def steps(spark, *rows):
    """Rows of (source, start hour, end hour, value)."""
    data = [(1, r[0], t(r[1]), t(r[2]), "STEP_COUNT", float(r[3]), "count", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, S.ACTIVITY)


def series(spark, values, name="y"):
    rows = [(1, (BASE + dt.timedelta(days=i)).date(), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"user_id long, date date, {name} double")


# ---- windows ------------------------------------------------------------------------

def brute_windows(episodes, threshold):
    """Plain restatement: gap from the previous episode in order, union of the window's intervals."""
    out = []
    for s, e in sorted(episodes):
        if out and s - out[-1][-1][1] <= threshold:
            out[-1].append((s, e))
        else:
            out.append([(s, e)])
    result = []
    for w in out:
        reach, total, gaps = -10 ** 9, 0, 0
        for i, (s, e) in enumerate(w):
            total += max(0, e - max(s, reach))
            reach = max(reach, e)
            if i and s > w[i - 1][1]:
                gaps += s - w[i - 1][1]
        result.append((w[0][0], reach, len(w), total, gaps))
    return result


def spark_windows(spark, episodes, threshold_minutes):
    rows = [(1, "w", BASE + dt.timedelta(minutes=s), BASE + dt.timedelta(minutes=e), "ASLEEP", i)
            for i, (s, e) in enumerate(episodes)]
    w = I.merge_sleep_windows(spark.createDataFrame(rows, S.SLEEP), threshold_hours=threshold_minutes / 60)
    return sorted((round((r.window_start - BASE).total_seconds() / 60), round((r.window_end - BASE).total_seconds() / 60),
                   r.episodes, round(r.hours * 60), round(r.gap_hours * 60)) for r in w.collect())


@pytest.mark.parametrize("gap,expected", [(3.75, 1), (3.75 + 1 / 3600, 2), (0.5, 1), (-0.5, 1)])
def test_threshold_is_inclusive(spark, gap, expected):
    w = I.merge_sleep_windows(sleep(spark, (0, 2), (2 + gap, 5 + gap)))
    assert w.count() == expected


def test_nested_episode_uses_previous_end_but_union_hours(spark):
    row = I.merge_sleep_windows(sleep(spark, (0, 8), (1, 2), (5.5, 6))).collect()
    assert len(row) == 1 and row[0].hours == 8.0 and row[0].episodes == 3
    # the short inner episode ends early, so a later start opens a window although the long one still runs
    assert I.merge_sleep_windows(sleep(spark, (0, 8), (1, 2), (6, 7))).count() == 2


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4000), st.integers(1, 700)), min_size=1, max_size=25), st.sampled_from([20, 60, 225]))
def test_windows_match_brute_force(spark, pairs, threshold):
    episodes = [(s, s + d) for s, d in pairs]
    assert spark_windows(spark, episodes, threshold) == sorted(brute_windows(episodes, threshold))


def test_skewed_user_and_copies(spark):
    random.seed(3)
    hot = [(s, s + random.randint(1, 300)) for s in (random.randint(0, 200_000) for _ in range(3000))] + [(500, 800)] * 2000
    assert spark_windows(spark, hot, 225) == sorted(brute_windows(hot, 225))


def test_ordered_scan_equals_plain_windows(spark):
    random.seed(5)
    rows = [(u, random.randint(0, 500_000), i, random.randint(0, 9)) for u in (1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "user_id long, at long, i long, v long")
    two = O.ordered_scan(df, ["user_id"], F.floor(F.col("at") / 10_000), ["at", "i"],
                         total=O.running_sum(F.col("v")), top=O.max_before(F.col("v")))
    w = "OVER (PARTITION BY user_id ORDER BY at, i"
    df.createOrReplaceTempView("scan_rows")
    plain = spark.sql(f"""SELECT *, sum(v) {w} ROWS UNBOUNDED PRECEDING) total,
      max(v) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) top FROM scan_rows""")
    assert sorted(map(tuple, two.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_adjacent_periods_merge_within_a_minute(spark):
    s = 1 / 3600
    assert I.merge_adjacent(sleep(spark, (0, 1), (1 + 60 * s, 2), (2 + 61 * s, 3))).count() == 2


# ---- days ---------------------------------------------------------------------------

@pytest.mark.parametrize("start,end,day", [
    (17.99, 18.5, "2024-01-01"), (18, 19, "2024-01-01"), (29.98, 31, "2024-01-01"), (30, 31, "2024-01-01"),
    (6, 7, "2023-12-31"), (11, 14, "2024-01-01"), (23.5, 31, "2024-01-01")])
def test_sleep_day(spark, start, end, day):
    assert str(D.with_sleep_date(sleep(spark, (start, end))).collect()[0].date) == day


def test_fragmentation_counts_negative_gaps(spark):
    row = D.daily_sleep(sleep(spark, (20, 22), (21.5, 24), (25, 27), (20, 28, "IN_BED"))).collect()[0]
    assert row.fragmentation == pytest.approx(((21.5 - 22) + (25 - 24)) / 7)
    assert row.sleep_sessions == 3 and row.bed_hours == 14.5 and row.sleep_hours == 6.5
    assert D.daily_sleep(sleep(spark, (20, 22))).collect()[0].fragmentation == 0.0


def test_duplicate_periods_from_two_sources_count_once(spark):
    df = steps(spark, ("a", 8, 9, 100), ("b", 8, 9, 120), ("a", 10, 11, 50))
    assert D.deduped_steps(df).collect()[0].steps == 170.0


def test_peak_hour_tie_takes_the_earlier(spark):
    assert D.peak_hours(steps(spark, ("a", 15, 15, 10), ("a", 9, 9, 10))).collect()[0].peak_hour == 9


def test_empty_inputs(spark):
    none = sleep(spark, (0, 1)).limit(0)
    assert D.daily_sleep(none).count() == 0 and I.merge_sleep_windows(none).count() == 0
    assert I.daily_window_metrics(none).count() == 0


# ---- rolling ------------------------------------------------------------------------

def test_thirty_row_window_evicts(spark):
    values = [1000.0] * 5 + [float(i % 7) for i in range(35)]
    last = R.mean_std_z(series(spark, values), ["y"]).orderBy(F.desc("date")).first()
    assert last.y_mean == pytest.approx(np.mean(values[-30:])) and last.y_std == pytest.approx(np.std(values[-30:]))


def test_zero_variance_scores_zero(spark):
    df = series(spark, [5.0] * 12)
    assert {r.y_zscore for r in R.mean_std_z(df, ["y"]).collect()} == {0.0}
    assert {r.score for r in R.anomaly_scores(df, "y", 5).collect()} == {0.0}
    assert R.periodicity(df, "y").collect()[0].dominant_period_days == 0
    assert R.trend(df, "y", 7).filter("r_squared <> 0 OR NOT is_stable").count() == 0


def test_weekly_period_is_found(spark):
    row = R.periodicity(series(spark, [10.0 if i % 7 == 3 else 1.0 for i in range(42)]), "y").collect()[0]
    assert (row.dominant_period_days, row.phase_shift) == (7, 3.0)


def test_change_point_positions(spark):
    values = [1.0, 1.1, 0.9, 1.0, 1.1, 1.0] * 2 + [9.0, 9.1, 8.9, 9.0, 9.1, 9.0] * 2
    found = {r.position: r.direction for r in R.change_points(series(spark, values), "y").collect()}
    assert found[12] == "increase"
    assert R.change_points(series(spark, values[:9]), "y").count() == 0


@pytest.mark.parametrize("df,t_value", [(1, 12.706), (2, 4.303), (5, 2.571), (10, 2.228), (29, 2.045), (30, 2.042)])
def test_student_probability_at_known_critical_values(spark, df, t_value):
    p = spark.range(1).select(R.t_two_sided(F.lit(t_value), F.lit(df)).alias("p")).first().p
    assert p == pytest.approx(0.05, abs=2e-4)


def test_duration_vs_calendar_frames_differ(spark):
    df = series(spark, [1, 2, 3]).filter("date <> DATE '2024-01-02'")
    row = df.select("date", F.count("y").over(R.days(-1)).alias("near"), F.count("y").over(R.rows(-1)).alias("rows"))
    assert [(r.near, r.rows) for r in row.orderBy("date").collect()] == [(1, 1), (1, 2)]


# ---- circadian -----------------------------------------------------------------------

def test_records_are_spread_over_all_their_days(spark):
    rows = spark.sql("""SELECT 1L AS user_id, 'STEP_COUNT' AS activity_type, v AS value,
        TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, a) AS start_ts,
        TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, b) AS end_ts
        FROM VALUES (30.0D, 0, 2), (10.0D, 1439, 1440), (7.0D, 20000, 20000) AS t(v, a, b)""")
    got = {(str(r.date), r.minute): r.value for r in C.spread_minutes(rows).collect()}
    assert got == {("2024-01-01", 0): 10, ("2024-01-01", 1): 10, ("2024-01-01", 2): 10, ("2024-01-01", 1439): 5,
                   ("2024-01-02", 0): 5, ("2024-01-14", 1280): 7}


def test_days_with_enough_sleep(spark):
    nights = sleep(spark, *[(24 * d, 24 * d + 8) for d in (0, 1, 5, 25)])
    cal = C.user_calendar(nights.select("user_id", F.to_date("start_ts").alias("date")))
    first = cal.agg(F.min("date")).first()[0]
    days = sorted((r.date - first).days for r in P.eligible_days(nights, cal).collect())
    assert days == list(range(5, 14))


def test_hour_end_does_not_mark_next_hour(spark):
    hours = [r.hour for r in I.sleep_hours_of_day(sleep(spark, (22, 24))).orderBy("hour").collect()]
    assert hours == [22, 23]


def test_identical_days_are_perfectly_stable(spark):
    df = steps(spark, *[("a", 24 * d + h, 24 * d + h, 100 * (h > 8)) for d in range(4) for h in range(24)])
    row = C.rhythm(C.hourly_wide(df)).collect()[0]
    assert row.interdaily_stability == pytest.approx(1.0) and row.relative_amplitude == pytest.approx(1.0)
    assert (row.l5_start, row.days) == (0, 4) and row.l5_consistency == pytest.approx(1.0)


def test_dense_week_matches_sparse_minutes(spark):
    df = steps(spark, *[("a", 24 * d + 8 + m / 60, 24 * d + 8 + m / 60, 5) for d in (0, 2, 6) for m in range(30)])
    minutes = C.minute_totals(df)
    cal = C.user_calendar(minutes)
    week = C.weekly_sequences(minutes, cal).collect()[0]
    assert len(week.activity) == 10080 and len(week.missing_days) == 4
    f = C.weekly_features(minutes, cal).orderBy(F.desc("date")).first()
    v = np.array(week.activity)
    assert f.total_activity == pytest.approx(v.sum()) and f.active_minutes == (v > 0).sum()
    assert f.fragmentation == pytest.approx(np.sum(np.diff(v > 0)) / 10080)
    assert f.peak_activity == pytest.approx(np.sort(v)[::-1][:1008].mean())
    assert f.pat_hour == pytest.approx(np.average(np.arange(168), weights=v.reshape(168, 60).sum(1)) % 24)


# ---- missing -------------------------------------------------------------------------

def test_linear_fill_both_sides_with_limit(spark):
    grid = series(spark, range(10)).withColumn("y", F.when(F.dayofmonth("date").isin(3, 10), F.col("y")))
    got = [r.y for r in M.fill_linear(grid, ["y"], 2).orderBy("date").collect()]
    assert got == [2, 2, 2, 3, 4, None, None, 7, 8, 9]


def test_density_classes(spark):
    dense = M.density(series(spark, range(20))).collect()[0]
    assert (dense.density_class, dense.coverage, dense.max_gap_days) == ("dense", 1.0, 0)
    thin = M.density(series(spark, range(60)).filter("dayofmonth(date) IN (1, 25)")).collect()[0]
    assert thin.density_class == "very_sparse"


def test_unmatched_prescription_is_kept(spark):
    rx = spark.createDataFrame([(1, 5), (2, 9)], "user_id long, drug_key long")
    drugs = spark.createDataFrame([(5, "Alprazolam 1mg")], "drug_key long, drug_id string")
    classes = {"benzodiazepine": CO.BENZODIAZEPINES, "ssri": CO.SSRIS}
    got = {r.user_id: (r.benzodiazepine, r.ssri) for r in CO.medication_flags(rx, drugs, classes).collect()}
    assert got == {1: (1, 0), 2: (0, 0)} and CO.with_drug_id(rx, drugs).count() == 2


def test_conflicts_match_brute_force(spark):
    random.seed(11)
    day = lambda n: (BASE + dt.timedelta(days=n)).date()
    make = lambda k: [(u, day(s), day(s + random.randint(0, 9)), i) for u in (1, 2)
                      for i, s in enumerate(random.sample(range(200), k))]
    have, ask = make(15), make(30)
    cols = "user_id long, start_date date, end_date date, i int"
    got = I.conflicting(spark.createDataFrame(ask, cols), spark.createDataFrame(have, cols))
    want = sorted((a[0], a[3]) for a in ask if any(h[0] == a[0] and h[1] <= a[2] and h[2] >= a[1] for h in have))
    assert sorted((r.user_id, r.i) for r in got.collect()) == want


def test_questionnaire_totals(spark):
    rows = [(1, *[0] * 8, 2), (2, *[1] * 9), (3, *[3] * 9)]
    items = [f"q{i}" for i in range(1, 10)]
    df = spark.createDataFrame(rows, "user_id long, " + ", ".join(f"{i} int" for i in items))
    got = {r.user_id: (r.total, r.depressed) for r in CO.questionnaire(df, items).collect()}
    assert got == {1: (2, 0), 2: (9, 0), 3: (27, 1)}


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, .9), (1, .5), (0, .5), (0, .1), (1, .1)], "y int, s double")
    assert MO.auc(df, "y", "s").first().auc == pytest.approx((1 + 1 + .5 + 1 + 0 + .5) / 6)


def test_ensemble_falls_back(spark):
    cols = "user_id long, date date, depression double, hypomanic double, manic double, confidence double"
    d1, d2 = BASE.date(), (BASE + dt.timedelta(days=1)).date()
    a = spark.createDataFrame([(1, d1, .5, .5, .5, .4)], cols)
    b = spark.createDataFrame([(1, d1, 1., .0, .0, .8), (1, d2, .3, .2, .1, .6)], cols)
    got = [tuple(r)[2:] for r in MO.ensemble(a, b).orderBy("date").collect()]
    assert got[0] == pytest.approx((.7, .3, .3, .6)) and got[1] == pytest.approx((.3, .2, .1, .6))


@pytest.mark.parametrize("shape", ["margins", "crowded", "one value"])
def test_auc_of_any_scores(spark, shape):
    random.seed(4)
    draw = {"margins": lambda: random.gauss(0, 1e4), "crowded": lambda: random.choice([random.random(), 1e-9 * random.randint(0, 400)] ),
            "one value": lambda: 3.0}[shape]
    rows = [(random.randint(0, 1), draw()) for _ in range(700)]
    got = MO.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first().auc
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    assert got == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)))


def test_required_training_columns(spark):
    with pytest.raises(ValueError, match="missing columns: b"):
        MO.train(spark.createDataFrame([(1.0, 1.0)], "a double, y double"), ["a", "b"], "y")


def test_external_model_hook(spark):
    from pyspark.sql import types as T
    out = MO.with_model(series(spark, [1, 2]), lambda p: p[["user_id"]].assign(s=p["y"] * 2),
                        T.StructType([T.StructField("user_id", T.LongType()), T.StructField("s", T.DoubleType())]))
    assert sorted(r.s for r in out.collect()) == [2.0, 4.0]


def test_enhanced_vector_pads(spark):
    v = spark.range(1).select(MO.enhanced_vector(F.array(*[F.lit(1.0)] * 36), F.array(F.lit(2.0))).alias("v")).first().v
    assert v == [1.0] * 20 + [2.0] + [0.0] * 15


@pytest.mark.parametrize("text,value", [("123.0", 123), ("x", 0), ("-2.5", -2), (None, 0)])
def test_safe_int(spark, text, value):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(E.safe_int("x").alias("v")).first().v == value


@pytest.mark.parametrize("text,want", [("2024-03-01 08:09:10 -0800", dt.datetime(2024, 3, 1, 8, 9, 10)),
                                       ("2024-03-01T08:09:10Z", dt.datetime(2024, 3, 1, 8, 9, 10)),
                                       ("2024-03-01", dt.datetime(2024, 3, 1)), ("soon", None)])
def test_timestamp_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(E.local_timestamp("x").alias("v")).first().v == want


def test_day_without_any_sensor_has_null_features(spark):
    cal = series(spark, range(3)).select("user_id", "date")
    got = X.for_dates(series(spark, range(2)), cal).orderBy("date").collect()
    assert [r.y for r in got] == [0.0, 1.0, None]


@pytest.mark.parametrize("a,b,hit", [((0, 2), (2, 3), False), ((0, 2), (1, 3), True), ((0, 5), (1, 2), True)])
def test_half_open_overlap(spark, a, b, hit):
    df = spark.createDataFrame([(*a, *b)], "s1 int, e1 int, s2 int, e2 int")
    assert df.select(E.overlaps("s1", "e1", "s2", "e2").alias("v")).first().v is hit


@pytest.mark.parametrize("phq,strict,inclusive", [(4, "low", "low"), (9, "moderate", "low"), (14, "high", "moderate"),
                                                  (19, "high", "high"), (20, "high", "critical"), (27, "critical", "critical")])
def test_band_edges_differ_between_the_two_readings(spark, phq, strict, inclusive):
    from diurna.operators import rules
    df = spark.createDataFrame([(1, BASE.date(), phq, 7.5, 8000.0, False)],
                               "user_id long, date date, phq int, sleep_hours double, steps double, suicidal boolean")
    assert rules.depression_risk(df).first().risk_level == strict
    assert rules.depression_episode(df).first().risk_level == inclusive


def test_missing_inputs_lower_confidence(spark):
    from diurna.operators import rules
    df = spark.createDataFrame([(1, BASE.date(), 12, None, None, False)],
                               "user_id long, date date, phq int, sleep_hours double, steps double, suicidal boolean")
    row = rules.depression_risk(df).first()
    assert row.confidence == pytest.approx(0.81) and row.missing_factors == ["sleep data", "activity data"]
    assert row.rationale.endswith("(limited data: sleep data, activity data missing)")


# ---- numbers and gaps -----------------------------------------------------------------

def test_running_deviation_of_large_values(spark):
    rows = [(1, i, 1e8 + (i % 2) * 2) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id long, d int, y double").select(
        "user_id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("date"), "y")
    last = R.incremental_baseline(df, "y").orderBy(F.desc("date")).first()
    assert last.mean == pytest.approx(1e8 + 1) and last.std == pytest.approx(1.0, abs=1e-6)


def test_seed_per_user(spark):
    df = spark.createDataFrame([(u, i, float(v)) for u in (1, 2, 3) for i, v in enumerate((4, 8))], "user_id long, d int, y double").select(
        "user_id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("date"), "y")
    seeds = spark.createDataFrame([(1, 6.0, 1.0, 20), (2, 10.0, 0.0, 3)], "user_id long, mean double, std double, n int")
    got = {r.user_id: r for r in R.incremental_baseline(df, "y", seeds).filter("date = DATE '2024-01-02'").collect()}
    for user, (mean, std, n) in {1: (6.0, 1.0, 20), 2: (10.0, 0.0, 7), 3: (0.0, 0.0, 0)}.items():
        total = n + 2
        want = (n * mean + 12) / total
        spread = (n * (std ** 2 + mean ** 2) + 16 + 64) / total - want ** 2
        assert got[user].n == total and got[user].mean == pytest.approx(want) and got[user].std == pytest.approx(spread ** 0.5)


def test_missing_inputs_are_scored(spark):
    rows = [(i, None if i % 5 == 0 else float(i % 10), float(i % 3), float(i % 10 > 4) if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, a double, b double, y double")
    out = MO.score(df, {"risk": MO.train(df, ["a", "b"], "y", rounds=2)}, {"risk": "y"})
    assert out.count() == 60 and out.filter("risk IS NULL").count() == 0 and set(df.columns) < set(out.columns)
