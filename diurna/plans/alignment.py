"""Alignment, missing-data and island queries."""

from pyspark.sql import functions as F

from diurna.operators import daily as D
from diurna.operators import intervals as I
from diurna.operators import missing as M
from diurna.plans.nights import r
from diurna.plans.registry import query, view

NIGHTS = lambda t: D.daily_sleep(t.sleep)
ACTS = lambda t: D.daily_activity(t.activity)
HEARTS = lambda t: D.daily_heart(t.heart)
K = ["user_id", "date"]
KEYS = lambda d: d.select(*K)

query("consecutive_day_windows", "G7", """
  WITH d AS (SELECT DISTINCT user_id, date FROM nights),
  g AS (SELECT *, date - row_number() OVER (PARTITION BY user_id ORDER BY date)::INTEGER AS g FROM d)
  SELECT user_id, min(date) AS first_day, max(date) AS last_day, count(*) AS days FROM g
  GROUP BY user_id, g HAVING count(*) >= 3""")(lambda t: I.date_runs(D.with_sleep_date(t.sleep)))
view("overlap_runs", """
  SELECT user_id, min(date) AS first_day, max(date) AS last_day, count(*) AS days FROM (
    SELECT user_id, date, date - row_number() OVER (PARTITION BY user_id ORDER BY date)::INTEGER AS g
    FROM (SELECT user_id, date FROM nights INTERSECT SELECT user_id, date FROM act_days))
  GROUP BY user_id, g HAVING count(*) >= 3""")
query("overlap_windows", "G8 U2", "SELECT * FROM overlap_runs")(lambda t: I.overlap_runs(NIGHTS(t), ACTS(t)))
query("overlap_recommendation", "G9", """
  WITH o AS (SELECT user_id, count(*) AS runs, max(days) AS longest FROM overlap_runs GROUP BY user_id)
  SELECT user_id, coalesce(runs, 0) AS runs, coalesce(longest, 0) AS longest_days,
         CASE WHEN runs IS NULL THEN 'Use sensor-specific analysis'
              WHEN runs = 1 AND longest - 1 < 7 THEN 'Limited overlap - use with caution'
              ELSE 'Sufficient overlap for integrated analysis' END AS advice
  FROM (SELECT DISTINCT user_id FROM nights) LEFT JOIN o USING (user_id)""")(
    lambda t: I.overlap_advice(I.overlap_runs(NIGHTS(t), ACTS(t)), NIGHTS(t).select("user_id").distinct()))
query("sedentary_streaks", "G10", """
  WITH n AS (
    SELECT user_id, date, sedentary_hours >= 1.0 AS f, row_number() OVER (PARTITION BY user_id ORDER BY date) AS i FROM act_days),
  g AS (SELECT user_id, i - row_number() OVER (PARTITION BY user_id ORDER BY date) AS g FROM n WHERE f),
  l AS (SELECT user_id, count(*) AS n FROM g GROUP BY user_id, g)
  SELECT a.user_id, coalesce(max(n), 0) AS longest_streak FROM (SELECT DISTINCT user_id FROM act_days) a
  LEFT JOIN l USING (user_id) GROUP BY a.user_id""")(
    lambda t: I.longest_run(ACTS(t), ["user_id"], "date", F.col("sedentary_hours") >= 1.0, "longest_streak"))
query("longest_missing_run", "G12", """
  WITH c AS (
    SELECT user_id, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
    FROM (SELECT user_id, min(date) AS lo, max(date) AS hi FROM nights GROUP BY user_id)),
  m AS (SELECT c.user_id, c.date FROM c ANTI JOIN nights USING (user_id, date)),
  g AS (SELECT user_id, date - row_number() OVER (PARTITION BY user_id ORDER BY date)::INTEGER AS g FROM m),
  l AS (SELECT user_id, count(*) AS n FROM g GROUP BY user_id, g)
  SELECT u.user_id, coalesce(max(n), 0) AS longest_missing FROM (SELECT DISTINCT user_id FROM nights) u
  LEFT JOIN l USING (user_id) GROUP BY u.user_id""")(
    lambda t: I.longest_run(M.complete_grid(NIGHTS(t)), ["user_id"], "date", F.col("sleep_hours").isNull(), "longest_missing"))
query("merged_adjacent_periods", "P12", """
  WITH s AS (
    SELECT user_id, start_ts, end_ts, max(end_ts) OVER (PARTITION BY user_id ORDER BY start_ts, end_ts
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM activity),
  g AS (
    SELECT *, sum(CASE WHEN reach IS NULL OR epoch_us(start_ts) - epoch_us(reach) > 60000000 THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY start_ts, end_ts) AS g FROM s)
  SELECT user_id, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS periods FROM g GROUP BY user_id, g""")(
    lambda t: I.merge_adjacent(t.activity))
query("expand_periods_to_days", "G13", """
  SELECT user_id, rec_id, episode_type, severity,
         unnest(generate_series(start_date::TIMESTAMP, end_date::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM episodes""")(
    lambda t: I.expand_days(t.episodes, "user_id", "rec_id", "episode_type", "severity"))

# ---- joins ---------------------------------------------------------------------
SUMS = ["sleep_hours", "efficiency", "steps", "energy", "avg_resting_hr", "avg_hrv"]
query("joined_daily_summaries", "J1 U1", f"""
  WITH j AS (
    SELECT user_id, date, coalesce(sleep_hours, 0.0) AS sleep_hours, coalesce(efficiency, 0.0) AS efficiency,
           coalesce(steps, 0.0) AS steps, coalesce(energy, 0.0) AS energy, coalesce(avg_resting_hr, 0.0) AS avg_resting_hr,
           coalesce(avg_hrv, 0.0) AS avg_hrv, sleep_hours IS NOT NULL AS has_sleep, steps IS NOT NULL AS has_activity,
           avg_resting_hr IS NOT NULL AS has_heart
    FROM nights FULL JOIN act_days USING (user_id, date) FULL JOIN hearts USING (user_id, date))
  SELECT user_id, date, has_sleep, has_activity, has_heart, {r(*SUMS)} FROM j""")(
    lambda t: D.join_summaries(NIGHTS(t), ACTS(t), HEARTS(t)))


def sensors(t):
    return {"sleep": NIGHTS(t).select(*K, "sleep_hours"), "activity": ACTS(t).select(*K, "steps"),
            "heart": HEARTS(t).select(*K, "max_hr")}


query("align_intersection", "J2", """
  SELECT user_id, date, round(sleep_hours, 6) AS sleep_sleep_hours, round(steps, 6) AS activity_steps,
         round(max_hr, 6) AS heart_max_hr
  FROM nights JOIN act_days USING (user_id, date) JOIN hearts USING (user_id, date)""")(
    lambda t: M.align_intersection(sensors(t), K))
query("align_union", "J3", """
  SELECT user_id, date, round(sleep_hours, 6) AS sleep_sleep_hours, round(steps, 6) AS activity_steps,
         round(max_hr, 6) AS heart_max_hr
  FROM nights FULL JOIN act_days USING (user_id, date) FULL JOIN hearts USING (user_id, date)""")(
    lambda t: M.align_union(sensors(t), K))
query("align_daily", "J4", """
  WITH a AS (
    SELECT user_id, start_ts::DATE AS date, avg(value) AS m, first(source_name ORDER BY start_ts, rec_id) AS s
    FROM activity GROUP BY ALL),
  h AS (SELECT user_id, ts::DATE AS date, avg(value) AS m FROM heart GROUP BY ALL),
  ac AS (
    SELECT user_id, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
    FROM (SELECT user_id, min(date) AS lo, max(date) AS hi FROM a GROUP BY user_id)),
  hc AS (
    SELECT user_id, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
    FROM (SELECT user_id, min(date) AS lo, max(date) AS hi FROM h GROUP BY user_id))
  SELECT user_id, date, round(a.m, 6) AS activity_value_mean, a.s AS activity_source_name, round(h.m, 6) AS heart_value_mean
  FROM ac JOIN hc USING (user_id, date) LEFT JOIN a USING (user_id, date) LEFT JOIN h USING (user_id, date)""")(
    lambda t: M.align_daily([M.to_daily(t.activity, "start_ts", "activity", ["value"], ["source_name"]),
                             M.to_daily(t.heart, "ts", "heart", ["value"])]))


def fill_sql(source: str, col: str, limit: int) -> str:
    """Filled value at row i from the nearest known positions, as scalar expressions."""
    return f"""CASE WHEN least(coalesce(i - pi_{col}, {limit + 1}), coalesce(ni_{col} - i, {limit + 1})) <= {limit} THEN
      CASE WHEN pi_{col} IS NULL THEN nv_{col} WHEN ni_{col} IS NULL THEN pv_{col} WHEN ni_{col} = pi_{col} THEN pv_{col}
           ELSE pv_{col} + (nv_{col} - pv_{col}) * (i - pi_{col}) / (ni_{col} - pi_{col}) END END"""


def near_sql(col: str) -> str:
    return f"""last_value(CASE WHEN {col} IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi_{col},
      last_value({col} IGNORE NULLS) OVER b AS pv_{col},
      first_value(CASE WHEN {col} IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni_{col},
      first_value({col} IGNORE NULLS) OVER f AS nv_{col}"""


FRAMES = """WINDOW b AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
query("align_interpolated", "J5 I2", f"""
  WITH u AS (SELECT user_id, date FROM nights UNION SELECT user_id, date FROM act_days UNION SELECT user_id, date FROM hearts),
  c AS (
    SELECT user_id, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
    FROM (SELECT user_id, min(date) AS lo, max(date) AS hi FROM u GROUP BY user_id)),
  g AS (
    SELECT user_id, date, sleep_hours AS s, steps AS a, max_hr AS h, row_number() OVER (PARTITION BY user_id ORDER BY date) AS i
    FROM c LEFT JOIN nights USING (user_id, date) LEFT JOIN act_days USING (user_id, date) LEFT JOIN hearts USING (user_id, date)),
  n AS (SELECT user_id, date, i, {near_sql('s')}, {near_sql('a')}, {near_sql('h')} FROM g {FRAMES})
  SELECT user_id, date, round({fill_sql('n', 's', 3)}, 6) AS sleep_sleep_hours,
         round({fill_sql('n', 'a', 3)}, 6) AS activity_steps, round({fill_sql('n', 'h', 3)}, 6) AS heart_max_hr FROM n""")(
    lambda t: M.align_interpolated(sensors(t)))
query("records_covering_date", "J8", """
  SELECT user_id, date, count(*) AS records, round(sum((epoch_us(end_ts) - epoch_us(start_ts)) / 3.6e9), 6) AS hours
  FROM (SELECT *, unnest(generate_series(start_ts::DATE::TIMESTAMP, end_ts::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
        FROM sleep) GROUP BY user_id, date""")(
    lambda t: I.records_covering(t.sleep).groupBy(*K).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.expr("(unix_micros(cast(end_ts as timestamp)) - unix_micros(cast(start_ts as timestamp))) / 3.6e9D"))
        .alias("hours")))
query("lookback_records", "J9", """
  WITH n AS (SELECT DISTINCT user_id, start_ts::DATE AS target_date FROM activity)
  SELECT a.user_id, rec_id, target_date, (target_date - start_ts::DATE)::INTEGER AS back FROM activity a JOIN n USING (user_id)
  WHERE target_date - start_ts::DATE BETWEEN 0 AND 6""")(
    lambda t: I.lookback(t.activity, t.activity.select(
        "user_id", F.to_date("start_ts").alias("target_date")).distinct(), 7).select("user_id", "rec_id", "target_date", "back"))

# ---- missing data -----------------------------------------------------------------
view("night_grid", """
  SELECT user_id, date, sleep_hours AS s, efficiency AS e, row_number() OVER (PARTITION BY user_id ORDER BY date) AS i
  FROM (SELECT user_id, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
        FROM (SELECT user_id, min(date) AS lo, max(date) AS hi FROM nights GROUP BY user_id))
  LEFT JOIN nights USING (user_id, date)""")
GRID = lambda t: M.complete_grid(NIGHTS(t).select(*K, "sleep_hours", "efficiency"))
query("complete_time_grid", "I1 I4", "SELECT user_id, date, round(s, 6) AS sleep_hours, round(e, 6) AS efficiency FROM night_grid")(
    lambda t: M.no_fill(GRID(t)))
query("complete_hourly_grid", "I1", """
  SELECT user_id, unnest(generate_series(date_trunc('hour', lo), hi, INTERVAL 1 HOUR)) AS hour_ts
  FROM (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM heart GROUP BY user_id)""")(
    lambda t: M.hourly_grid(t.heart, "ts"))
query("interpolate_linear", "I2", f"""
  WITH n AS (SELECT user_id, date, i, {near_sql('s')}, {near_sql('e')} FROM night_grid {FRAMES})
  SELECT user_id, date, round({fill_sql('n', 's', 1)}, 6) AS sleep_hours, round({fill_sql('n', 'e', 1)}, 6) AS efficiency FROM n""")(
    lambda t: M.fill_linear(GRID(t), ["sleep_hours", "efficiency"], 1))
query("forward_fill", "I3", """
  SELECT user_id, date, round(last_value(s IGNORE NULLS) OVER w, 6) AS sleep_hours,
         round(last_value(e IGNORE NULLS) OVER w, 6) AS efficiency FROM night_grid
  WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""")(
    lambda t: M.fill_forward(GRID(t), ["sleep_hours", "efficiency"], 1))
view("dens", """
  WITH d AS (SELECT DISTINCT user_id, start_ts::DATE AS date FROM activity WHERE activity_type = 'STEP_COUNT'),
  l AS (
    SELECT *, (date - lag(date) OVER (PARTITION BY user_id ORDER BY date) - 1)::INTEGER AS gap,
           date - row_number() OVER (PARTITION BY user_id ORDER BY date)::INTEGER AS g FROM d),
  q AS (SELECT user_id, g, count(*) AS len FROM l GROUP BY user_id, g),
  a AS (
    SELECT user_id, count(*) AS days, (max(date) - min(date) + 1)::INTEGER AS total_days,
           coalesce(max(gap), 0) AS max_gap_days FROM l GROUP BY user_id)
  SELECT a.*, m.consecutive_days, days / total_days AS coverage,
         CASE WHEN days / total_days > 0.8 AND max_gap_days < 3 THEN 'dense'
              WHEN days / total_days > 0.5 AND max_gap_days < 7 THEN 'moderate'
              WHEN days / total_days > 0.1 AND max_gap_days < 14 THEN 'sparse' ELSE 'very_sparse' END AS density_class
  FROM a JOIN (SELECT user_id, max(len) AS consecutive_days FROM q GROUP BY user_id) m USING (user_id)""")
STEPDAYS = lambda t: t.activity.filter(F.col("activity_type") == "STEP_COUNT").select(
    "user_id", F.to_date("start_ts").alias("date"))
query("density_metrics", "I5", """
  SELECT user_id, days, total_days, max_gap_days, consecutive_days, round(coverage, 6) AS coverage, density_class FROM dens""")(
    lambda t: M.density(STEPDAYS(t)))
query("missing_patterns", "I6 U3", """
  WITH d AS (SELECT DISTINCT user_id, start_ts::DATE AS date FROM activity WHERE activity_type = 'STEP_COUNT'),
  c AS (
    SELECT user_id, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
    FROM (SELECT user_id, min(date) AS lo, max(date) AS hi FROM d GROUP BY user_id)),
  m AS (
    SELECT user_id, date, isodow(date) AS wd, date - lag(date) OVER (PARTITION BY user_id ORDER BY date) AS gap
    FROM (SELECT * FROM c EXCEPT SELECT * FROM d)),
  g AS (
    SELECT user_id, count(*) AS n, count(*) FILTER (wd >= 6) / count(*) AS we, count(DISTINCT gap) AS gaps,
           count(DISTINCT wd) AS wds FROM m GROUP BY user_id)
  SELECT u.user_id, coalesce(n, 0) AS missing, round(coalesce(we, 0.0), 6) AS weekend_bias,
         round(coalesce(1 - we, 0.0), 6) AS weekday_bias, coalesce(n >= 3 AND (gaps = 1 OR wds <= 2), FALSE) AS is_periodic
  FROM (SELECT DISTINCT user_id FROM d) u LEFT JOIN g USING (user_id)""")(lambda t: M.missing_pattern(STEPDAYS(t)))
query("missingness_features", "I7 G12", """
  WITH g AS (
    SELECT user_id, date, i, s, steps AS a, isodow(date) >= 6 AS we FROM night_grid LEFT JOIN steps_day USING (user_id, date)),
  f AS (
    SELECT *, i - coalesce(max(CASE WHEN s IS NOT NULL THEN i END) OVER w, 0) AS rs,
           i - coalesce(max(CASE WHEN a IS NOT NULL THEN i END) OVER w, 0) AS ra,
           (s IS NULL)::INTEGER + (a IS NULL)::INTEGER AS k FROM g
    WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING))
  SELECT user_id, round(sum(k) / (count(*) * 2), 6) AS missing_ratio, round(avg((s IS NULL)::INTEGER), 6) AS sleep_hours_missing_ratio,
         round(avg((a IS NULL)::INTEGER), 6) AS steps_missing_ratio, max(rs)::INTEGER AS sleep_hours_longest_missing,
         max(ra)::INTEGER AS steps_longest_missing, greatest(max(rs), max(ra))::INTEGER AS longest_missing,
         round(sum(k) FILTER (NOT we) / (count(*) FILTER (NOT we) * 2), 6) AS weekday_ratio,
         round(sum(k) FILTER (we) / (count(*) FILTER (we) * 2), 6) AS weekend_ratio FROM f GROUP BY user_id""")(
    lambda t: M.missingness(M.complete_grid(NIGHTS(t).select(*K, "sleep_hours")).join(
        D.deduped_steps(t.activity), K, "left"), ["sleep_hours", "steps"]))
query("density_confidence", "I8", """
  SELECT user_id, round(least(1.0, greatest(0.0, coverage * 0.5 + (1 - least(max_gap_days / 7.0, 1.0)) * 0.3
         + least(consecutive_days / 7.0, 1.0) * 0.2)), 6)::DOUBLE AS confidence FROM dens""")(
    lambda t: M.density_confidence(M.density(STEPDAYS(t))).select("user_id", "confidence"))
query("processing_strategy", "I9", """
  SELECT user_id, density_class, CASE density_class WHEN 'dense' THEN 'full_circadian_analysis'
         WHEN 'sparse' THEN 'interpolation_with_uncertainty' ELSE 'minimal_analysis' END AS algorithm,
         CASE density_class WHEN 'dense' THEN '' WHEN 'sparse' THEN 'Sparse data - confidence intervals widened'
         ELSE 'Very sparse data - results may be unreliable' END AS warning FROM dens""")(
    lambda t: M.processing_strategy(M.density(STEPDAYS(t))))
query("available_features", "I9", """
  SELECT user_id, consecutive_days >= 1 AS daily_summary, consecutive_days >= 7 AS weekly_patterns,
         consecutive_days >= 7 AND coverage > 0.7 AS circadian_phase, consecutive_days >= 7 AND coverage > 0.7 AS circadian_amplitude,
         total_days >= 28 AS monthly_trends, total_days >= 90 AS seasonal_patterns FROM dens""")(
    lambda t: M.available_features(M.density(STEPDAYS(t))))

# ---- coverage reports -------------------------------------------------------------
PROFILE = """
  SELECT kind, count(*) AS records, min(ts) AS first_ts, max(ts) AS last_ts FROM (
    SELECT state AS kind, start_ts AS ts FROM sleep UNION ALL SELECT activity_type, start_ts FROM activity
    UNION ALL SELECT metric_type, ts FROM heart) GROUP BY kind"""


def profile(t):
    return (
        t.sleep.select(F.col("state").alias("kind"), F.col("start_ts").alias("ts"))
        .unionByName(t.activity.select(F.col("activity_type").alias("kind"), F.col("start_ts").alias("ts")))
        .unionByName(t.heart.select(F.col("metric_type").alias("kind"), "ts"))
        .groupBy("kind").agg(F.count(F.lit(1)).alias("records"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


query("record_type_profile", "A22", PROFILE)(profile)
query("top_record_types", "L2", PROFILE + " ORDER BY records DESC, kind LIMIT 20")(
    lambda t: profile(t).orderBy(F.desc("records"), "kind").limit(20))
query("monthly_coverage", "A23", """
  WITH j AS (
    SELECT user_id, date, n.sleep_hours IS NOT NULL AS s, a.steps IS NOT NULL AS a
    FROM nights n FULL JOIN act_days a USING (user_id, date)),
  m AS (
    SELECT user_id, date_trunc('month', date)::DATE AS month, count(*) FILTER (s) AS sleep_days,
           count(*) FILTER (a) AS activity_days, count(*) FILTER (s AND a) AS both_days FROM j GROUP BY ALL)
  SELECT *, round(sleep_days / day(last_day(month)) * 100, 6) AS sleep_pct,
         round(activity_days / day(last_day(month)) * 100, 6) AS activity_pct,
         round(both_days / day(last_day(month)) * 100, 6) AS both_pct FROM m""")(
    lambda t: M.monthly_coverage(NIGHTS(t), ACTS(t)))
query("data_summary", "A24 A28", """
  WITH u AS (
    SELECT user_id, start_ts::DATE AS date, 's' AS k FROM sleep UNION ALL SELECT user_id, start_ts::DATE, 'a' FROM activity
    UNION ALL SELECT user_id, ts::DATE, 'h' FROM heart),
  g AS (
    SELECT user_id, count(*) FILTER (k = 's') AS sleep_records, count(*) FILTER (k = 'a') AS activity_records,
           count(*) FILTER (k = 'h') AS heart_records, count(DISTINCT date) FILTER (k = 's') AS sleep_days,
           count(DISTINCT date) FILTER (k = 'a') AS activity_days, count(DISTINCT date) FILTER (k = 'h') AS heart_days,
           count(DISTINCT date) AS days, min(date) AS first_day, max(date) AS last_day FROM u GROUP BY user_id)
  SELECT *, round(days / (last_day - first_day + 1), 6) AS density,
         concat_ws('; ', CASE WHEN sleep_records = 0 THEN 'no sleep data' END,
           CASE WHEN activity_records = 0 THEN 'no activity data' END,
           CASE WHEN days / (last_day - first_day + 1) < 0.5 THEN 'sparse data' END) AS warnings FROM g""")(
    lambda t: M.data_summary(t.sleep, t.activity, t.heart))
query("data_validation", "A24", """
  WITH u AS (
    SELECT user_id, start_ts::DATE AS date, 's' AS k FROM sleep UNION ALL SELECT user_id, start_ts::DATE, 'a' FROM activity
    UNION ALL SELECT user_id, ts::DATE, 'h' FROM heart),
  g AS (
    SELECT user_id, count(*) FILTER (k = 's') AS sleep_records, count(*) FILTER (k = 'a') AS activity_records,
           count(*) FILTER (k = 'h') AS heart_records, min(date) AS first_day, max(date) AS last_day,
           count(DISTINCT date) FILTER (k = 's') / (max(date) - min(date) + 1) AS share FROM u GROUP BY user_id)
  SELECT user_id, sleep_records, activity_records, heart_records, first_day, last_day,
         round(CASE WHEN sleep_records > 0 THEN share END, 6) AS sleep_density, sleep_records > 0 OR activity_records > 0 AS is_valid,
         concat_ws('; ', CASE WHEN sleep_records = 0 THEN 'No sleep records found' END,
           CASE WHEN activity_records = 0 THEN 'No activity records found' END,
           CASE WHEN sleep_records > 0 AND share < 0.5 THEN 'Sparse sleep data: ' || printf('%.1f', share * 100) || '% coverage' END) AS warnings FROM g""")(
    lambda t: M.validation(M.data_summary(t.sleep, t.activity, t.heart)))
COMPLETE = """
  SELECT user_id, date, n.sleep_hours IS NOT NULL AS sleep, a.steps IS NOT NULL AS activity, h.max_hr IS NOT NULL AS heart
  FROM nights n FULL JOIN act_days a USING (user_id, date) FULL JOIN hearts h USING (user_id, date)"""
query("completeness_by_day", "A25", f"""
  SELECT *, concat_ws(',', CASE WHEN NOT sleep THEN 'sleep' END, CASE WHEN NOT activity THEN 'activity' END,
         CASE WHEN NOT heart THEN 'heart' END) AS missing FROM ({COMPLETE})""")(
    lambda t: M.completeness(NIGHTS(t), ACTS(t), HEARTS(t)))
query("completeness_report", "A25", f"""
  SELECT user_id, count(*) AS days, round(count(*) FILTER (sleep) / count(*), 6) AS sleep_coverage,
         round(count(*) FILTER (activity) / count(*), 6) AS activity_coverage,
         round(count(*) FILTER (heart) / count(*), 6) AS heart_coverage,
         count(*) FILTER (sleep AND activity AND heart) AS full_days FROM ({COMPLETE}) GROUP BY user_id""")(
    lambda t: M.completeness_report(M.completeness(NIGHTS(t), ACTS(t), HEARTS(t))))
query("distinct_sources", "A28", """
  SELECT count(DISTINCT source_name) AS sources, count(DISTINCT start_ts::DATE) AS days, count(DISTINCT user_id) AS users
  FROM sleep""")(
    lambda t: t.sleep.agg(F.countDistinct("source_name").alias("sources"),
                          F.countDistinct(F.to_date("start_ts")).alias("days"), F.countDistinct("user_id").alias("users")))
query("missing_dates", "U3", """
  WITH c AS (
    SELECT user_id, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
    FROM (SELECT user_id, min(date) AS lo, max(date) AS hi FROM nights GROUP BY user_id))
  SELECT user_id, date FROM c EXCEPT SELECT user_id, date FROM nights""")(
    lambda t: KEYS(M.complete_grid(KEYS(NIGHTS(t)))).join(KEYS(NIGHTS(t)), K, "left_anti"))
query("date_union", "U1", "SELECT user_id, date FROM nights UNION SELECT user_id, date FROM act_days")(
    lambda t: KEYS(NIGHTS(t)).unionByName(KEYS(ACTS(t))).distinct())
query("date_intersection", "U2", "SELECT user_id, date FROM nights INTERSECT SELECT user_id, date FROM act_days")(
    lambda t: KEYS(NIGHTS(t)).intersect(KEYS(ACTS(t))))
