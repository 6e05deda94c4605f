"""Rolling-window queries over the daily tables."""

from pyspark.sql import functions as F

from diurna.operators import daily as D
from diurna.operators import intervals as I
from diurna.operators import rolling as R
from diurna.plans.nights import r
from diurna.plans.registry import query, view

STEPS, SLEPT = "steps", "sleep_hours"
ACTS = lambda t: D.daily_activity(t.activity)
SLEEP_METRICS = ["sleep_percentage", "sleep_amplitude", "long_num", "long_len", "long_st", "long_wt",
                 "short_num", "short_len", "short_st", "short_wt"]


def zs(*metrics: str, frame: str = "w") -> str:
    return ", ".join(
        f"""round(avg({m}) OVER {frame}, 6) AS {m}_mean, round(stddev_pop({m}) OVER {frame}, 6) AS {m}_std,
        round(CASE WHEN stddev_pop({m}) OVER {frame} > 1e-12
              THEN ({m} - avg({m}) OVER {frame}) / stddev_pop({m}) OVER {frame} ELSE 0.0 END, 6) AS {m}_zscore"""
        for m in metrics)


query("nightly_sleep_rarity", "G1 G3 G6 W1", f"""
  WITH d AS (
    SELECT user_id, date, sum(hours) AS hours, count(*) AS windows FROM day_wins GROUP BY ALL)
  SELECT user_id, date, round(hours, 6) AS hours, windows, {zs('hours')} FROM d
  WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
  QUALIFY count(*) OVER w >= 3""")(
    lambda t: R.mean_std_z(
        I.daily_windows(t.sleep).groupBy("user_id", "date")
        .agg(F.sum("hours").alias("hours"), F.count(F.lit(1)).alias("windows")), ["hours"]))

query("rolling_mean_std_z", "W1", f"""
  SELECT user_id, date, {zs(*SLEEP_METRICS)} FROM win_metrics
  WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
  QUALIFY count(*) OVER w >= 3""")(
    lambda t: R.mean_std_z(I.daily_window_metrics(t.sleep), SLEEP_METRICS).drop(*SLEEP_METRICS))

query("recent_days_lookback", "W3", """
  SELECT user_id, date, count(*) OVER w AS days_30, round(avg(sleep_hours) OVER w, 6) AS mean_30 FROM nights
  WINDOW w AS (PARTITION BY user_id ORDER BY date RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)""")(
    lambda t: D.daily_sleep(t.sleep).select(
        "user_id", "date", F.count(F.lit(1)).over(R.days(-30)).alias("days_30"),
        F.avg("sleep_hours").over(R.days(-30)).alias("mean_30")))

view("step_series", """
  SELECT user_id, date, steps AS y, row_number() OVER (PARTITION BY user_id ORDER BY date) AS pos,
         steps - lag(steps) OVER (PARTITION BY user_id ORDER BY date) AS step,
         count(*) OVER (PARTITION BY user_id) AS total FROM act_days""")
W7 = "WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
query("rolling_statistics", "W4", f"""
  SELECT user_id, date, round(avg(y) OVER w, 6) AS mean, round(stddev_pop(y) OVER w, 6) AS std,
         round(min(y) OVER w, 6) AS min, round(max(y) OVER w, 6) AS max,
         round(CASE WHEN pos = 1 THEN 0.0 ELSE regr_slope(y, pos) OVER w END, 6) AS trend FROM step_series {W7}""")(
    lambda t: R.statistics(ACTS(t), STEPS, 7))
query("trend_features", "W5", f"""
  SELECT user_id, date, round(CASE WHEN pos = 1 THEN 0.0 ELSE regr_slope(y, pos) OVER w END, 6) AS slope,
         round(CASE WHEN pos = 1 OR stddev_pop(y) OVER w < 1e-12 THEN 0.0 ELSE corr(y, pos) OVER w
               * corr(y, pos) OVER w END, 6) AS r_squared,
         round(CASE WHEN pos <= 2 THEN 0.0 ELSE avg(bend) OVER x END, 6) AS acceleration,
         pos > 1 AND round(regr_slope(y, pos) OVER w, 9) > 0 AS is_increasing,
         pos = 1 OR CASE WHEN avg(y) OVER w = 0 THEN 0.0 ELSE stddev_pop(y) OVER w / avg(y) OVER w END < 0.1
         AS is_stable
  FROM (SELECT *, step - lag(step) OVER (PARTITION BY user_id ORDER BY date) AS bend FROM step_series)
  WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         x AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")(
    lambda t: R.trend(ACTS(t), STEPS, 7))
query("variability_features", "W6", f"""
  SELECT user_id, date, round(CASE WHEN avg(y) OVER w = 0 THEN 0.0 ELSE stddev_pop(y) OVER w / avg(y) OVER w END, 6)
         AS cv, round(max(y) OVER w - min(y) OVER w, 6) AS value_range,
         round(quantile_cont(y, 0.75) OVER w - quantile_cont(y, 0.25) OVER w, 6) AS iqr,
         round(mad(y) OVER w, 6) AS mad FROM step_series {W7}""")(
    lambda t: R.variability(ACTS(t), STEPS, 7))
query("anomaly_scores", "W7", """
  SELECT user_id, date, round(CASE WHEN count(*) OVER w < 2 OR stddev_pop(y) OVER w <= 1e-12 THEN 0.0
         ELSE abs(y - avg(y) OVER w) / stddev_pop(y) OVER w END, 6) AS score FROM step_series
  WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")(
    lambda t: R.anomaly_scores(ACTS(t), STEPS, 7))
query("change_points", "W8", """
  WITH c AS (
    SELECT user_id, date, (pos - 1)::INTEGER AS position, total, avg(y) OVER a - avg(y) OVER b AS m,
           sqrt((var_pop(y) OVER a + var_pop(y) OVER b) / 2) AS sd FROM step_series
    WINDOW b AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
           a AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
  SELECT user_id, date, position, round(m, 6) AS magnitude,
         CASE WHEN m > 0 THEN 'increase' ELSE 'decrease' END AS direction
  FROM c WHERE position >= 5 AND position < total - 5 AND sd > 0 AND abs(m) / sd > 0.8""")(
    lambda t: R.change_points(ACTS(t), STEPS))
query("momentum_features", "W9", """
  WITH m AS (
    SELECT user_id, date, CASE WHEN pos >= 3 THEN regr_slope(y, pos) OVER s ELSE 0.0 END AS a,
           CASE WHEN pos >= 7 THEN regr_slope(y, pos) OVER l WHEN pos >= 3 THEN regr_slope(y, pos) OVER s
                ELSE 0.0 END AS b FROM step_series
    WINDOW s AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
           l AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
  SELECT user_id, date, round(a, 6) AS short_term, round(b, 6) AS long_term, round(a - b, 6) AS divergence,
         round(a - b, 9) > 0 AND round(a, 9) > 0 AS is_accelerating FROM m""")(
    lambda t: R.momentum(ACTS(t), STEPS))
query("step_acceleration", "W10", """
  SELECT user_id, round(CASE WHEN count(*) < 3 THEN 0.0 ELSE regr_slope(y, pos) END, 6) AS slope
  FROM step_series GROUP BY user_id""")(lambda t: R.overall_slope(ACTS(t), STEPS))
query("periodicity", "W11", """
  WITH z AS (
    SELECT *, (y - avg(y) OVER (PARTITION BY user_id)) / (stddev_pop(y) OVER (PARTITION BY user_id) + 1e-10) AS z
    FROM step_series),
  c AS (
    SELECT a.user_id, p, round(sum(a.z * b.z) / (any_value(a.total) - p), 9) AS r
    FROM z a, z b, generate_series(2, 7) g(p)
    WHERE b.user_id = a.user_id AND b.pos = a.pos + p AND p < a.total // 2 AND a.total >= 14 GROUP BY a.user_id, p),
  best AS (SELECT * FROM c WHERE abs(r) > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(r) DESC, p) = 1),
  cls AS (
    SELECT user_id, (pos - 1) % p AS k, round(avg(y), 9) AS m FROM best JOIN step_series USING (user_id) GROUP BY ALL),
  ph AS (SELECT * FROM cls QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY m DESC, k) = 1)
  SELECT u.user_id, coalesce(p, 0)::INTEGER AS dominant_period_days, round(coalesce(abs(r), 0.0), 6) AS period_strength,
         coalesce(k, 0)::DOUBLE AS phase_shift
  FROM (SELECT DISTINCT user_id FROM step_series) u LEFT JOIN best USING (user_id) LEFT JOIN ph USING (user_id)""")(
    lambda t: R.periodicity(ACTS(t), STEPS))


def corr_sql(lag: int) -> str:
    return f"""
  WITH j AS (
    SELECT user_id, date, round(steps, 9) AS x, round(sleep_hours, 9) AS y0, count(*) OVER (PARTITION BY user_id) AS total
    FROM act_days JOIN nights USING (user_id, date)),
  l AS (
    SELECT user_id, x, CASE WHEN total > {lag} THEN lead(y0, {lag}) OVER (PARTITION BY user_id ORDER BY date)
           ELSE y0 END AS y FROM j),
  k AS (
    SELECT *, rank() OVER (PARTITION BY user_id ORDER BY x) + (count(*) OVER (PARTITION BY user_id, x) - 1) / 2 AS rx,
           rank() OVER (PARTITION BY user_id ORDER BY y) + (count(*) OVER (PARTITION BY user_id, y) - 1) / 2 AS ry
    FROM l WHERE y IS NOT NULL),
  g AS (SELECT user_id, count(*)::INTEGER AS n, corr(x, y) AS r, corr(rx, ry) AS rho FROM k GROUP BY user_id),
  v AS (
    SELECT *, n - 2 AS df, CASE WHEN n >= 3 THEN least(abs(r), abs(rho)) END AS m FROM g),
  h AS (SELECT *, atan(m / sqrt(1 - m * m)) AS th FROM v),
  p AS (
    SELECT *, CASE WHEN m IS NULL OR isnan(m) THEN 1.0 WHEN m >= 1 - 1e-12 THEN 0.0 WHEN df % 2 = 0 THEN
        1 - sin(th) * list_sum([cos(th) ** (2 * k) * coalesce(list_product(
            [(2 * j - 1) / (2.0 * j) for j in range(1, k + 1)]), 1.0) for k in range(0, df // 2)])
      WHEN df = 1 THEN 1 - 2 * th / pi() ELSE
        1 - 2 / pi() * (th + sin(th) * list_sum([cos(th) ** (2 * k + 1) * coalesce(list_product(
            [(2.0 * j) / (2 * j + 1) for j in range(1, k + 1)]), 1.0) for k in range(0, (df - 1) // 2)])) END AS pv FROM h)
  SELECT user_id, n, round(CASE WHEN n < 3 OR isnan(r) THEN 0.0 ELSE coalesce(r, 0.0) END, 6) AS pearson_r,
         round(CASE WHEN n < 3 OR isnan(rho) THEN 0.0 ELSE coalesce(rho, 0.0) END, 6) AS spearman_rho,
         round(greatest(pv, 0.0), 6) AS p_value, pv < 0.05 AS is_significant FROM p"""


query("steps_sleep_correlation", "W12 J12", corr_sql(0))(
    lambda t: R.correlation(ACTS(t), D.daily_sleep(t.sleep), STEPS, SLEPT))
query("steps_sleep_lagged_correlation", "W12 J12", corr_sql(1))(
    lambda t: R.correlation(ACTS(t), D.daily_sleep(t.sleep), STEPS, SLEPT, lag=1))
query("day_over_day_change", "W15", """
  SELECT user_id, round(coalesce(avg(abs(step) / (y - step)) FILTER (y - step > 0), 0.0), 6) AS mean_change
  FROM step_series GROUP BY user_id""")(lambda t: R.day_over_day(ACTS(t), STEPS))
query("latest_records", "W16 L2", """
  SELECT user_id, rec_id, start_ts, nth::INTEGER AS nth FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ts DESC, rec_id DESC) AS nth FROM sleep)
  WHERE nth <= 5""")(
    lambda t: R.latest_per_user(t.sleep, [F.desc("start_ts"), F.desc("rec_id")], 5)
    .select("user_id", "rec_id", "start_ts", "nth"))
query("latest_records_overall", "W16 L2", """
  SELECT user_id, rec_id, start_ts FROM activity ORDER BY start_ts DESC, rec_id DESC LIMIT 10""")(
    lambda t: t.activity.select("user_id", "rec_id", "start_ts")
    .orderBy(F.desc("start_ts"), F.desc("rec_id")).limit(10))

view("sleep_state", """
  SELECT user_id, date, sleep_hours AS y, count(*) OVER w AS n, avg(sleep_hours) OVER w AS mean,
         sqrt(round(CASE WHEN count(*) OVER w > 1 THEN greatest(avg(sleep_hours * sleep_hours) OVER w
              - (avg(sleep_hours) OVER w) ** 2, 0.0) ELSE 0.0 END, 9)) AS std FROM nights
  WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING)""")
query("incremental_baseline", "W18 M12", f"SELECT user_id, date, n, {r('y', 'mean', 'std')} FROM sleep_state")(
    lambda t: R.incremental_baseline(D.daily_sleep(t.sleep), SLEPT))
query("seeded_baseline", "W18", """
  SELECT user_id, date, n + 12 AS n, round(y, 6) AS y, round((n * mean + 7.0 * 12) / (n + 12), 6) AS mean,
         round(sqrt(round(greatest((s + (1.0 + 49.0) * 12) / (n + 12) - ((n * mean + 7.0 * 12) / (n + 12)) ** 2, 0.0), 9)), 6)
         AS std
  FROM (SELECT *, sum(y * y) OVER (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS s FROM sleep_state)""")(
    lambda t: R.incremental_baseline(D.daily_sleep(t.sleep), SLEPT, seed=(7.0, 1.0, 12)))
query("individual_zscore", "W19", """
  SELECT user_id, date, round(CASE WHEN std > 0 THEN (y - mean) / std ELSE 0.0 END, 6) AS zscore FROM sleep_state""")(
    lambda t: R.individual_z(D.daily_sleep(t.sleep), SLEPT))
query("individual_heart_zscore", "W19", """
  WITH s AS (
    SELECT user_id, date, avg_resting_hr AS v, CASE WHEN avg_resting_hr <> 70.0 THEN avg_resting_hr END AS y FROM hearts),
  st AS (
    SELECT *, count(y) OVER w AS n, avg(y) OVER w AS m, avg(y * y) OVER w AS q FROM s
    WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING)),
  d AS (SELECT *, CASE WHEN n > 1 THEN sqrt(round(greatest(q - m * m, 0.0), 9)) ELSE 0.0 END AS sd FROM st)
  SELECT user_id, date, round(CASE WHEN sd > 0 THEN (v - m) / sd ELSE 0.0 END, 6) AS zscore FROM d""")(
    lambda t: R.individual_z(D.daily_heart(t.heart), "avg_resting_hr", ignored=70.0))

SEVERITY = lambda t: t.episodes.groupBy("user_id", F.col("start_date").alias("date")).agg(
    F.sum("severity").alias("score"))
view("severity_days", """
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) AS pos FROM (
    SELECT user_id, start_date AS date, sum(severity)::DOUBLE AS y FROM episodes GROUP BY ALL)""")
query("risk_trajectory", "W20", """
  WITH v AS (
    SELECT user_id, date, pos, CASE WHEN pos >= 3 THEN round(regr_slope(y, pos) OVER
           (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING), 9) ELSE 0.0 END AS velocity FROM severity_days)
  SELECT user_id, date, round(velocity, 6) AS velocity,
         CASE WHEN velocity > 0.1 THEN 'worsening' WHEN velocity < -0.1 THEN 'improving' ELSE 'stable' END AS trend,
         CASE WHEN pos < 3 THEN 'unknown' WHEN velocity > 0.1 THEN 'continued_worsening'
              WHEN velocity < -0.1 THEN 'continued_improvement' ELSE 'stable' END AS predicted FROM v""")(
    lambda t: R.risk_trajectory(SEVERITY(t), "score"))
query("longitudinal_pattern", "W21", """
  WITH d AS (SELECT *, y - lag(y) OVER (PARTITION BY user_id ORDER BY date) AS step FROM severity_days),
  e AS (
    SELECT *, min(step) OVER w AS lo, max(step) OVER w AS hi FROM d
    WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING)),
  f AS (
    SELECT user_id, date, pos, CASE WHEN pos = 1 THEN 'unknown' WHEN step > 3 THEN 'worsening'
           WHEN step < -3 THEN 'improving' ELSE 'stable' END AS trajectory,
           CASE WHEN pos = 1 THEN 'insufficient_data' WHEN lo >= 0 THEN 'escalating_depression'
                WHEN hi <= 0 THEN 'improving_depression' ELSE 'fluctuating' END AS pattern FROM e)
  SELECT user_id, date, trajectory, pattern, round(least(0.5 + (pos - 1) * 0.1, 0.9), 6)::DOUBLE AS confidence,
         CASE WHEN trajectory = 'worsening' AND pattern = 'escalating_depression' THEN 'high_risk_for_episode'
              WHEN trajectory = 'improving' THEN 'decreasing_risk' ELSE 'stable_risk' END AS projection FROM f""")(
    lambda t: R.longitudinal_pattern(SEVERITY(t), "score"))
