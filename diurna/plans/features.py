"""Lookback and composite feature queries."""

from pyspark.sql import functions as F

from diurna.operators import circadian as C
from diurna.operators import daily as D
from diurna.operators import features as X
from diurna.operators import intervals as I
from diurna.operators import rolling as R
from diurna.plans.nights import r
from diurna.plans.registry import query, view
from diurna.plans.rolling import SLEEP_METRICS, zs
from diurna.session import scratch

K = ["user_id", "date"]


def daily(t):
    return D.daily_sleep(t.sleep), D.daily_activity(t.activity), D.daily_heart(t.heart)


def look(t, *groups):
    return X.lookback_features(X.daily_join(*daily(t)), *groups)


def text(df, *arrays):
    return df.withColumns({a: F.concat_ws("; ", a) for a in arrays})


view("day_rows", """
  WITH n AS (
    SELECT user_id, date, sleep_hours, efficiency, fragmentation, floor(bedtime_minute + 1e-9) / 60 AS bed_hour,
           floor(wake_minute + 1e-9) / 60 AS wake_hour, floor(mid_sleep_minute % 1440 + 1e-9) / 60 AS mid_hour,
           mid_sleep_minute - longest_hours * 30 AS ms, bedtime_minute, longest_hours FROM nights)
  SELECT user_id, date, sleep_hours, efficiency, fragmentation, bed_hour, wake_hour, mid_hour,
         CASE WHEN floor(bedtime_minute / 60) BETWEEN 8 AND 18 AND longest_hours > 0 AND abs(bedtime_minute - ms) > 240
              THEN floor((ms % 1440 + 1440) % 1440 + 1e-9) / 60 ELSE bed_hour END AS main_bed_hour,
         steps, energy, variance, sedentary_hours, active_hours, peak_hour, floor(first_minute + 1e-9) / 60 AS first_hour,
         floor(last_minute + 1e-9) / 60 AS last_hour, avg_resting_hr, avg_hrv, hr_range,
         (SELECT CASE WHEN steps - step > 0 THEN abs(step) / (steps - step) END FROM step_series z
          WHERE z.user_id = a.user_id AND z.date = a.date) AS change
  FROM n FULL JOIN act_days a USING (user_id, date) FULL JOIN hearts USING (user_id, date)""")
# every target date with the rows of its last 31 calendar days
view("lk", """
  SELECT t.user_id, t.date, s.* EXCLUDE (user_id, date), s.date AS d,
         CASE WHEN s.bed_hour < 12 THEN s.bed_hour + 24 ELSE s.bed_hour END AS bed_n,
         CASE WHEN s.main_bed_hour < 12 THEN s.main_bed_hour + 24 ELSE s.main_bed_hour END AS main_n
  FROM day_rows t JOIN day_rows s ON s.user_id = t.user_id AND s.date BETWEEN t.date - 30 AND t.date""")
view("f_sleep", """
  WITH m AS (
    SELECT user_id, date, h, avg(CASE WHEN floor(bed_hour) > floor(wake_hour) THEN (h >= floor(bed_hour) OR h < floor(wake_hour))::INTEGER
           ELSE (h >= floor(bed_hour) AND h < floor(wake_hour))::INTEGER END) AS m
    FROM lk, range(24) g(h) WHERE bed_hour IS NOT NULL GROUP BY ALL),
  i AS (SELECT user_id, date, avg(m) AS g, var_pop(m) AS v FROM m GROUP BY ALL)
  SELECT user_id, date, count(sleep_hours) AS nn,
         CASE count(sleep_hours) WHEN 0 THEN 0.0 WHEN 1 THEN 100.0
           ELSE round(least(100.0, greatest(0.0, 100 - (stddev_pop(main_n) + stddev_pop(wake_hour)) * 10)), 9) END AS sleep_regularity,
         CASE WHEN count(sleep_hours) < 3 THEN 0.0 WHEN any_value(g) * (1 - any_value(g)) < 1e-13 THEN 1.0
           ELSE least(1.0, any_value(v) / (any_value(g) * (1 - any_value(g)))) END AS interdaily_stability,
         coalesce(avg(fragmentation + 1 - efficiency), 0.0) AS intradaily_variability,
         coalesce(least(1.0, greatest(0.0, (1 - stddev_pop(sleep_hours) / (avg(sleep_hours) + 1e-6) + avg(efficiency)) / 2)), 0.0) AS relative_amplitude,
         coalesce(avg((sleep_hours < 6)::INTEGER) * 100, 0.0) AS short_sleep_pct, coalesce(avg((sleep_hours > 10)::INTEGER) * 100, 0.0) AS long_sleep_pct,
         CASE WHEN count(sleep_hours) >= 2 THEN var_pop(bed_n) ELSE 0.0 END AS onset_variance,
         CASE WHEN count(sleep_hours) >= 2 THEN var_pop(wake_hour) ELSE 0.0 END AS wake_variance
  FROM lk LEFT JOIN i USING (user_id, date) GROUP BY user_id, date""")
view("f_clock", """
  WITH a AS (
    SELECT user_id, date, count(sleep_hours) AS nn, count(steps) AS na, count(peak_hour) AS np,
           coalesce(avg((24 - sedentary_hours) * 10), 0.0) AS l5, coalesce(avg(active_hours * 60 + energy / 5), 0.0) AS m10,
           round((avg(bed_n) - 23 + avg(wake_hour) - 7) / 2, 9) AS sh, avg(bed_n) AS ab, avg(wake_hour) AS aw,
           avg(efficiency) AS ef, avg(peak_hour) - avg(mid_hour) AS po FROM lk GROUP BY user_id, date),
  o AS (SELECT *, ((po % 24) + 24) % 24 - 9 AS off FROM a)
  SELECT user_id, date, l5 AS l5_value, m10 AS m10_value, 2 AS l5_onset, 10 AS m10_onset,
         CASE WHEN sh < -2 THEN -sh ELSE 0.0 END AS phase_advance, CASE WHEN sh > 2 THEN sh ELSE 0.0 END AS phase_delay,
         CASE WHEN nn = 0 THEN 'unknown' WHEN sh > 2 THEN 'delayed' WHEN sh < -2 THEN 'advanced' ELSE 'normal' END AS phase_type,
         (round(ab - 2, 6) + 24) % 24 AS melatonin_onset, (round(aw - 2, 6) + 24) % 24 AS temperature_nadir,
         CASE WHEN nn = 0 OR na = 0 THEN 0.0 ELSE least(1.0, greatest(0.0,
           (CASE WHEN m10 > 0 THEN 1 - l5 / m10 ELSE 0.0 END + ef) / 2)) END AS circadian_amplitude,
         CASE WHEN nn = 0 OR na = 0 OR np = 0 THEN 0.0 WHEN off > 12 THEN off - 24 WHEN off < -12 THEN off + 24 ELSE off END AS phase_angle
  FROM o""")
view("f_act", """
  WITH f AS (SELECT user_id, date, min(d) AS d0 FROM lk WHERE steps IS NOT NULL GROUP BY ALL),
  x AS (SELECT lk.*, CASE WHEN d > d0 THEN change END AS chg, active_hours / nullif(active_hours + sedentary_hours, 0) AS ar
        FROM lk LEFT JOIN f USING (user_id, date)),
  st AS (
    SELECT user_id, date, max(n) AS best FROM (
      SELECT user_id, date, g, count(*) AS n FROM (
        SELECT *, i - row_number() OVER (PARTITION BY user_id, date ORDER BY d) AS g FROM (
          SELECT user_id, date, d, sedentary_hours, row_number() OVER (PARTITION BY user_id, date ORDER BY d) AS i FROM lk WHERE steps IS NOT NULL)
        WHERE sedentary_hours >= 18) GROUP BY ALL) GROUP BY ALL),
  p AS (
    SELECT user_id, date, count(steps) AS n, CASE WHEN count(chg) > 0 THEN least(1.0, avg(chg) * 2) END AS p1, avg(variance) AS p2,
           CASE WHEN avg(steps) > 0 THEN least(1.0, stddev_pop(steps) / avg(steps)) END AS p3,
           CASE WHEN avg(energy) > 0 THEN least(1.0, stddev_pop(energy) / avg(energy)) END AS p4,
           avg(sedentary_hours) * 60 AS sm, max(sedentary_hours) * 60 AS sx, count(*) FILTER (steps >= 10000) AS hi,
           count(*) FILTER (steps <= 5000) AS lo, 1 / (1 + var_pop(peak_hour) / 12) AS r1,
           CASE WHEN count(ar) > 0 THEN 1 - least(1.0, stddev_pop(ar) * 2) END AS r2,
           CASE WHEN count(steps) > 1 THEN 1 / (1 + stddev_pop(steps) / (avg(steps) + 1)) END AS r3,
           var_pop(first_hour) AS vf, var_pop(last_hour) AS vl FROM x GROUP BY user_id, date)
  SELECT user_id, date, CASE WHEN n < 2 THEN 0.0 ELSE list_avg(list_filter([p1, p2, p3, p4], lambda v: v IS NOT NULL)) END AS activity_fragmentation,
         coalesce(sm, 0.0) AS sedentary_mean_minutes, coalesce(sx, 0.0) AS sedentary_max_minutes, coalesce(best, 0)::INTEGER AS sedentary_streak,
         hi AS high_days, lo AS low_days, n - hi - lo AS moderate_days,
         CASE WHEN n = 0 THEN 0.0 WHEN lo > 0 THEN hi / lo WHEN hi > 0 THEN hi::DOUBLE ELSE 1.0 END AS intensity_ratio,
         CASE WHEN n = 0 THEN 0.0 ELSE list_avg(list_filter([r1, r2, r3], lambda v: v IS NOT NULL)) END AS rhythm_strength,
         CASE WHEN n > 1 THEN 1 / (1 + vf / 6) ELSE 0.0 END AS onset_consistency, CASE WHEN n > 1 THEN 1 / (1 + vl / 6) ELSE 0.0 END AS offset_consistency
  FROM p LEFT JOIN st USING (user_id, date)""")
SLEEP_F = ["sleep_regularity", "interdaily_stability", "intradaily_variability", "relative_amplitude", "short_sleep_pct",
           "long_sleep_pct", "onset_variance", "wake_variance"]
CLOCK_F = ["l5_value", "m10_value", "phase_advance", "phase_delay", "melatonin_onset", "temperature_nadir",
           "circadian_amplitude", "phase_angle"]
ACT_F = ["activity_fragmentation", "sedentary_mean_minutes", "sedentary_max_minutes", "intensity_ratio", "rhythm_strength",
         "onset_consistency", "offset_consistency"]


def subset(name, ids, group, source, floats, others=()):
    cols = ", ".join(["user_id", "date", *others, r(*floats)]) if floats else ", ".join(["user_id", "date", *others])
    query(name, ids, f"SELECT {cols} FROM {source}")(lambda t: look(t, group).select(*K, *others, *floats))


subset("sleep_regularity_index", "C17 W3", "sleep", "f_sleep", ["sleep_regularity"])
subset("sleep_pattern_stability", "C18", "sleep", "f_sleep", ["interdaily_stability"])
subset("fragmentation_variability", "C19", "sleep", "f_sleep", ["intradaily_variability"])
subset("sleep_consistency_amplitude", "C20", "sleep", "f_sleep", ["relative_amplitude"])
subset("short_long_sleep_percentages", "C21", "sleep", "f_sleep", ["short_sleep_pct", "long_sleep_pct"])
subset("sleep_timing_variances", "C22", "sleep", "f_sleep", ["onset_variance", "wake_variance"])
subset("rest_activity_proxies", "C23 Q11", "clock", "f_clock", ["l5_value", "m10_value"], ["l5_onset", "m10_onset"])
subset("phase_shift_from_norm", "C24", "clock", "f_clock", ["phase_advance", "phase_delay"], ["phase_type"])
subset("melatonin_onset_estimate", "C25", "clock", "f_clock", ["melatonin_onset"])
subset("temperature_nadir_estimate", "C26", "clock", "f_clock", ["temperature_nadir"])
subset("circadian_amplitude", "C27", "clock", "f_clock", ["circadian_amplitude"])
subset("phase_angle", "C28", "clock", "f_clock", ["phase_angle"])
subset("activity_fragmentation", "C29", "activity", "f_act", ["activity_fragmentation"])
subset("sedentary_bouts", "G10", "activity", "f_act", ["sedentary_mean_minutes", "sedentary_max_minutes"], ["sedentary_streak"])
subset("intensity_distribution", "C30", "activity", "f_act", ["intensity_ratio"], ["high_days", "low_days", "moderate_days"])
subset("rhythm_strength", "C31", "activity", "f_act", ["rhythm_strength"])
subset("timing_consistency", "C32", "activity", "f_act", ["onset_consistency", "offset_consistency"])
query("activity_anomalies", "C33", """
  WITH m AS (SELECT user_id, count(*) AS n, median(steps) AS mid, mad(steps) AS mad FROM act_days GROUP BY user_id),
  f AS (
    SELECT a.user_id, date, steps > 15000 OR energy > 600 OR active_hours > 16 AS is_hyperactive,
           steps < 2000 OR energy < 100 OR sedentary_hours > 20 AS is_hypoactive,
           variance > 0.7 OR (n > 3 AND (round(steps, 6) > round(mid + 3 * mad, 6) OR round(steps, 6) < round(mid - 3 * mad, 6))) AS is_irregular
    FROM act_days a JOIN m USING (user_id))
  SELECT * FROM f WHERE is_hyperactive OR is_hypoactive OR is_irregular""")(
    lambda t: X.activity_anomalies(D.daily_activity(t.activity)))

view("f_week", """
  WITH s AS (SELECT user_id, date, sleep_hours AS v, d FROM lk WHERE sleep_hours IS NOT NULL
             QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY d DESC) <= 7),
  a AS (SELECT user_id, date, steps AS v, d FROM lk WHERE steps IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY d DESC) <= 7),
  h AS (SELECT user_id, date, avg_resting_hr AS v, d FROM lk WHERE avg_resting_hr IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY d DESC) <= 7),
  sg AS (SELECT user_id, date, avg(v) AS sleep_7day_mean, stddev_pop(v) AS sleep_7day_std FROM s GROUP BY ALL),
  ag AS (SELECT user_id, date, avg(v) AS activity_7day_mean, stddev_pop(v) AS activity_7day_std FROM a GROUP BY ALL),
  hg AS (SELECT user_id, date, avg(v) AS hr_7day_mean, stddev_pop(v) AS hr_7day_std FROM h GROUP BY ALL)
  SELECT t.user_id, t.date, coalesce(sleep_7day_mean, 0.0) AS sleep_7day_mean, coalesce(sleep_7day_std, 0.0) AS sleep_7day_std,
         coalesce(activity_7day_mean, 0.0) AS activity_7day_mean, coalesce(activity_7day_std, 0.0) AS activity_7day_std,
         coalesce(hr_7day_mean, 0.0) AS hr_7day_mean, coalesce(hr_7day_std, 0.0) AS hr_7day_std
  FROM day_rows t LEFT JOIN sg USING (user_id, date) LEFT JOIN ag USING (user_id, date) LEFT JOIN hg USING (user_id, date)""")
WEEK_F = [f"{n}_7day_{k}" for n in ("sleep", "activity", "hr") for k in ("mean", "std")]
query("seven_day_statistics", "W4 D2", f"SELECT user_id, date, {r('sleep_7day_mean', 'activity_7day_mean', 'hr_7day_mean')}, "
      + ", ".join(f"round({n}_7day_std, 6) AS {n}_7day_std" for n in ("sleep", "activity", "hr")) + " FROM f_week")(
    lambda t: look(t, "week"))
view("f_z", """
  WITH v AS (
    SELECT user_id, date, coalesce(sleep_hours, 0) AS s, coalesce(steps, 0) AS a, coalesce(avg_resting_hr, 0) AS h, coalesce(avg_hrv, 0) AS hv,
           CASE WHEN avg_resting_hr <> 70 THEN avg_resting_hr END AS hk, CASE WHEN avg_hrv <> 50 THEN avg_hrv END AS vk FROM day_rows),
  m AS (
    SELECT *, avg(s) OVER w AS ms, avg(s * s) OVER w AS qs, count(s) OVER w AS ns, avg(a) OVER w AS ma, avg(a * a) OVER w AS qa,
           avg(hk) OVER w AS mh, avg(hk * hk) OVER w AS qh, count(hk) OVER w AS nh, avg(vk) OVER w AS mv, avg(vk * vk) OVER w AS qv, count(vk) OVER w AS nv
    FROM v WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING)),
  d AS (
    SELECT *, CASE WHEN ns > 1 THEN sqrt(round(greatest(qs - ms * ms, 0.0), 9)) ELSE 0 END AS ds,
           CASE WHEN ns > 1 THEN sqrt(round(greatest(qa - ma * ma, 0.0), 9)) ELSE 0 END AS da,
           CASE WHEN nh > 1 THEN sqrt(round(greatest(qh - mh * mh, 0.0), 9)) ELSE 0 END AS dh,
           CASE WHEN nv > 1 THEN sqrt(round(greatest(qv - mv * mv, 0.0), 9)) ELSE 0 END AS dv FROM m)
  SELECT user_id, date, CASE WHEN ds > 0 THEN (s - ms) / ds ELSE 0.0 END AS sleep_z, CASE WHEN da > 0 THEN (a - ma) / da ELSE 0.0 END AS activity_z,
         CASE WHEN dh > 0 THEN (h - mh) / dh ELSE 0.0 END AS hr_z, CASE WHEN dv > 0 THEN (hv - mv) / dv ELSE 0.0 END AS hrv_z FROM d""")
query("running_zscores", "W19", f"SELECT user_id, date, {r('sleep_z', 'activity_z', 'hr_z', 'hrv_z')} FROM f_z")(
    lambda t: X.running_scores(X.daily_join(*daily(t))))
view("f_all", """
  SELECT f_sleep.*, f_clock.* EXCLUDE (user_id, date), f_act.* EXCLUDE (user_id, date), f_week.* EXCLUDE (user_id, date),
         f_z.* EXCLUDE (user_id, date), coalesce(t.sleep_hours, 0.0) AS sleep_hours, coalesce(t.efficiency, 0.0) AS efficiency,
         coalesce(t.steps, 0.0) AS steps, coalesce(t.avg_resting_hr, 0.0) AS avg_resting_hr, coalesce(t.avg_hrv, 0.0) AS avg_hrv,
         long_sleep_pct > 50 AS is_hypersomnia, short_sleep_pct > 50 AS is_insomnia, phase_advance > 2 AS is_advanced,
         phase_delay > 2 AS is_delayed, sleep_regularity < 70 AS is_irregular
  FROM f_sleep JOIN f_clock USING (user_id, date) JOIN f_act USING (user_id, date) JOIN f_week USING (user_id, date)
  JOIN f_z USING (user_id, date) JOIN day_rows t USING (user_id, date)""")
RISK = "0.2 * is_hypersomnia::INTEGER + 0.2 * is_insomnia::INTEGER + 0.15 * is_advanced::INTEGER + 0.15 * is_delayed::INTEGER + 0.3 * is_irregular::INTEGER"
NOW = ["sleep_hours", "efficiency", "steps", "avg_resting_hr", "avg_hrv"]
FLAGS = ["is_hypersomnia", "is_insomnia", "is_advanced", "is_delayed", "is_irregular"]
query("pattern_indicators", "D3", f"SELECT user_id, date, {', '.join(FLAGS)}, round({RISK}, 6)::DOUBLE AS mood_risk FROM f_all")(
    lambda t: X.pattern_indicators(look(t, "sleep", "clock")).select(*K, *FLAGS, "mood_risk"))
ADV = [*NOW, *SLEEP_F, *CLOCK_F, *ACT_F, "sleep_z", "activity_z", "hr_z", "hrv_z", "sleep_7day_mean", "activity_7day_mean", "hr_7day_mean"]
query("advanced_feature_table", "D2", f"""
  SELECT user_id, date, {', '.join(FLAGS)}, l5_onset, m10_onset, phase_type, sedentary_streak, high_days, low_days, moderate_days,
         round({RISK}, 6)::DOUBLE AS mood_risk, {r(*ADV)} FROM f_all""")(
    lambda t: X.advanced_features(*daily(t)).drop("sleep_7day_std", "activity_7day_std", "hr_7day_std"))
query("pattern_notes", "D6", """
  SELECT user_id, date, is_insomnia OR is_hypersomnia OR is_irregular OR interdaily_stability < 0.3 AS is_significant,
         concat_ws('; ', CASE WHEN is_insomnia THEN 'Insomnia pattern detected: consistently short sleep duration' END,
           CASE WHEN is_hypersomnia THEN 'Hypersomnia pattern detected: consistently long sleep duration' END,
           CASE WHEN is_irregular THEN 'Irregular sleep pattern: high variability in sleep timing' END,
           CASE WHEN interdaily_stability < 0.3 THEN 'Very low circadian stability detected' END) AS notes FROM f_all""")(
    lambda t: text(X.pattern_notes(X.pattern_indicators(look(t, "sleep", "clock"))), "notes"))
query("feature_validation", "D7", """
  WITH v AS (
    SELECT user_id, date, (sleep_hours = 0)::INTEGER + (steps = 0)::INTEGER AS m,
           concat_ws('; ', CASE WHEN sleep_hours = 0 THEN 'sleep' END, CASE WHEN steps = 0 THEN 'activity' END) AS missing,
           (sleep_hours > 0 AND sleep_hours < 3)::INTEGER + (sleep_hours > 12)::INTEGER + (steps > 0 AND steps < 100)::INTEGER
             + (sleep_7day_mean = 0 AND activity_7day_mean = 0)::INTEGER AS w,
           concat_ws('; ', CASE WHEN sleep_hours > 0 AND sleep_hours < 3 THEN 'Unusually low sleep duration' END,
             CASE WHEN sleep_hours > 12 THEN 'Unusually high sleep duration' END,
             CASE WHEN steps > 0 AND steps < 100 THEN 'Unusually low activity' END,
             CASE WHEN sleep_7day_mean = 0 AND activity_7day_mean = 0 THEN 'Insufficient historical data for temporal features' END) AS warnings
    FROM f_all)
  SELECT user_id, date, m = 0 AS is_valid, missing, warnings, round(greatest(0.0, least(1.0, 1 - m / 3 - w * 0.05)), 6)::DOUBLE AS quality FROM v""")(
    lambda t: text(X.validation(X.advanced_features(*daily(t))), "missing", "warnings"))
query("feature_anomalies", "D8", """
  WITH v AS (
    SELECT *, is_hypersomnia OR is_insomnia OR sleep_hours < 3 OR sleep_hours > 12 OR efficiency < 0.7 AS ds, sleep_regularity < 50 AS dr,
           is_advanced OR is_delayed AS dc, activity_fragmentation > 0.8 OR steps < 1000 OR steps > 20000 AS da FROM f_all)
  SELECT user_id, date, ds OR dr OR dc OR da AS has_anomalies,
         concat_ws('; ', CASE WHEN ds THEN 'sleep' END, CASE WHEN dr THEN 'sleep_regularity' END, CASE WHEN dc THEN 'circadian' END,
           CASE WHEN da THEN 'activity' END) AS domains,
         greatest(CASE WHEN sleep_hours < 3 THEN 0.8 ELSE 0.0 END, CASE WHEN is_hypersomnia OR is_insomnia THEN 0.7 ELSE 0.0 END,
           CASE WHEN sleep_hours > 12 OR dr OR activity_fragmentation > 0.8 OR steps > 20000 THEN 0.6 ELSE 0.0 END,
           CASE WHEN efficiency < 0.7 OR dc OR steps < 1000 THEN 0.5 ELSE 0.0 END)::DOUBLE AS severity FROM v""")(
    lambda t: text(X.feature_anomalies(X.advanced_features(*daily(t))), "domains"))
query("flattened_features", "D9 Q13", f"""
  WITH tr AS (
    SELECT user_id, date, CASE WHEN pos = 1 THEN 0.0 ELSE regr_slope(y, pos) OVER w END AS trend_slope,
           CASE WHEN pos >= 3 THEN regr_slope(y, pos) OVER s ELSE 0.0 END AS momentum FROM step_series
    WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
           s AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
  SELECT user_id, date, {r('sleep_hours', 'sleep_regularity', 'l5_value', 'phase_angle', 'steps', 'rhythm_strength', 'sleep_7day_mean',
                           'trend_slope', 'momentum')}, is_irregular, round({RISK}, 6)::DOUBLE AS mood_risk
  FROM f_all LEFT JOIN tr USING (user_id, date)""")(
    lambda t: X.flattened(X.unified(X.advanced_features(*daily(t)), R.trend(D.daily_activity(t.activity), "steps", 7).select(
        *K, F.col("slope").alias("trend_slope")).join(R.momentum(D.daily_activity(t.activity), "steps").select(
            *K, F.col("short_term").alias("momentum")), K))).select(
        *K, "sleep_hours", "sleep_regularity", "l5_value", "phase_angle", "steps", "rhythm_strength", "sleep_7day_mean",
        "trend_slope", "momentum", "is_irregular", "mood_risk"))

BASIC = ["sleep_hours", "efficiency", "fragmentation", "onset", "wake", "steps", "variance", "sedentary_hours", "avg_resting_hr",
         "avg_hrv", "hr_range", "alignment"]
view("basic_rows", """
  WITH b AS (
    SELECT user_id, date, n.user_id IS NOT NULL AS z, n.sleep_hours AS s, n.efficiency AS e, n.fragmentation AS f,
           floor(n.bedtime_minute + 1e-9) / 60 AS o, floor(n.wake_minute + 1e-9) / 60 AS w, a.*EXCLUDE (user_id, date),
           h.* EXCLUDE (user_id, date) FROM nights n FULL JOIN act_days a USING (user_id, date) FULL JOIN hearts h USING (user_id, date)),
  c AS (
    SELECT *, coalesce(o, 0) AS on_, coalesce(w, 0) AS wk, coalesce(peak_hour, 0) AS pk, coalesce(hr_range, 0) AS hr,
           coalesce(steps > 15000 OR energy > 600 OR (active_hours > 18 AND steps > 10000), FALSE) AS hi,
           coalesce(steps < 2000 OR energy < 100 OR sedentary_hours > 20, FALSE) AS lo,
           coalesce((avg_hrv > 0 AND avg_hrv < 20) OR (min_hrv > 0 AND min_hrv < 20), FALSE) AS wkh,
           coalesce(hr_range <> 0 AND (hr_range < 10 OR hr_range > 30), FALSE) AS flat FROM b),
  p AS (
    SELECT *, CASE WHEN on_ BETWEEN 22 AND 24 OR on_ BETWEEN 0 AND 1 THEN 1.0 WHEN on_ BETWEEN 20 AND 26 OR on_ <= 2 THEN 0.5 ELSE 0 END AS c1,
           CASE WHEN wk BETWEEN 6 AND 8 THEN 1.0 WHEN wk BETWEEN 5 AND 9 THEN 0.5 ELSE 0 END AS c2, (wk > 0)::INTEGER AS k2,
           CASE WHEN pk BETWEEN 10 AND 18 THEN 1.0 WHEN pk BETWEEN 8 AND 20 THEN 0.5 ELSE 0 END AS c3, (pk > 0)::INTEGER AS k3,
           CASE WHEN hr BETWEEN 10 AND 30 THEN 1.0 WHEN hr BETWEEN 5 AND 40 THEN 0.5 ELSE 0 END AS c4, (hr > 0)::INTEGER AS k4 FROM c)
  SELECT user_id, date, coalesce(s, 0.0) AS sleep_hours, coalesce(e, 0.0) AS efficiency, coalesce(f, 0.0) AS fragmentation, on_ AS onset, wk AS wake,
         coalesce(steps, 0.0) AS steps, coalesce(variance, 0.0) AS variance, coalesce(sedentary_hours, 0.0) AS sedentary_hours,
         coalesce(avg_resting_hr, 0.0) AS avg_resting_hr, coalesce(avg_hrv, 0.0) AS avg_hrv, hr AS hr_range, pk AS peak_hour,
         ((c1 + c2 + c3 + c4) / (1 + k2 + k3 + k4))::DOUBLE AS alignment,
         coalesce(s < 4 OR s > 10 OR e < 0.7 OR f > 0.3, FALSE) OR hi OR lo OR coalesce(variance > 0.5, FALSE)
           OR coalesce(avg_resting_hr > 90, FALSE) OR wkh OR flat OR coalesce(high_episodes > 10 OR low_episodes > 5, FALSE) AS is_significant,
         concat_ws('; ', CASE WHEN s < 4 THEN 'Severe sleep deprivation' WHEN s > 10 THEN 'Hypersomnia pattern' END,
           CASE WHEN e < 0.7 THEN 'Poor sleep efficiency' END, CASE WHEN hi THEN 'Hyperactivity pattern' WHEN lo THEN 'Hypoactivity pattern' END,
           CASE WHEN variance > 0.5 THEN 'Erratic activity pattern' END, CASE WHEN avg_resting_hr > 90 THEN 'Elevated resting heart rate' END,
           CASE WHEN wkh THEN 'Low HRV indicates poor recovery' END, CASE WHEN flat THEN 'Abnormal heart rate circadian rhythm' END) AS notes FROM p""")
query("basic_features", "D5 C39", f"SELECT user_id, date, peak_hour, is_significant, notes, {r(*BASIC)} FROM basic_rows")(
    lambda t: text(X.basic_features(*daily(t)), "notes"))
query("features_for_dates", "D10", """
  WITH c AS (
    SELECT user_id, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
    FROM (SELECT user_id, min(date) AS lo, max(date) AS hi FROM day_rows GROUP BY user_id))
  SELECT c.user_id, c.date, round(sleep_hours, 6) AS sleep_hours, round(steps, 6) AS steps, peak_hour
  FROM c LEFT JOIN basic_rows USING (user_id, date)""")(
    lambda t: X.for_dates(X.basic_features(*daily(t)).select(*K, "sleep_hours", "steps", "peak_hour"),
                          C.user_calendar(X.daily_join(*daily(t)))))


# ---- pipeline table -------------------------------------------------------------------
def pipeline(t):
    folder = scratch(t.spark)
    X.day_facts(t.sleep, t.activity).write.parquet(folder)
    return X.pipeline_from_facts(t.spark.read.parquet(folder))


STEP = ["daily_steps", "activity_variance", "sedentary_hours", "activity_fragmentation", "sedentary_bout_mean", "activity_intensity_ratio"]
view("cal_days", """
  SELECT user_id, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM (
    SELECT user_id, min(d) AS lo, max(d) AS hi FROM (SELECT user_id, start_ts::DATE AS d FROM sleep UNION ALL
    SELECT user_id, start_ts::DATE FROM activity) GROUP BY user_id)""")
view("look_ra", """
  WITH s AS (
    SELECT c.user_id, c.date, h.date AS d, h.hr, h.v FROM cal_days c JOIN hour_rows h ON h.user_id = c.user_id AND h.date BETWEEN c.date - 6 AND c.date),
  n AS (SELECT user_id, date FROM s GROUP BY ALL HAVING count(DISTINCT d) >= 3),
  p AS (SELECT user_id, date, hr, round(avg(v), 6) AS v FROM s GROUP BY ALL),
  b AS (
    SELECT a.user_id, a.date, a.hr, round(sum(b.v) FILTER ((b.hr - a.hr + 24) % 24 < 5) / 5, 9) AS l, round(sum(b.v) FILTER ((b.hr - a.hr + 24) % 24 < 10) / 10, 9) AS m
    FROM p a JOIN p b ON a.user_id = b.user_id AND a.date = b.date GROUP BY ALL),
  g AS (SELECT user_id, date, min(l) AS l, max(m) AS m FROM b GROUP BY ALL)
  SELECT user_id, date, CASE WHEN l + m = 0 THEN 0.0 ELSE (m - l) / (m + l) END AS ra FROM g JOIN n USING (user_id, date)""")
PIPE = f"""
  WITH ok AS (
    SELECT c.user_id, c.date FROM cal_days c JOIN sleep s ON s.user_id = c.user_id AND s.start_ts::DATE BETWEEN c.date - 13 AND c.date
    GROUP BY ALL HAVING count(*) >= 3),
  ci AS (
    SELECT user_id, date, ra, avg(ra) OVER w AS am, stddev_pop(ra) OVER w AS sd,
           CASE WHEN stddev_pop(ra) OVER w > 1e-12 THEN (ra - avg(ra) OVER w) / stddev_pop(ra) OVER w ELSE 0.0 END AS z
    FROM look_ra JOIN ok USING (user_id, date)
    WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
  sw AS (
    SELECT user_id, date, long_num, short_num, {zs(*SLEEP_METRICS)} FROM win_metrics
    WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w >= 3)
  SELECT sw.* EXCLUDE (long_num, short_num), round(coalesce(sleep_hours, 0.0), 6) AS sleep_duration_hours,
         round(short_num / (long_num + short_num), 6) AS short_window_pct, round(long_num / (long_num + short_num), 6) AS long_window_pct,
         round(coalesce(ra, 0.0), 6) AS relative_amplitude, round(coalesce(am, 0.0), 6) AS circadian_amplitude_mean,
         round(coalesce(sd, 0.0), 6) AS circadian_amplitude_std, round(coalesce(z, 0.0), 6) AS circadian_amplitude_zscore,
         round(coalesce(daily_steps, 0.0), 6) AS daily_steps, round(coalesce(m.activity_variance, 0.0), 6) AS activity_variance,
         round(coalesce(m.sedentary_hours, 24.0), 6) AS sedentary_hours, round(coalesce(m.activity_fragmentation, 0.0), 6) AS activity_fragmentation,
         round(coalesce(sedentary_bout_mean, 24.0), 6) AS sedentary_bout_mean, round(coalesce(activity_intensity_ratio, 0.0), 6) AS activity_intensity_ratio
  FROM sw LEFT JOIN ci USING (user_id, date) LEFT JOIN nights USING (user_id, date) LEFT JOIN step_metrics m USING (user_id, date)"""
query("daily_feature_table", "D1 W1 W2 Q5 Q7", PIPE)(pipeline)
NORM = ["sleep_percentage_mean", "sleep_percentage_std", "sleep_amplitude_mean", "long_num_mean", "short_num_zscore", "long_len_mean"]
query("normalized_features", "P18", f"""
  WITH sw AS (
    SELECT user_id, date, {zs('sleep_percentage', 'sleep_amplitude', 'long_num', 'short_num', 'long_len')} FROM win_metrics
    WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w >= 3)
  SELECT user_id, date, round(least(greatest(sleep_percentage_mean, 0.0), 0.5) / 0.5, 6) AS sleep_percentage_mean,
         round(least(greatest(sleep_percentage_std, 0.0), 0.5) / 0.5, 6) AS sleep_percentage_std,
         round(least(greatest(sleep_amplitude_mean, 0.0), 1.0), 6) AS sleep_amplitude_mean, round(least(greatest(long_num_mean, 0.0), 5.0) / 5, 6) AS long_num_mean,
         round(least(greatest(short_num_zscore, 0.0), 10.0) / 10, 6) AS short_num_zscore, long_len_mean FROM sw""")(
    lambda t: X.normalized_table(R.mean_std_z(I.daily_window_metrics(t.sleep), SLEEP_METRICS).select(
        *K, *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in NORM]), NORM))


# ---- model vector -----------------------------------------------------------------------
def vector(t):
    nights, acts, hearts = daily(t)
    return X.model_vector(
        X.advanced_features(nights, acts, hearts), D.first_onset_and_wake(t.sleep), D.episode_fragmentation(t.sleep),
        D.activity_scalars(t.activity), D.heart_scalars(t.heart), C.principal_time(C.minute_totals(t.activity)).select(*K, "pat_hour"))


view("vec", """
  WITH b AS (
    SELECT user_id, start_ts::DATE AS date, first(hour(start_ts) + minute(start_ts) / 60.0 ORDER BY start_ts, end_ts, source_name, rec_id) AS o,
           least(1.0, (count(*) - 1) / 3.0) AS ef FROM sleep GROUP BY ALL),
  e AS (SELECT user_id, end_ts::DATE - 1 AS date, first(hour(end_ts) + minute(end_ts) / 60.0 ORDER BY start_ts, end_ts, source_name, rec_id) AS w
        FROM sleep GROUP BY ALL),
  v AS (SELECT user_id, date, CASE WHEN count(*) < 2 THEN 0.0 ELSE var_pop(value) END AS vv FROM acts GROUP BY ALL),
  h AS (SELECT user_id, ts::DATE AS date, max(value) - min(value) AS vr, hour(first(ts ORDER BY value, ts, rec_id)) AS lh FROM heart GROUP BY ALL),
  p AS (SELECT user_id, date, floor(sum(minute * value) / sum(value) + 1e-9) / 60 AS ph FROM minutes GROUP BY ALL)
  SELECT user_id, date, [sleep_hours, efficiency, coalesce(o, 23.0), coalesce(w, 7.0), coalesce(ef, 0.0), sleep_regularity, short_sleep_pct, long_sleep_pct,
    onset_variance, wake_variance, interdaily_stability, intradaily_variability, relative_amplitude, l5_value, m10_value, 2.0, 10.0, 21.0, steps,
    coalesce(vv, 0.0), sedentary_mean_minutes / 60, activity_fragmentation, sedentary_mean_minutes, intensity_ratio, avg_resting_hr, avg_hrv,
    coalesce(vr, 0.0), coalesce(lh, 4.0), phase_advance, phase_delay, 0.0, coalesce(ph, 14.0), sleep_z, activity_z, hr_z, hrv_z]::DOUBLE[] AS v
  FROM f_all LEFT JOIN b USING (user_id, date) LEFT JOIN e USING (user_id, date) LEFT JOIN v USING (user_id, date)
  LEFT JOIN h USING (user_id, date) LEFT JOIN p USING (user_id, date)""")
query("model_vector", "D4", """
  SELECT user_id, date, (i - 1)::INTEGER AS position, round(v[i], 6) AS value FROM vec, range(1, 37) g(i)""")(
    lambda t: vector(t).select(*K, F.posexplode("vector").alias("position", "value")))
query("vector_confidence", "P24", """
  SELECT user_id, date, round(least(1.0, (len(list_filter(v, lambda x: x <> 0)) / 36
         + len(list_filter([v[3 * i] for i in range(1, 13)], lambda x: abs(x) < 3)) / 12) / 2), 6) AS confidence FROM vec""")(
    lambda t: vector(t).select(*K, X.vector_confidence(F.col("vector")).alias("confidence")))
query("enhanced_vector", "M11", """
  SELECT user_id, date, (i - 1)::INTEGER AS position, round(CASE WHEN i <= 20 THEN v[i] WHEN i <= 32 THEN v[i + 4] ELSE 0.0 END, 6) AS value
  FROM vec, range(1, 37) g(i)""")(
    lambda t: vector(t).select(*K, F.posexplode(enhanced(F.col("vector"))).alias("position", "value")))


def enhanced(v):
    from diurna.operators.modelling import enhanced_vector
    return enhanced_vector(v, F.slice(v, 25, 12))
