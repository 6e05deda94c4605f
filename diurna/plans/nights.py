"""Daily aggregation and interval queries."""

from pyspark.sql import functions as F

from diurna.operators import daily as D
from diurna.operators import intervals as I
from diurna.plans.registry import query

ROUND = "round({0}, 6) AS {0}"


def r(*names: str) -> str:
    """Rounded output columns of a statement."""
    return ", ".join(ROUND.format(n) for n in names)


query("sleep_day_assignment", "A1", "SELECT rec_id, user_id, date FROM slept")(
    lambda t: D.with_sleep_date(t.sleep).select("rec_id", "user_id", "date"))

NIGHT = ["bed_hours", "sleep_hours", "efficiency", "longest_hours"]
query("daily_sleep_summary", "A2 P6 P7",
      f"SELECT user_id, date, sleep_sessions, {r(*NIGHT)} FROM nights")(
    lambda t: D.daily_sleep(t.sleep).select("user_id", "date", "sleep_sessions", *NIGHT))
query("sleep_fragmentation", "A3", f"SELECT user_id, date, {r('fragmentation')} FROM nights")(
    lambda t: D.daily_sleep(t.sleep).select("user_id", "date", "fragmentation"))
MARKS = ["bedtime_minute", "wake_minute", "mid_sleep_minute"]
query("sleep_clock_markers", "A4", f"SELECT user_id, date, {r(*MARKS)} FROM nights")(
    lambda t: D.daily_sleep(t.sleep).select("user_id", "date", *MARKS))
query("sleep_significance", "A5", """
  SELECT user_id, date, sleep_hours < 4 OR sleep_hours > 10 OR efficiency < 0.7 OR fragmentation > 0.3
         AS is_significant FROM nights""")(
    lambda t: D.sleep_flags(D.daily_sleep(t.sleep)).select("user_id", "date", "is_significant"))
query("onset_wake_datetime", "A6", """
  SELECT user_id, date, make_timestamp(epoch_us(date::TIMESTAMP) + round(bedtime_minute * 6e7)::BIGINT) AS onset_ts,
         make_timestamp(epoch_us((date + CASE WHEN wake_minute < 720 THEN 1 ELSE 0 END)::TIMESTAMP)
                        + round(wake_minute * 6e7)::BIGINT) AS wake_ts FROM nights""")(
    lambda t: D.onset_and_wake(D.daily_sleep(t.sleep)))

query("deduped_steps", "A7", f"SELECT user_id, date, {r('steps')} FROM steps_day")(
    lambda t: D.deduped_steps(t.activity))
ACT = ["energy", "distance", "flights", "variance", "sedentary_hours", "active_hours",
       "first_minute", "last_minute", "steps"]
query("daily_activity_summary", "A8 A10 A11 A12",
      f"SELECT user_id, date, sessions, peak_hour, {r(*ACT)} FROM act_days")(
    lambda t: D.daily_activity(t.activity))
query("peak_activity_hour", "A9", "SELECT user_id, date, peak_hour FROM peaks")(
    lambda t: D.peak_hours(t.activity))
query("activity_variance", "A10", f"SELECT user_id, date, {r('variance')} FROM act_days")(
    lambda t: D.daily_activity(t.activity).select("user_id", "date", "variance"))
query("sedentary_active_hours", "A11",
      f"SELECT user_id, date, {r('sedentary_hours', 'active_hours')} FROM act_days")(
    lambda t: D.daily_activity(t.activity).select("user_id", "date", "sedentary_hours", "active_hours"))
query("first_last_activity", "A12",
      f"SELECT user_id, date, {r('first_minute', 'last_minute')} FROM act_days")(
    lambda t: D.daily_activity(t.activity).select("user_id", "date", "first_minute", "last_minute"))
query("activity_flags", "A13", """
  SELECT user_id, date, steps > 15000 OR energy > 600 OR (active_hours > 18 AND steps > 10000) AS is_high,
         steps < 2000 OR energy < 100 OR sedentary_hours > 20 AS is_low, variance > 0.5 AS is_erratic
  FROM act_days""")(lambda t: D.activity_flags(D.daily_activity(t.activity)))
HEART = ["avg_resting_hr", "min_hr", "max_hr", "avg_hrv", "min_hrv"]
query("daily_heart_summary", "A14", f"""
  SELECT user_id, date, hr_readings, hrv_readings, high_episodes, low_episodes, {r(*HEART)} FROM hearts""")(
    lambda t: D.daily_heart(t.heart).drop("morning_hr", "evening_hr", "hr_range"))
query("morning_evening_heart", "A15",
      f"SELECT user_id, date, {r('morning_hr', 'evening_hr', 'hr_range')} FROM hearts")(
    lambda t: D.daily_heart(t.heart).select("user_id", "date", "morning_hr", "evening_hr", "hr_range"))
query("heart_flags", "A16", """
  WITH f AS (
    SELECT user_id, date, avg_resting_hr > 90 AS high_resting,
           (avg_hrv > 0 AND avg_hrv < 20) OR (min_hrv > 0 AND min_hrv < 20) AS low_hrv,
           hr_range <> 0 AND (hr_range < 10 OR hr_range > 30) AS abnormal_range,
           high_episodes > 10 OR low_episodes > 5 AS many_episodes FROM hearts)
  SELECT *, high_resting OR low_hrv OR abnormal_range OR many_episodes AS is_significant FROM f""")(
    lambda t: D.heart_flags(D.daily_heart(t.heart)))
STEP = ["daily_steps", "activity_variance", "sedentary_hours", "activity_fragmentation",
        "sedentary_bout_mean", "activity_intensity_ratio"]
query("hourly_step_metrics", "A17 W14", f"SELECT user_id, date, {r(*STEP)} FROM step_metrics")(
    lambda t: D.hourly_step_metrics(t.activity))
query("activity_value_variance", "A30", """
  SELECT user_id, date, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE var_pop(value) END, 6) AS value_variance
  FROM acts GROUP BY ALL""")(lambda t: D.activity_scalars(t.activity))
query("heart_day_scalars", "A30", """
  SELECT user_id, ts::DATE AS date, round(max(value) - min(value), 6) AS value_range,
         hour(first(ts ORDER BY value, ts, rec_id))::DOUBLE AS lowest_hour
  FROM heart GROUP BY user_id, ts::DATE""")(lambda t: D.heart_scalars(t.heart))
query("episode_fragmentation", "A30", """
  SELECT user_id, start_ts::DATE AS date, round(least(1.0, (count(*) - 1) / 3.0), 6) AS episode_fragmentation
  FROM sleep GROUP BY ALL""")(lambda t: D.episode_fragmentation(t.sleep))
query("first_onset_wake", "A31", """
  WITH b AS (
    SELECT user_id, start_ts::DATE AS date, first(hour(start_ts) + minute(start_ts) / 60.0
           ORDER BY start_ts, end_ts, source_name, rec_id) AS o FROM sleep GROUP BY ALL),
  e AS (
    SELECT user_id, end_ts::DATE - 1 AS date, first(hour(end_ts) + minute(end_ts) / 60.0
           ORDER BY start_ts, end_ts, source_name, rec_id) AS w FROM sleep GROUP BY ALL)
  SELECT user_id, date, round(coalesce(o, 23.0), 6)::DOUBLE AS onset_hour,
         round(coalesce(w, 7.0), 6)::DOUBLE AS wake_hour
  FROM b FULL JOIN e USING (user_id, date)""")(lambda t: D.first_onset_and_wake(t.sleep))

# ---- intervals ---------------------------------------------------------------

WIN = ["hours", "span_hours", "gap_hours"]
query("merged_sleep_windows", "G1 G3 G4", f"""
  SELECT user_id, window_start, window_end, episodes, {r(*WIN)}, gaps,
         round(gap_hours / span_hours, 6) AS fragmentation, episodes > 1 AS is_fragmented FROM user_wins""")(
    lambda t: I.merge_sleep_windows(t.sleep).drop("gap_sq").withColumn("episodes", F.col("episodes")))
query("sleep_window_gaps", "G2", """
  WITH o AS (
    SELECT user_id, start_ts, end_ts, epoch_us(start_ts) - epoch_us(lag(end_ts) OVER w) AS gap
    FROM sleep WINDOW w AS (PARTITION BY user_id ORDER BY start_ts, end_ts)),
  g AS (
    SELECT *, max(CASE WHEN gap IS NULL OR gap > 13500000000 THEN start_ts END)
             OVER (PARTITION BY user_id ORDER BY start_ts, end_ts) AS window_start FROM o)
  SELECT user_id, window_start, start_ts AS gap_end, round(gap / 3.6e9, 6) AS gap_hours FROM g
  WHERE gap > 0 AND gap <= 13500000000""")(lambda t: I.window_gaps(t.sleep))
query("union_sleep_hours", "G3", """
  WITH u AS (
    SELECT user_id, start_ts, end_ts, max(end_ts) OVER (PARTITION BY user_id ORDER BY start_ts, end_ts
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sleep)
  SELECT user_id, round(sum(greatest(0, epoch_us(end_ts) - greatest(epoch_us(start_ts),
         coalesce(epoch_us(reach), 0)))) / 3.6e9, 6) AS union_hours FROM u GROUP BY user_id""")(
    lambda t: I.union_hours(t.sleep, ["user_id"]))
query("sleep_window_summary", "G5", """
  SELECT user_id, count(*) AS windows, count(*) FILTER (hours < 6) AS short_windows,
         count(*) FILTER (hours > 10) AS long_windows, count(*) FILTER (episodes > 1) AS fragmented_windows,
         round(avg(hours), 6) AS avg_hours, round(count(*) FILTER (hours < 6) / count(*) * 100, 6) AS short_pct,
         round(count(*) FILTER (hours > 10) / count(*) * 100, 6) AS long_pct,
         round(count(*) FILTER (episodes > 1) / count(*) * 100, 6) AS fragmented_pct
  FROM user_wins GROUP BY user_id""")(lambda t: I.window_summary(I.merge_sleep_windows(t.sleep)))
DAYWIN = ["sleep_percentage", "sleep_amplitude", "long_len", "long_st", "long_wt", "short_len",
          "short_st", "short_wt"]
query("daily_sleep_window_metrics", "G6",
      f"SELECT user_id, date, long_num, short_num, {r(*DAYWIN)} FROM win_metrics")(
    lambda t: I.daily_window_metrics(t.sleep))
