"""SQL restatement of the canonical and daily tables, written from their definitions."""

from diurna.plans.registry import view

view("sleep", """
  SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'watch' ELSE 'phone' END AS source_name,
         ts AS start_ts, ts + to_minutes((20 + (event_id * 37) % 460)::BIGINT) AS end_ts,
         CASE event_id % 10 WHEN 0 THEN 'IN_BED' WHEN 1 THEN 'AWAKE' WHEN 2 THEN 'REM' WHEN 3 THEN 'DEEP'
              WHEN 4 THEN 'CORE' ELSE 'ASLEEP' END AS state, event_id AS rec_id
  FROM events WHERE event_type IN ('view', 'signup')""")
view("activity", """
  SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'watch' ELSE 'phone' END AS source_name,
         ts AS start_ts, ts + to_minutes((event_id % 90)::BIGINT) AS end_ts,
         CASE WHEN event_type = 'click' THEN 'STEP_COUNT' WHEN event_id % 3 = 0 THEN 'ACTIVE_ENERGY'
              WHEN event_id % 3 = 1 THEN 'DISTANCE_WALKING' ELSE 'FLIGHTS_CLIMBED' END AS activity_type,
         (CASE WHEN event_type = 'click' THEN value * 100 WHEN event_id % 3 = 0 THEN value
              WHEN event_id % 3 = 1 THEN value / 10 ELSE floor(value / 10) END)::DOUBLE AS value,
         CASE WHEN event_type = 'click' THEN 'count' WHEN event_id % 3 = 0 THEN 'kcal'
              WHEN event_id % 3 = 1 THEN 'km' ELSE 'count' END AS unit, event_id AS rec_id
  FROM events WHERE event_type IN ('click', 'purchase')""")
view("heart", """
  SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'watch' ELSE 'phone' END AS source_name, ts,
         CASE WHEN event_id % 5 = 0 THEN 'HRV_SDNN' ELSE 'HEART_RATE' END AS metric_type,
         CASE WHEN event_id % 5 = 0 THEN 5 + value % 60 ELSE 40 + value % 90 END AS value,
         CASE WHEN event_id % 5 = 0 THEN 'ms' ELSE 'count/min' END AS unit,
         CASE event_id % 3 WHEN 0 THEN 'sedentary' WHEN 1 THEN 'active' ELSE 'unknown' END AS motion_context,
         event_id AS rec_id
  FROM events WHERE event_type = 'error'""")
view("episodes", """
  SELECT o_custkey AS user_id, o_orderdate::DATE AS start_date,
         o_orderdate::DATE + (o_orderkey % 21)::INTEGER AS end_date,
         CASE o_orderkey % 4 WHEN 0 THEN 'depressive' WHEN 1 THEN 'manic' WHEN 2 THEN 'hypomanic'
              ELSE 'mixed' END AS episode_type,
         o_orderpriority[1]::INTEGER AS severity, o_orderstatus AS notes,
         'r' || (o_custkey % 5) AS rater_id,
         o_orderdate + to_minutes((o_orderkey % 1440)::BIGINT) AS labeled_at, o_orderkey AS rec_id
  FROM orders""")
view("actigraphy", """
  SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS day,
         row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)::INTEGER AS minute_no,
         value * 10 AS intensity FROM events""")
view("survey", "SELECT c_custkey AS user_id, " + ", ".join(
    f"((c_custkey * ({i} + 3) + {i}) % 4)::INTEGER AS q{i}" for i in range(1, 10)) + " FROM customer")
view("rx", "SELECT l_suppkey AS user_id, l_partkey AS drug_key FROM lineitem")
view("drugs", "SELECT p_partkey AS drug_key, lower(p_name) || CASE p_partkey % 400 WHEN 7 THEN ' sertraline' WHEN 13 THEN ' d00149' ELSE '' END AS drug_id FROM part")

view("slept", """
  SELECT *, (epoch_us(end_ts) - epoch_us(start_ts)) / 3.6e9 AS hrs,
         state IN ('ASLEEP', 'REM', 'CORE', 'DEEP') AS asleep,
         CASE WHEN hour(start_ts) >= 18 THEN start_ts::DATE WHEN hour(start_ts) < 6 THEN start_ts::DATE - 1
              WHEN hour(mid) >= 12 THEN mid::DATE ELSE mid::DATE - 1 END AS date
  FROM (SELECT *, make_timestamp(epoch_us(start_ts) + (epoch_us(end_ts) - epoch_us(start_ts)) // 2) AS mid
        FROM sleep)""")
view("nights", """
  WITH gaps AS (
    SELECT user_id, date, start_ts, end_ts,
           epoch_us(start_ts) - epoch_us(lag(end_ts) OVER w) AS gap,
           first_value(start_ts) OVER w AS f, row_number() OVER (PARTITION BY user_id, date
             ORDER BY start_ts DESC, end_ts DESC) AS back
    FROM slept WHERE asleep WINDOW w AS (PARTITION BY user_id, date ORDER BY start_ts, end_ts)),
  frag AS (
    SELECT user_id, date, sum(gap) AS gap, count(*) AS n,
           max(CASE WHEN back = 1 THEN epoch_us(end_ts) - epoch_us(f) END) AS period
    FROM gaps GROUP BY ALL),
  main AS (
    SELECT user_id, date, start_ts, hrs FROM slept
    QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY hrs DESC, start_ts, rec_id) = 1),
  base AS (
    SELECT user_id, date, sum(hrs) AS bed_hours, coalesce(sum(hrs) FILTER (asleep), 0.0) AS sleep_hours,
           count(*) FILTER (asleep) AS sleep_sessions,
           coalesce(max(hrs) FILTER (asleep), 0.0) AS longest_hours,
           min(epoch_us(start_ts) % 86400000000) / 6e7 AS bedtime_minute,
           max(epoch_us(end_ts) % 86400000000) / 6e7 AS wake_minute
    FROM slept GROUP BY ALL)
  SELECT b.*, sleep_hours / bed_hours AS efficiency,
         CASE WHEN coalesce(f.n, 0) > 1 AND period > 0 THEN f.gap / f.period ELSE 0.0 END AS fragmentation,
         (epoch_us(m.start_ts) - epoch_us(b.date::TIMESTAMP)) / 6e7 + m.hrs * 30 AS mid_sleep_minute
  FROM base b LEFT JOIN frag f USING (user_id, date) LEFT JOIN main m USING (user_id, date)""")

view("acts", """
  SELECT *, start_ts::DATE AS date, (epoch_us(end_ts) - epoch_us(start_ts)) / 3.6e9 AS hrs,
         CASE WHEN end_ts = start_ts THEN value
              ELSE value / ((epoch_us(end_ts) - epoch_us(start_ts)) / 3.6e9) END AS rate
  FROM activity""")
view("steps_day", """
  SELECT user_id, date, sum(v) AS steps
  FROM (SELECT user_id, date, start_ts, end_ts, max(value) AS v FROM acts
        WHERE activity_type = 'STEP_COUNT' GROUP BY ALL) GROUP BY ALL""")
view("peaks", """
  WITH span AS (
    SELECT user_id, date, rate, hour(start_ts) AS a,
           CASE WHEN start_ts = end_ts THEN hour(start_ts) ELSE hour(end_ts) END AS b FROM acts),
  spread AS (
    SELECT user_id, date, hr, round(sum(rate), 6) AS rate
    FROM span, generate_series(0, 23) g(hr) WHERE hr BETWEEN a AND b GROUP BY ALL)
  SELECT user_id, date, hr::INTEGER AS peak_hour FROM spread
  QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY rate DESC, hr) = 1""")
view("act_days", """
  SELECT a.user_id, a.date,
         coalesce(sum(value) FILTER (activity_type = 'ACTIVE_ENERGY'), 0.0) AS energy,
         coalesce(sum(value) FILTER (activity_type = 'DISTANCE_WALKING'), 0.0) AS distance,
         coalesce(sum(value) FILTER (activity_type = 'FLIGHTS_CLIMBED'), 0.0) AS flights,
         count(*) AS sessions,
         CASE WHEN count(*) < 2 OR avg(rate) = 0 THEN 0.0
              ELSE least(stddev_pop(rate) / avg(rate) / 1.5, 1.0) END AS variance,
         coalesce(sum(hrs) FILTER (rate < 250), 0.0) AS sedentary_hours,
         coalesce(sum(hrs) FILTER (rate >= 250), 0.0) AS active_hours,
         min(epoch_us(start_ts) % 86400000000) / 6e7 AS first_minute,
         max(epoch_us(start_ts) % 86400000000) / 6e7 AS last_minute,
         coalesce(any_value(s.steps), 0.0) AS steps, any_value(p.peak_hour) AS peak_hour
  FROM acts a LEFT JOIN steps_day s ON a.user_id = s.user_id AND a.date = s.date
  LEFT JOIN peaks p ON a.user_id = p.user_id AND a.date = p.date
  GROUP BY a.user_id, a.date""")
view("step_bins", """
  SELECT d.user_id, d.date, hr::INTEGER AS hr,
         round(coalesce(sum(CASE WHEN activity_type = 'STEP_COUNT' THEN value / greatest(1.0, hrs) END), 0.0), 9) AS v
  FROM (SELECT DISTINCT user_id, date FROM acts) d CROSS JOIN generate_series(0, 23) g(hr)
  LEFT JOIN acts a ON a.user_id = d.user_id AND a.date = d.date AND hour(a.start_ts) = hr GROUP BY ALL""")
view("step_metrics", """
  WITH seq AS (
    SELECT *, v < 250 AS rest, lag(v < 250) OVER (PARTITION BY user_id, date ORDER BY hr) AS before
    FROM step_bins),
  m AS (
    SELECT user_id, date, var_pop(v) AS activity_variance, count(*) FILTER (rest) AS rests,
           count(*) FILTER (before <> rest) AS flips,
           count(*) FILTER (rest AND (before IS NULL OR NOT before)) AS bouts,
           count(*) FILTER (v >= 1000) AS busy
    FROM seq GROUP BY ALL)
  SELECT user_id, date,
         coalesce((SELECT sum(value) FROM acts a WHERE a.user_id = m.user_id AND a.date = m.date
                   AND activity_type = 'STEP_COUNT'), 0.0) AS daily_steps,
         activity_variance, rests::DOUBLE AS sedentary_hours, flips / 23.0::DOUBLE AS activity_fragmentation,
         CASE WHEN bouts > 0 THEN rests / bouts ELSE 24.0 END AS sedentary_bout_mean,
         CASE WHEN rests < 24 THEN busy / (24 - rests) ELSE 0.0 END AS activity_intensity_ratio
  FROM m""")
view("hearts", """
  WITH h AS (
    SELECT *, ts::DATE AS date, metric_type = 'HEART_RATE' AS hr, metric_type = 'HRV_SDNN' AS hv,
           motion_context <> 'active' AS calm FROM heart),
  d AS (
    SELECT user_id, date, coalesce(avg(value) FILTER (hr AND calm), 0.0) AS avg_resting_hr,
           coalesce(min(value) FILTER (hr), 0.0) AS min_hr, coalesce(max(value) FILTER (hr), 0.0) AS max_hr,
           coalesce(avg(value) FILTER (hv), 0.0) AS avg_hrv, coalesce(min(value) FILTER (hv), 0.0) AS min_hrv,
           count(*) FILTER (hr) AS hr_readings, count(*) FILTER (hv) AS hrv_readings,
           count(*) FILTER (hr AND calm AND value > 100) AS high_episodes,
           count(*) FILTER (hr AND value < 50) AS low_episodes,
           coalesce(avg(value) FILTER (hr AND calm AND hour(ts) BETWEEN 6 AND 8), 0.0) AS morning_hr,
           coalesce(avg(value) FILTER (hr AND calm AND hour(ts) BETWEEN 18 AND 21), 0.0) AS evening_hr
    FROM h GROUP BY ALL)
  SELECT *, CASE WHEN morning_hr <> 0 AND evening_hr <> 0 THEN abs(evening_hr - morning_hr) ELSE 0.0 END AS hr_range
  FROM d""")

# windows: plain per-user lag and running sum, the textbook form
view("day_wins", """
  WITH o AS (
    SELECT user_id, start_ts::DATE AS date, start_ts, end_ts,
           epoch_us(start_ts) - epoch_us(lag(end_ts) OVER w) AS gap
    FROM sleep WINDOW w AS (PARTITION BY user_id, start_ts::DATE ORDER BY start_ts, end_ts)),
  g AS (
    SELECT *, sum(CASE WHEN gap IS NULL OR gap > 13500000000 THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id, date ORDER BY start_ts, end_ts) AS win FROM o),
  u AS (
    SELECT *, max(epoch_us(end_ts)) OVER (PARTITION BY user_id, date, win ORDER BY start_ts, end_ts
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g)
  SELECT user_id, date, win, min(start_ts) AS window_start, max(end_ts) AS window_end, count(*) AS episodes,
         sum(greatest(0, epoch_us(end_ts) - greatest(epoch_us(start_ts), coalesce(reach, 0)))) / 3.6e9 AS hours,
         (max(epoch_us(end_ts)) - min(epoch_us(start_ts))) / 3.6e9 AS span_hours,
         count(*) FILTER (gap > 0 AND gap <= 13500000000) AS gaps,
         coalesce(sum(gap) FILTER (gap > 0 AND gap <= 13500000000), 0) / 3.6e9 AS gap_hours,
         list(gap / 3.6e9) FILTER (gap > 0 AND gap <= 13500000000) AS gap_list
  FROM u GROUP BY user_id, date, win""")
view("user_wins", """
  WITH o AS (
    SELECT user_id, start_ts, end_ts, epoch_us(start_ts) - epoch_us(lag(end_ts) OVER w) AS gap
    FROM sleep WINDOW w AS (PARTITION BY user_id ORDER BY start_ts, end_ts)),
  g AS (
    SELECT *, sum(CASE WHEN gap IS NULL OR gap > 13500000000 THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id ORDER BY start_ts, end_ts) AS win FROM o),
  u AS (
    SELECT *, max(epoch_us(end_ts)) OVER (PARTITION BY user_id, win ORDER BY start_ts, end_ts
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g)
  SELECT user_id, win, min(start_ts) AS window_start, max(end_ts) AS window_end, count(*) AS episodes,
         sum(greatest(0, epoch_us(end_ts) - greatest(epoch_us(start_ts), coalesce(reach, 0)))) / 3.6e9 AS hours,
         (max(epoch_us(end_ts)) - min(epoch_us(start_ts))) / 3.6e9 AS span_hours,
         count(*) FILTER (gap > 0 AND gap <= 13500000000) AS gaps,
         coalesce(sum(gap) FILTER (gap > 0 AND gap <= 13500000000), 0) / 3.6e9 AS gap_hours
  FROM u GROUP BY user_id, win""")
view("win_metrics", """
  WITH gl AS (SELECT user_id, date, unnest(gap_list) AS g FROM day_wins),
  amp AS (SELECT user_id, date, stddev_pop(g) / avg(g) AS amp FROM gl GROUP BY ALL),
  m AS (
    SELECT user_id, date, sum(hours) * 60 / 1440 AS sleep_percentage,
           count(*) FILTER (hours >= 3.75) AS long_num,
           coalesce(sum(hours) FILTER (hours >= 3.75), 0.0) AS long_len,
           coalesce(sum(hours) FILTER (hours >= 3.75), 0.0) AS long_st,
           coalesce(sum(gap_hours) FILTER (hours >= 3.75), 0.0) AS long_wt,
           count(*) FILTER (hours < 3.75) AS short_num,
           coalesce(sum(hours) FILTER (hours < 3.75), 0.0) AS short_len,
           coalesce(sum(hours) FILTER (hours < 3.75), 0.0) AS short_st,
           coalesce(sum(gap_hours) FILTER (hours < 3.75), 0.0) AS short_wt
    FROM day_wins GROUP BY ALL)
  SELECT m.*, coalesce(amp, 0.0) AS sleep_amplitude FROM m LEFT JOIN amp USING (user_id, date)""")
