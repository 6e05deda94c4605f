"""Sequence, rhythm and light queries."""

from pyspark.sql import functions as F

from diurna.functions import exprs as E
from diurna.operators import circadian as C
from diurna.operators import daily as D
from diurna.operators import intervals as I
from diurna.operators import light as P
from diurna.plans.nights import r
from diurna.plans.registry import query, view

view("minutes", """
  SELECT user_id, date, (hour(start_ts) * 60 + minute(start_ts))::INTEGER AS minute, sum(value) AS value
  FROM acts WHERE activity_type = 'STEP_COUNT' AND value > 0 GROUP BY ALL""")
MIN = lambda t: C.minute_totals(t.activity)
ACT_DAYS = lambda t: t.activity.select("user_id", F.to_date("start_ts").alias("date")).distinct()

query("minute_sequence", "C1", f"SELECT user_id, date, minute, {r('value')} FROM minutes")(MIN)
query("spread_minute_sequence", "C2", """
  WITH i AS (SELECT user_id, value, epoch_us(start_ts) // 60000000 AS a,
             greatest(epoch_us(start_ts) // 60000000, epoch_us(end_ts) // 60000000) AS b FROM acts),
  m AS (SELECT user_id, value / (b - a + 1) AS v, unnest(range(a, b + 1)) AS m FROM i)
  SELECT user_id, DATE '1970-01-01' + (m // 1440)::INTEGER AS date, (m % 1440)::INTEGER AS minute, round(sum(v), 6) AS value
  FROM m GROUP BY ALL""")(lambda t: C.spread_minutes(t.activity))
query("sequence_statistics", "C3", """
  SELECT user_id, date, round(sum(value), 6) AS total, count(*) AS active_minutes, round(max(value), 6) AS max_minute,
         round(CASE WHEN 1440 - count(*) > 1425 THEN 0.0
               ELSE (list_sort(list(value)))[(1425 - (1440 - count(*)) + 1)::INTEGER] END, 6) AS p99
  FROM minutes GROUP BY user_id, date""")(lambda t: C.sequence_stats(MIN(t)))
query("hourly_totals", "C3", """
  SELECT d.user_id, d.date, h::INTEGER AS hour, round(coalesce(sum(m.value), 0.0), 6) AS total
  FROM (SELECT DISTINCT user_id, date FROM acts) d CROSS JOIN range(24) g(h)
  LEFT JOIN minutes m ON m.user_id = d.user_id AND m.date = d.date AND m.minute // 60 = h GROUP BY ALL""")(
    lambda t: C.hourly_wide(t.activity).select(
        "user_id", "date", F.posexplode(C.hour_array()).alias("hour", "total")))
query("principal_activity_time", "C4", """
  SELECT user_id, date, floor(sum(minute * value) / sum(value) + 1e-9)::INTEGER AS pat_minute,
         round(floor(sum(minute * value) / sum(value) + 1e-9) / 60.0, 6) AS pat_hour,
         round(coalesce(sum(value) FILTER (minute // 60 BETWEEN 6 AND 11), 0.0), 6) AS morning,
         round(coalesce(sum(value) FILTER (minute // 60 BETWEEN 12 AND 17), 0.0), 6) AS afternoon,
         round(coalesce(sum(value) FILTER (minute // 60 >= 18), 0.0), 6) AS evening,
         round(coalesce(sum(value) FILTER (minute // 60 < 6), 0.0), 6) AS night,
         coalesce(sum(value) FILTER (minute // 60 >= 18), 0.0)
           > coalesce(sum(value) FILTER (minute // 60 BETWEEN 6 AND 11), 0.0) AS is_evening_type
  FROM minutes GROUP BY user_id, date""")(lambda t: C.principal_time(MIN(t)))
query("activity_concentration", "C5", """
  WITH h AS (SELECT user_id, date, minute // 60 AS hr, sum(value) AS v FROM minutes GROUP BY ALL),
  p AS (SELECT user_id, date, v / sum(v) OVER (PARTITION BY user_id, date) AS p FROM h)
  SELECT user_id, date, round(CASE WHEN count(*) = 1 THEN 1.0
         ELSE greatest(0.0, least(1.0, 1 + sum(p * ln(p)) / ln(count(*)))) END, 6) AS concentration
  FROM p GROUP BY user_id, date""")(lambda t: C.concentration(MIN(t)))
query("sleep_hours_alignment", "C6", """
  SELECT d.user_id, d.date, round(CASE WHEN coalesce(sum(value), 0) = 0 THEN 1.0
         ELSE 1 - coalesce(sum(value) FILTER (minute // 60 >= 23 OR minute // 60 < 7), 0.0) / sum(value) END, 6) AS alignment
  FROM (SELECT DISTINCT user_id, date FROM acts) d LEFT JOIN minutes m USING (user_id, date) GROUP BY ALL""")(
    lambda t: C.rest_alignment(ACT_DAYS(t), MIN(t)))
query("longest_active_run", "G11", """
  WITH b AS (
    SELECT *, value >= 0.5 * avg(value) OVER (PARTITION BY user_id, date) AS busy FROM minutes),
  i AS (
    SELECT user_id, date, minute - row_number() OVER (PARTITION BY user_id, date ORDER BY minute) AS g FROM b WHERE busy),
  l AS (SELECT user_id, date, count(*) AS n FROM i GROUP BY user_id, date, g)
  SELECT user_id, date, max(n) AS longest_run FROM l GROUP BY user_id, date""")(
    lambda t: C.longest_active_run(MIN(t)))
query("smoothed_minutes", "W13", """
  WITH near AS (
    SELECT DISTINCT user_id, date, minute + s AS minute FROM minutes, generate_series(-2, 2) g(s)
    WHERE minute + s BETWEEN 0 AND 1439)
  SELECT n.user_id, n.date, n.minute::INTEGER AS minute,
         round(sum(m.value) / (least(n.minute + 2, 1439) - greatest(n.minute - 2, 0) + 1), 6) AS smoothed
  FROM near n JOIN minutes m ON m.user_id = n.user_id AND m.date = n.date AND m.minute BETWEEN n.minute - 2 AND n.minute + 2
  GROUP BY n.user_id, n.date, n.minute""")(lambda t: C.smoothed(MIN(t)))

# rhythm over all days: long form, one row per (user, date, hour)
view("hour_rows", """
  SELECT d.user_id, d.date, h::INTEGER AS hr, coalesce(sum(m.value), 0.0) AS v
  FROM (SELECT DISTINCT user_id, date FROM acts) d CROSS JOIN range(24) g(h)
  LEFT JOIN minutes m ON m.user_id = d.user_id AND m.date = d.date AND m.minute // 60 = h GROUP BY ALL""")
view("day_low", """
  WITH b AS (
    SELECT a.user_id, a.date, a.hr, round(sum(b.v) / 5, 9) AS m FROM hour_rows a JOIN hour_rows b
    ON a.user_id = b.user_id AND a.date = b.date AND (b.hr - a.hr + 24) % 24 < 5 GROUP BY ALL)
  SELECT user_id, date, hr AS start FROM b
  QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY m, hr) = 1""")


def rhythm_sql(scope: str, keys: str, select: str) -> str:
    """Rhythm metrics over ``scope``: rows (keys, d = source date, hr, v)."""
    join = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""
  WITH s AS ({scope}),
  n AS (SELECT {keys}, count(DISTINCT d) AS days, round(var_pop(v), 6) AS var FROM s GROUP BY {keys}),
  q AS (
    SELECT {keys}, avg(x * x) AS msd FROM (
      SELECT {keys}, v - lag(v) OVER (PARTITION BY {keys} ORDER BY d, hr) AS x FROM s) GROUP BY {keys}),
  p AS (SELECT {keys}, hr, round(avg(v), 6) AS v FROM s GROUP BY {keys}, hr),
  pv AS (SELECT {keys}, var_pop(v) AS pvar FROM p GROUP BY {keys}),
  l AS (
    SELECT {', '.join('a.' + k for k in keys.split(', '))}, a.hr AS l5_start, round(sum(b.v) / 5, 9) AS l5_value
    FROM p a JOIN p b ON {join} AND (b.hr - a.hr + 24) % 24 < 5 GROUP BY ALL),
  l5 AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY l5_value, l5_start) = 1),
  m AS (
    SELECT {', '.join('a.' + k for k in keys.split(', '))}, a.hr AS m10_start, round(sum(b.v) / 10, 9) AS m10_value
    FROM p a JOIN p b ON {join} AND (b.hr - a.hr + 24) % 24 < 10 GROUP BY ALL),
  m10 AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY m10_value DESC, m10_start) = 1),
  k AS (
    SELECT {', '.join('s.' + k for k in keys.split(', '))}, sqrt(sum(sin(start * 2 * pi() / 24)) ** 2
           + sum(cos(start * 2 * pi() / 24)) ** 2) / count(*) AS res
    FROM (SELECT DISTINCT {keys + (', user_id' if 'user_id' not in keys else '')}, d FROM s) s
    JOIN day_low x ON x.user_id = s.user_id AND x.date = s.d GROUP BY ALL),
  o AS (
    SELECT {keys}, days, CASE WHEN days < 2 THEN 0.0 WHEN var = 0 THEN 1.0
           ELSE least(1.0, greatest(0.0, pvar / var)) END AS interdaily_stability,
           CASE WHEN var = 0 THEN 0.0 ELSE msd / var END AS intradaily_variability,
           CASE WHEN l5_value + m10_value = 0 THEN 0.0
                ELSE least(1.0, greatest(0.0, (m10_value - l5_value) / (m10_value + l5_value))) END AS relative_amplitude,
           l5_value, l5_start, m10_value, m10_start, CASE WHEN days < 3 THEN 0.5 ELSE res END AS l5_consistency
    FROM n JOIN q USING ({keys}) JOIN pv USING ({keys}) JOIN l5 USING ({keys}) JOIN m10 USING ({keys})
    JOIN k USING ({keys}))
  {select}"""


ALL = "SELECT user_id, date AS d, hr, v FROM hour_rows"
query("average_hourly_profile", "C7", """
  SELECT user_id, hr AS hour, round(avg(v), 6) AS average FROM hour_rows GROUP BY user_id, hr""")(
    lambda t: C.rhythm(C.hourly_wide(t.activity)).select("user_id", F.posexplode("profile").alias("hour", "average")))
query("interdaily_stability", "C8", rhythm_sql(ALL, "user_id", f"SELECT user_id, {r('interdaily_stability')} FROM o"))(
    lambda t: C.rhythm(C.hourly_wide(t.activity)).select("user_id", "interdaily_stability"))
query("intradaily_variability", "C9", rhythm_sql(ALL, "user_id", f"SELECT user_id, {r('intradaily_variability')} FROM o"))(
    lambda t: C.rhythm(C.hourly_wide(t.activity)).select("user_id", "intradaily_variability"))
query("rest_activity_blocks", "C10 C11", rhythm_sql(
    ALL, "user_id", f"SELECT user_id, l5_start, m10_start, {r('l5_value', 'm10_value', 'relative_amplitude')} FROM o"))(
    lambda t: C.rhythm(C.hourly_wide(t.activity)).select(
        "user_id", "l5_start", "m10_start", "l5_value", "m10_value", "relative_amplitude"))
query("rest_timing_consistency", "C12", rhythm_sql(ALL, "user_id", f"SELECT user_id, {r('l5_consistency')} FROM o"))(
    lambda t: C.rhythm(C.hourly_wide(t.activity)).select("user_id", "l5_consistency"))
view("m10_halves", """
  WITH p AS (
    SELECT user_id, date >= DATE '2024-01-16' AS late, hr, round(avg(v), 6) AS v FROM hour_rows GROUP BY ALL),
  b AS (
    SELECT a.user_id, a.late, a.hr, round(sum(b.v) / 10, 9) AS m FROM p a JOIN p b
    ON a.user_id = b.user_id AND a.late = b.late AND (b.hr - a.hr + 24) % 24 < 10 GROUP BY ALL)
  SELECT user_id, late, hr FROM b QUALIFY row_number() OVER (PARTITION BY user_id, late ORDER BY m DESC, hr) = 1""")
query("phase_shift", "C13", """
  SELECT a.user_id, CASE WHEN b.hr - a.hr > 12 THEN b.hr - a.hr - 24 WHEN b.hr - a.hr < -12 THEN b.hr - a.hr + 24
         ELSE b.hr - a.hr END::DOUBLE AS shift_hours
  FROM m10_halves a JOIN m10_halves b USING (user_id) WHERE NOT a.late AND b.late""")(
    lambda t: C.phase_shift(
        C.hourly_wide(t.activity).filter("date < DATE '2024-01-16'"),
        C.hourly_wide(t.activity).filter("date >= DATE '2024-01-16'")))
query("disruption_score", "C14", rhythm_sql(ALL, "user_id", """
  SELECT user_id, round(CASE WHEN days < 3 THEN 0.5 ELSE greatest(0.0, least(1.0, 1 - (interdaily_stability
         + 1 - least(intradaily_variability / 2, 1.0) + relative_amplitude + l5_consistency) / 4)) END, 6) AS disruption
  FROM o"""))(lambda t: C.disruption(C.rhythm(C.hourly_wide(t.activity))))
LOOK = ["interdaily_stability", "intradaily_variability", "relative_amplitude", "l5_value", "m10_value", "l5_consistency"]
query("circadian_lookback", "C15 J9", rhythm_sql("""
    SELECT t.user_id, t.date, h.date AS d, h.hr, h.v FROM (SELECT DISTINCT user_id, date FROM acts) t
    JOIN hour_rows h ON h.user_id = t.user_id AND h.date BETWEEN t.date - 6 AND t.date""", "user_id, date",
    f"SELECT user_id, date, days, l5_start, m10_start, {r(*LOOK)} FROM o WHERE days >= 3"))(
    lambda t: C.lookback_rhythm(C.hourly_wide(t.activity), ACT_DAYS(t)).drop("profile"))

view("act_calendar", """
  SELECT user_id, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
  FROM (SELECT user_id, min(date) AS lo, max(date) AS hi FROM acts GROUP BY user_id)""")
query("weekly_sequence_features", "C16 L2", """
  WITH wk AS (
    SELECT c.user_id, c.date, m.value, (m.date - c.date + 6) * 1440 + m.minute AS i
    FROM act_calendar c JOIN minutes m ON m.user_id = c.user_id AND m.date BETWEEN c.date - 6 AND c.date),
  s AS (
    SELECT *, lag(i) OVER (PARTITION BY user_id, date ORDER BY i) AS prev,
           lead(i) OVER (PARTITION BY user_id, date ORDER BY i) AS nxt,
           row_number() OVER (PARTITION BY user_id, date ORDER BY value DESC) AS nth FROM wk),
  g AS (
    SELECT user_id, date, sum(value) AS total, count(*) AS active, count(DISTINCT i // 1440) AS days,
           sum((i // 60) * value) / sum(value) AS pat, sum(value) FILTER (nth <= 1008) / 1008 AS peak,
           count(*) FILTER (i > 0 AND (prev IS NULL OR prev < i - 1))
             + count(*) FILTER (i < 10079 AND (nxt IS NULL OR nxt > i + 1)) AS flips
    FROM s GROUP BY user_id, date)
  SELECT c.user_id, c.date, round(coalesce(total, 0.0), 6) AS total_activity, coalesce(active, 0) AS active_minutes,
         round(coalesce(round(pat, 6) % 24, 0.0), 6) AS pat_hour, round(coalesce(flips, 0) / 10080.0, 6)::DOUBLE AS fragmentation,
         round(coalesce(days, 0) / 7.0, 6)::DOUBLE AS quality, round(coalesce(peak, 0.0), 6) AS peak_activity
  FROM act_calendar c LEFT JOIN g USING (user_id, date)""")(
    lambda t: C.weekly_features(MIN(t), C.user_calendar(ACT_DAYS(t)))
    .withColumn("active_minutes", F.col("active_minutes").cast("long")))
query("weekly_sequences", "W23", """
  WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) AS nth FROM act_calendar)
  SELECT c.user_id, c.date, 10080 AS length, (7 - count(DISTINCT m.date))::INTEGER AS missing,
         round(count(DISTINCT m.date) / 7.0, 6)::DOUBLE AS quality, round(coalesce(sum(value), 0.0), 6) AS total,
         round(coalesce(sum(value * ((m.date - c.date + 6) * 1440 + m.minute)), 0.0) / 1e6, 6) AS mass
  FROM c LEFT JOIN minutes m ON m.user_id = c.user_id AND m.date BETWEEN c.date - 6 AND c.date
  WHERE nth >= 7 GROUP BY ALL""")(
    lambda t: C.weekly_sequences(MIN(t), C.user_calendar(ACT_DAYS(t))).select(
        "user_id", "date", F.size("activity").alias("length"), F.size("missing_days").alias("missing"), "quality",
        F.aggregate("activity", F.lit(0.0), lambda a, x: a + x).alias("total"),
        (F.aggregate(F.transform("activity", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x) / 1e6).alias("mass")))
query("standardized_hours", "P19", """
  SELECT user_id, date, hr AS hour, round(CASE WHEN stddev_pop(v) OVER w > 0 THEN (v - avg(v) OVER w)
         / stddev_pop(v) OVER w ELSE v - avg(v) OVER w END, 6) AS z FROM hour_rows
  WINDOW w AS (PARTITION BY user_id, date)""")(
    lambda t: C.hourly_wide(t.activity).select(
        "user_id", "date", F.posexplode(E.standardize(C.hour_array())).alias("hour", "z")))
query("hour_patches", "P20", """
  SELECT user_id, date, (hr // 9)::INTEGER AS patch, count(*)::INTEGER AS size, round(sum(v), 6) AS total FROM hour_rows
  WHERE hr < 18 GROUP BY user_id, date, hr // 9""")(
    lambda t: C.hourly_wide(t.activity).select(
        "user_id", "date", F.posexplode(E.patches(C.hour_array(), 9)).alias("patch", "v")).select(
        "user_id", "date", "patch", F.size("v").alias("size"),
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total")))

# light and phase
query("hours_overlapping_sleep", "J10", """
  SELECT DISTINCT user_id, h::DATE AS date, hour(h)::INTEGER AS hour
  FROM (SELECT *, unnest(generate_series(date_trunc('hour', start_ts), end_ts, INTERVAL 1 HOUR)) AS h FROM sleep)
  WHERE h < end_ts AND h + INTERVAL 1 HOUR > start_ts""")(lambda t: I.sleep_hours_of_day(t.sleep))
query("sleep_light_profile", "C34", """
  WITH a AS (
    SELECT DISTINCT user_id, h::DATE AS date, hour(h) AS hour
    FROM (SELECT *, unnest(generate_series(date_trunc('hour', start_ts), end_ts, INTERVAL 1 HOUR)) AS h FROM sleep)
    WHERE h < end_ts AND h + INTERVAL 1 HOUR > start_ts),
  d AS (SELECT DISTINCT user_id, date FROM a)
  SELECT d.user_id, d.date, h::INTEGER AS hour, CASE WHEN a.hour IS NULL THEN 250.0 ELSE 0.0 END::DOUBLE AS lux
  FROM d CROSS JOIN range(24) g(h) LEFT JOIN a ON a.user_id = d.user_id AND a.date = d.date AND a.hour = h""")(
    lambda t: P.sleep_light(t.sleep).select("user_id", "date", F.posexplode("lux").alias("hour", "lux")))
ACT_LUX = """
  WITH t AS (SELECT user_id, max(value) / 2 AS half FROM acts WHERE value > 0 GROUP BY user_id),
  a AS (SELECT user_id, date, hour(start_ts) AS hr, sum(value) AS v FROM acts GROUP BY ALL),
  d AS (SELECT DISTINCT user_id, date FROM acts)
  SELECT d.user_id, d.date, h::INTEGER AS hour, {0} * CASE WHEN v IS NULL THEN 0 WHEN v >= 0.7 * half THEN 500
         WHEN v >= 0.4 * half THEN 300 WHEN v >= 0.25 * half THEN 150 WHEN v >= 0.1 * half THEN 50 ELSE 0 END::DOUBLE AS lux
  FROM d CROSS JOIN range(24) g(h) LEFT JOIN a ON a.user_id = d.user_id AND a.date = d.date AND a.hr = h
  LEFT JOIN t ON t.user_id = d.user_id"""
query("activity_light_profile", "C35", ACT_LUX.format("1.0::DOUBLE"))(
    lambda t: P.activity_light(t.activity).select("user_id", "date", F.posexplode("lux").alias("hour", "lux")))
query("seasonal_light_profile", "C36", ACT_LUX.format("(CASE WHEN day(d.date) % 2 = 0 THEN 2.0 ELSE 1.0 END)::DOUBLE"))(
    lambda t: P.activity_light(t.activity).select("user_id", "date", F.posexplode(P.seasonal(
        F.col("lux"), F.when(F.dayofmonth("date") % 2 == 0, 9.5).otherwise(14.0))).alias("hour", "lux")))
view("cohort_days", """
  SELECT user_id, day, sum(intensity) AS total_activity FROM actigraphy GROUP BY ALL""")
query("cohort_circadian_features", "C38", """
  WITH o AS (
    SELECT user_id, total_activity AS x, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i,
           total_activity - lag(total_activity) OVER (PARTITION BY user_id ORDER BY day) AS step,
           row_number() OVER (PARTITION BY user_id ORDER BY total_activity) AS nth,
           count(*) OVER (PARTITION BY user_id) AS n FROM cohort_days),
  sl AS (SELECT user_id, i % 24 AS s, avg(x) AS m FROM o GROUP BY ALL),
  b AS (SELECT user_id, var_pop(m) * count(*) AS num FROM sl GROUP BY user_id),
  g AS (
    SELECT user_id, count(*) AS days, var_pop(x) AS v, avg(step * step) AS msd, avg(x) FILTER (nth <= n // 5) AS l5,
           avg(x) FILTER (nth > n - ceil(n / 10)) AS m10 FROM o GROUP BY user_id)
  SELECT user_id, days, round(CASE WHEN v > 1e-9 THEN num / (v * days) ELSE 0.0 END, 6) AS stability,
         round(CASE WHEN v > 1e-9 THEN msd / v ELSE 0.0 END, 6) AS variability,
         round(CASE WHEN m10 + l5 > 0 THEN (m10 - l5) / (m10 + l5) ELSE 0.0 END, 6) AS amplitude,
         round(l5, 6) AS l5, round(m10, 6) AS m10 FROM g JOIN b USING (user_id)""")(
    lambda t: C.cohort_circadian(t.actigraphy.groupBy("user_id", "day").agg(F.sum("intensity").alias("total_activity"))))
