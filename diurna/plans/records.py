"""Record-level projections, filters and scalar functions."""

from pyspark.sql import functions as F

from diurna.functions import exprs as E
from diurna.plans.registry import query
from diurna.session import scratch
from diurna.sources.stored import StoredTable

query("records_in_date_range", "P1 L1", """
  SELECT rec_id, user_id, start_ts, end_ts FROM sleep
  WHERE start_ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")(
    lambda t: t.sleep.filter(E.starts_within("start_ts", "2024-01-05", "2024-01-20"))
    .select("rec_id", "user_id", "start_ts", "end_ts"))
query("records_in_period", "P2", """
  SELECT rec_id, user_id, start_ts, value FROM activity
  WHERE start_ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'""")(
    lambda t: t.activity.filter(F.expr(
        "start_ts BETWEEN TIMESTAMP_NTZ '2024-01-05 06:00:00' AND TIMESTAMP_NTZ '2024-01-20 18:00:00'"))
    .select("rec_id", "user_id", "start_ts", "value").orderBy("start_ts", "rec_id"))
query("records_by_type", "P3", """
  SELECT rec_id, user_id, start_ts, value FROM activity
  WHERE activity_type = 'STEP_COUNT' AND start_ts >= TIMESTAMP '2024-01-10'""")(
    lambda t: t.activity.filter((F.col("activity_type") == "STEP_COUNT")
                                & F.expr("start_ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'"))
    .select("rec_id", "user_id", "start_ts", "value"))
query("records_by_metric", "P3", """
  SELECT rec_id, user_id, ts, round(value, 6) AS value FROM heart WHERE metric_type = 'HRV_SDNN'""")(
    lambda t: t.heart.filter(F.col("metric_type") == "HRV_SDNN").select("rec_id", "user_id", "ts", "value"))
query("record_identifiers", "P4", """
  SELECT rec_id, replace(replace(source_name || '_' || strftime(start_ts, '%Y/%m/%d %H:%M:%S') || '_'
         || strftime(end_ts, '%Y/%m/%d %H:%M:%S') || '_' || activity_type, ':', '-'), '/', '-') AS record_key
  FROM activity""")(
    lambda t: t.activity.select(
        "rec_id", "source_name", "activity_type",
        F.date_format("start_ts", "yyyy/MM/dd HH:mm:ss").alias("a"),
        F.date_format("end_ts", "yyyy/MM/dd HH:mm:ss").alias("b"))
    .select("rec_id", E.record_id("source_name", "a", "b", "activity_type").alias("record_key")))


def keyed(activity):
    return activity.select(
        "rec_id", "user_id", "value", "source_name", "activity_type", F.date_format("start_ts", "yyyy/MM/dd HH:mm:ss").alias("a"),
        F.date_format("end_ts", "yyyy/MM/dd HH:mm:ss").alias("b"), "start_ts").select(
        E.record_id("source_name", "a", "b", "activity_type").alias("record_key"), "rec_id", "user_id", "start_ts", "value")


def found_records(t):
    """Records laid out by key, and a list of keys looked up, every second of which is absent."""
    rows = keyed(t.activity)
    table = StoredTable(t.spark, scratch(t.spark), rows.schema, ("record_key", "rec_id"), buckets=16, bucket_by=("record_key",), bloom=("record_key",))
    table.upsert(rows, [F.col("rec_id")])
    some = rows.orderBy("rec_id").limit(40).select("record_key", "rec_id")
    return table.lookup(some.unionByName(some.select(F.concat("record_key", F.lit("-absent")).alias("record_key"), "rec_id")))


query("records_by_id", "P4", """
  SELECT replace(replace(source_name || '_' || strftime(start_ts, '%Y/%m/%d %H:%M:%S') || '_'
         || strftime(end_ts, '%Y/%m/%d %H:%M:%S') || '_' || activity_type, ':', '-'), '/', '-') AS record_key,
         rec_id, user_id, start_ts, round(value, 6) AS value
  FROM activity WHERE rec_id IN (SELECT rec_id FROM activity ORDER BY rec_id LIMIT 40)""")(found_records)
query("delete_by_period", "P5", """
  SELECT rec_id, user_id, start_ts FROM sleep
  WHERE NOT (start_ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15')""")(
    lambda t: t.sleep.filter(~F.expr(
        "start_ts BETWEEN TIMESTAMP_NTZ '2024-01-08 00:00:00' AND TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
    .select("rec_id", "user_id", "start_ts"))
query("delete_by_period_count", "P5", """
  SELECT user_id, count(*) FILTER (start_ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15') AS removed
  FROM sleep GROUP BY user_id""")(
    lambda t: t.sleep.groupBy("user_id").agg(F.count_if(F.expr(
        "start_ts BETWEEN TIMESTAMP_NTZ '2024-01-08 00:00:00' AND TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
        .alias("removed")))
query("sleep_record_properties", "P6 P7 P8", """
  SELECT rec_id, round((epoch_us(end_ts) - epoch_us(start_ts)) / 3.6e9, 6) AS hours,
         round((epoch_us(end_ts) - epoch_us(start_ts)) / 6e7, 6) AS minutes,
         state NOT IN ('IN_BED', 'AWAKE') AS is_sleep,
         CASE state WHEN 'DEEP' THEN 'restorative' WHEN 'REM' THEN 'rem' WHEN 'CORE' THEN 'light'
              WHEN 'ASLEEP' THEN 'general' WHEN 'IN_BED' THEN 'resting' ELSE 'disrupted' END AS quality
  FROM sleep""")(
    lambda t: t.sleep.select(
        "rec_id", E.hours_between("start_ts", "end_ts").alias("hours"),
        (E.hours_between("start_ts", "end_ts") * 60).alias("minutes"),
        E.is_asleep().alias("is_sleep"), E.sleep_quality().alias("quality")))
query("activity_record_properties", "P9 P10", """
  SELECT rec_id, round(rate, 6) AS per_hour,
         (activity_type = 'STEP_COUNT' AND rate * 24 > 15000)
           OR (activity_type = 'ACTIVE_ENERGY' AND rate * 24 > 500) AS is_high,
         (activity_type = 'STEP_COUNT' AND rate * 24 < 2000)
           OR (activity_type = 'ACTIVE_ENERGY' AND rate * 24 < 100) AS is_low FROM acts""")(
    lambda t: t.activity.select("rec_id", E.intensity_per_hour().alias("per_hour"),
                                E.is_high_activity().alias("is_high"), E.is_low_activity().alias("is_low")))
query("significant_heart_records", "P11", """
  WITH f AS (
    SELECT rec_id, user_id, metric_type = 'HEART_RATE' AND motion_context <> 'active' AND value > 100 AS is_high,
           metric_type = 'HEART_RATE' AND value < 50 AS is_low,
           metric_type = 'HRV_SDNN' AND value < 20 AS is_low_hrv FROM heart)
  SELECT * FROM f WHERE is_high OR is_low OR is_low_hrv""")(
    lambda t: t.heart.filter(E.is_significant_heart()).select(
        "rec_id", "user_id", E.is_high_heart_rate().alias("is_high"),
        E.is_low_heart_rate().alias("is_low"), E.is_low_hrv().alias("is_low_hrv")))
query("clamped_values", "P13", """
  SELECT rec_id, least(greatest(value, 50.0), 90.0) AS value FROM heart""")(
    lambda t: t.heart.select("rec_id", E.clamp(F.col("value"), 50, 90).alias("value")))
query("safe_numbers", "P14", """
  SELECT o_orderkey, coalesce(TRY_CAST(o_orderpriority AS DOUBLE), -1.0) AS whole_text,
         coalesce(TRY_CAST(o_orderpriority[1] || '.0' AS DOUBLE), 0.0) AS as_float,
         o_orderpriority[1]::BIGINT AS as_int FROM orders""")(
    lambda t: t.raw("orders").select(
        "o_orderkey", E.safe_float("o_orderpriority", -1.0).alias("whole_text"),
        E.safe_float(F.concat(F.substring("o_orderpriority", 1, 1), F.lit(".0"))).alias("as_float"),
        E.safe_int(F.concat(F.substring("o_orderpriority", 1, 1), F.lit(".0"))).alias("as_int")))
query("json_numbers", "P14", """
  SELECT event_id, coalesce(TRY_CAST(props->>'k' AS BIGINT), 0) AS k FROM events""")(
    lambda t: t.raw("events").select(
        "event_id", E.safe_int(F.get_json_object("props", "$.k")).alias("k")))
query("parsed_timestamps", "P15", """
  SELECT rec_id, date_trunc('second', start_ts) AS at, start_ts::DATE AS day FROM sleep""")(
    lambda t: t.sleep.select(
        "rec_id", E.local_timestamp(F.concat(
            F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-08:00"))).alias("at"),
        F.to_date(E.local_timestamp(F.date_format("start_ts", "yyyy-MM-dd"))).alias("day")))
query("bedtime_hours", "P16", """
  SELECT rec_id, round(h, 6)::DOUBLE AS hour, round(CASE WHEN h < 12 THEN h + 24 ELSE h END, 6)::DOUBLE AS night_hour
  FROM (SELECT rec_id, hour(start_ts) + minute(start_ts) / 60.0 AS h FROM sleep)""")(
    lambda t: t.sleep.select("rec_id", E.clock_hour("start_ts").alias("hour"),
                             E.evening_hour(E.clock_hour("start_ts")).alias("night_hour")))
query("sleep_time_flag", "P17", """
  SELECT rec_id, hour(start_ts) >= 23 OR hour(start_ts) < 7 AS at_night,
         hour(start_ts) >= 13 AND hour(start_ts) < 15 AS at_nap FROM activity""")(
    lambda t: t.activity.select("rec_id", E.in_sleep_hours(F.hour("start_ts")).alias("at_night"),
                                E.in_sleep_hours(F.hour("start_ts"), 13, 15).alias("at_nap")))
query("episode_type_mapping", "P21", """
  SELECT rec_id, CASE WHEN episode_type = 'mixed' THEN 'mixed_episode' ELSE episode_type || '_episode' END AS diagnosis,
         CASE WHEN episode_type = 'manic' THEN 'manic_mixed' ELSE episode_type END AS treatment,
         episode_type AS diagnostic, episode_type = 'manic' AS known FROM episodes""")(
    lambda t: t.episodes.select(
        "rec_id", E.from_diagnostic(F.upper("episode_type")).alias("diagnosis"),
        E.map_episode_type(F.when(F.col("episode_type") == "manic", "Manic_With_Mixed_Features")
                           .otherwise(F.concat(F.upper("episode_type"), F.lit("_EPISODE"))),
                           E.TO_TREATMENT).alias("treatment"),
        E.map_episode_type(F.concat("episode_type", F.lit("_episode")), E.TO_DIAGNOSTIC).alias("diagnostic"),
        E.is_known_episode_type(F.when(F.col("episode_type") == "manic", "Manic_Episode")
                                .otherwise(F.concat(F.lit("x_"), "episode_type"))).alias("known")))
query("label_search", "P22", """
  SELECT p_partkey, p_name, p_brand FROM part
  WHERE lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE '%ring%' ORDER BY p_partkey LIMIT 10""")(
    lambda t: t.raw("part").filter(
        F.lower("p_name").contains("ring") | F.lower("p_type").contains("ring"))
    .select("p_partkey", "p_name", "p_brand").orderBy("p_partkey").limit(10))
query("labels_by_category", "P22", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#2'")(
    lambda t: t.raw("part").filter(F.col("p_brand") == "Brand#2").select("p_partkey", "p_name"))
