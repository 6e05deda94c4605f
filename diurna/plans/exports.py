"""Readers of exports over texts that Spark writes from the events: accepted and rejected records."""

from pyspark.sql import functions as F

from diurna import schemas as S
from diurna.plans.registry import query, view
from diurna.session import scratch
from diurna.sources import health_xml as X
from diurna.sources import metric_json as J

# what the texts hold, in a form that both engines know: a start that is no date, no source, odd values
PERSON = "user_id % 20"
START = "CASE WHEN event_id % 13 = 0 THEN 'soon' ELSE {at} END"
AMOUNT = "CASE event_id % 17 WHEN 0 THEN 'n/a' WHEN 1 THEN '-4' ELSE CAST(CAST(floor(value) AS BIGINT) AS {text}) END"
SLEEP_MINUTES, MOVE_MINUTES = "(event_id * 37) % 460", "event_id % 90 - 5"
VALUE = ("CASE event_id % 7 WHEN 0 THEN 'HKCategoryValueSleepAnalysisInBed' WHEN 1 THEN 'HKCategoryValueSleepAnalysisAsleepREM' "
         "WHEN 2 THEN 'HKCategoryValueSleepAnalysisDozing' ELSE 'HKCategoryValueSleepAnalysisAsleepCore' END")
KIND = ("CASE WHEN event_type IN ('view', 'signup') THEN 'HKCategoryTypeIdentifierSleepAnalysis' WHEN event_type = 'click' "
        "THEN 'HKQuantityTypeIdentifierStepCount' WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN "
        "'HKQuantityTypeIdentifierActiveEnergyBurned' WHEN 1 THEN 'HKQuantityTypeIdentifierDistanceWalkingRunning' ELSE "
        "'HKQuantityTypeIdentifierVO2Max' END WHEN event_id % 5 = 0 THEN 'HKQuantityTypeIdentifierHeartRateVariabilitySDNN' "
        "ELSE 'HKQuantityTypeIdentifierHeartRate' END")


def _minutes(expr: str) -> str:
    return f"ts + make_dt_interval(0, 0, CAST({expr} AS INT), 0)"


def _text(ts: str) -> str:
    return f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss')"


def records(t):
    """The fields of one text record per event, all as text."""
    end = f"CASE WHEN event_type IN ('view', 'signup') THEN {_minutes(SLEEP_MINUTES)} ELSE {_minutes(MOVE_MINUTES)} END"
    return t.raw("events").selectExpr(
        f"{PERSON} AS user", "event_id", "event_type", "to_date(ts) AS day", START.format(at=_text("ts")) + " AS begin",
        f"{_text(end)} AS finish", f"CASE WHEN event_type IN ('view', 'signup') THEN {VALUE} ELSE {AMOUNT.format(text='STRING')} END AS value",
        f"{KIND} AS kind", "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'K&watch' ELSE 'phone' END AS source",
        "CASE WHEN event_id % 19 = 0 THEN '' ELSE 'count' END AS unit", "event_id % 3 AS third")


def _written(rows, *by: str) -> str:
    folder = scratch(rows.sparkSession)
    rows.repartition(*by).write.partitionBy(*by).text(folder)
    return folder


# ---- XML ----------------------------------------------------------------------------

def xml(t, **how):
    """One export per person, records with children and entities."""
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'))
    motion = lambda word: F.lit(f'>\n <MetadataEntry key="{S.MOTION_METADATA_KEY}" value="{word}"/>\n</Record>')
    c = F.col
    line = F.concat(F.lit("<Record"), attribute("type", c("kind")), attribute("sourceName", c("source")), attribute("unit", c("unit")),
                    F.lit(' device="&lt;&lt;a /&gt;"'), attribute("startDate", c("begin")), attribute("endDate", c("finish")), attribute("value", c("value")),
                    F.when(c("event_type") != "error", "/>").when(c("third") == 0, motion("Sedentary")).when(c("third") == 1, motion("2")).otherwise("/>"))
    return X.read_health_xml(t.spark, _written(records(t).select("user", line.alias("line")), "user"), **how)


SOURCE = "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'K&watch' ELSE 'phone' END"
view("told", f"""
  SELECT event_id, event_type, ({PERSON})::BIGINT AS user_id, {SOURCE} AS source_name, ts::DATE AS day,
         CASE WHEN event_id % 13 <> 0 THEN date_trunc('second', ts) END AS start_ts,
         date_trunc('second', ts + to_minutes((CASE WHEN event_type IN ('view', 'signup') THEN {SLEEP_MINUTES} ELSE {MOVE_MINUTES} END)::BIGINT)) AS end_ts,
         {VALUE} AS state_text, TRY_CAST({AMOUNT.format(text='VARCHAR')} AS DOUBLE) AS value, {KIND} AS kind,
         CASE WHEN event_id % 19 = 0 THEN '' ELSE 'count' END AS unit FROM events""")
view("told_sleep", """
  SELECT *, CASE event_id % 7 WHEN 0 THEN 'IN_BED' WHEN 1 THEN 'ASLEEP_REM' WHEN 2 THEN NULL ELSE 'ASLEEP_CORE' END AS state FROM told
  WHERE event_type IN ('view', 'signup')""")
view("xml_sleep_told", """
  SELECT user_id, source_name, start_ts, end_ts, state,
         CASE WHEN state IS NULL THEN 'unknown state' WHEN start_ts IS NULL THEN 'bad date' WHEN end_ts <= start_ts THEN 'end not after start'
              WHEN source_name = '' THEN 'no source' END AS reason FROM told_sleep""")
query("xml_sleep_rows", "S1 S2", "SELECT * FROM xml_sleep_told")(
    lambda t: X.sleep_from_xml(xml(t)).select("user_id", "source_name", "start_ts", "end_ts", "state", "reason"))
query("xml_activity_rows", "S3", """
  SELECT user_id, source_name, start_ts, end_ts, CASE WHEN event_type = 'click' THEN 'STEP_COUNT' WHEN event_id % 3 = 0 THEN 'ACTIVE_ENERGY'
         ELSE 'DISTANCE_WALKING' END AS activity_type, round(value, 6) AS value, unit,
         CASE WHEN start_ts IS NULL THEN 'bad date' WHEN end_ts < start_ts THEN 'end before start' WHEN value IS NULL THEN 'bad value'
              WHEN value < 0 THEN 'negative value' WHEN source_name = '' THEN 'no source' WHEN unit = '' THEN 'no unit' END AS reason
  FROM told WHERE event_type = 'click' OR (event_type = 'purchase' AND event_id % 3 < 2)""")(
    lambda t: X.activity_from_xml(xml(t)).select("user_id", "source_name", "start_ts", "end_ts", "activity_type", "value", "unit", "reason"))
query("xml_heart_rows", "S4", """
  SELECT user_id, source_name, start_ts AS ts, CASE WHEN event_id % 5 = 0 THEN 'HRV_SDNN' ELSE 'HEART_RATE' END AS metric_type,
         round(value, 6) AS value, CASE event_id % 3 WHEN 0 THEN 'sedentary' WHEN 1 THEN 'active' ELSE 'unknown' END AS motion_context,
         CASE WHEN start_ts IS NULL THEN 'bad date' WHEN value IS NULL THEN 'bad value' WHEN value < 0 THEN 'negative value'
              WHEN source_name = '' THEN 'no source' END AS reason FROM told WHERE event_type = 'error'""")(
    lambda t: X.heart_from_xml(xml(t), numeric_motion=True).select(
        "user_id", "source_name", "ts", "metric_type", "value", "motion_context", "reason"))
query("xml_date_filter", "S1", """
  SELECT kind AS type, user_id, start_ts FROM told WHERE event_type = 'click' AND start_ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'""")(
    lambda t: xml(t, types=["HKQuantityTypeIdentifierStepCount"], start="2024-01-05", end="2024-01-07").select("type", "user_id", "start_ts"))
query("file_outcomes", "A29", """
  SELECT user_id, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected, max(reason) AS a_reason,
         CASE WHEN count(*) FILTER (reason IS NULL) > 0 THEN 'success' ELSE 'failed' END AS status FROM xml_sleep_told GROUP BY user_id""")(
    lambda t: X.file_outcomes(X.sleep_from_xml(xml(t))).select(
        X.user_of(F.col("file")).alias("user_id"), "accepted", "rejected", "a_reason", "status"))


# ---- JSON ---------------------------------------------------------------------------

def nested(t):
    """A document of five metrics per person and day."""
    e = F.col("event_type")

    def metric(name: str, of, **fields):
        entry = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])
        return F.struct(F.lit(name).alias("name"), F.collect_list(F.when(of, entry)).alias("data"))

    source = F.when(F.col("source") != "", F.concat("source", F.lit("|Hub")))
    hrv = F.col("kind").endswith("SDNN")
    doc = F.to_json(F.struct(F.struct(F.array(*[F.to_json(m) for m in (
        metric("sleep_analysis", e.isin("view", "signup"), sleepStart="begin", sleepEnd="finish", source=F.nullif("source", F.lit(""))),
        metric("heart_rate", (e == "error") & ~hrv, date="begin", Avg="value", source=source),
        metric("heart_rate_variability", (e == "error") & hrv, date="begin", qty="value", source=source),
        metric("step_count", e == "click", date="begin", qty="value", source=source),
        metric("walking_distance", e == "purchase", date="begin", qty="value", source=source))]).alias("metrics")).alias("data")))
    # metrics differ in their fields, so they were made texts one by one: take their quotes away again
    plain = F.replace(F.replace(F.replace(doc, F.lit('\\"'), F.lit('"')), F.lit('"{'), F.lit("{")), F.lit('}"'), F.lit("}"))
    docs = records(t).groupBy("user", "day").agg(plain.alias("line"))
    return J.nested_entries(t.spark, _written(docs, "user", "day"), "*.txt")


def flat(t, events: str):
    entry = F.struct(F.col("begin").alias("startDate"), F.col("finish").alias("endDate"), "value", F.nullif("unit", F.lit("")).alias("unit"),
                     F.nullif("source", F.lit("")).alias("sourceName"))
    docs = records(t).filter(events).withColumn("unit", F.when(F.col("event_type") == "purchase", "km").otherwise(F.col("unit"))) \
        .groupBy("user", "day").agg(F.to_json(F.struct(F.collect_list(entry).alias("data"))).alias("line"))
    return J.flat_entries(t.spark, _written(docs, "user", "day"), "*.txt")


NAME = "CASE WHEN source_name = '' THEN 'Unknown' ELSE source_name END"
INTERVAL = "CASE WHEN start_ts IS NULL THEN 'bad date' WHEN end_ts <= start_ts THEN 'end not after start' END"
NUMBER = "CASE WHEN start_ts IS NULL THEN 'bad date' WHEN value IS NULL THEN 'bad value' WHEN value < 0 THEN 'negative value' END"
query("json_nested_sleep", "S5 S6", f"""
  SELECT user_id, {NAME} AS source_name, start_ts, end_ts, 'ASLEEP' AS state, {INTERVAL} AS reason FROM told_sleep""")(
    lambda t: J.nested_sleep(nested(t)).select("user_id", "source_name", "start_ts", "end_ts", "state", "reason"))
query("json_flat_sleep", "S7", f"""
  SELECT user_id, {NAME} AS source_name, start_ts, end_ts, CASE WHEN upper(state_text) LIKE '%ASLEEP%' THEN 'ASLEEP' ELSE 'IN_BED' END AS state,
         {INTERVAL} AS reason FROM told_sleep""")(
    lambda t: J.flat_sleep(flat(t, "event_type IN ('view', 'signup')")).select("user_id", "source_name", "start_ts", "end_ts", "state", "reason"))
query("json_nested_heart", "S8", f"""
  SELECT user_id, CASE WHEN source_name = '' THEN 'Unknown' ELSE source_name || '|Hub' END AS source_name, start_ts AS ts,
         CASE WHEN event_id % 5 = 0 THEN 'HRV_SDNN' ELSE 'HEART_RATE' END AS metric_type, round(value, 6) AS value,
         CASE WHEN event_id % 5 = 0 THEN 'ms' ELSE 'count/min' END AS unit, {NUMBER} AS reason FROM told WHERE event_type = 'error'""")(
    lambda t: J.nested_heart(nested(t)).select("user_id", "source_name", "ts", "metric_type", "value", "unit", "reason"))
query("json_nested_activity", "S9", f"""
  SELECT user_id, {NAME} AS source_name, date_trunc('day', start_ts) AS start_ts, date_trunc('day', start_ts) + INTERVAL 86399 SECOND AS end_ts,
         CASE WHEN event_type = 'purchase' THEN 'DISTANCE_WALKING' ELSE 'STEP_COUNT' END AS activity_type, round(value, 6) AS value,
         CASE WHEN event_type = 'purchase' THEN 'km' ELSE 'count' END AS unit, {NUMBER} AS reason FROM told WHERE event_type IN ('click', 'purchase')""")(
    lambda t: J.nested_activity(nested(t)).select("user_id", "source_name", "start_ts", "end_ts", "activity_type", "value", "unit", "reason"))
query("json_flat_activity", "S10", f"""
  SELECT user_id, {NAME} AS source_name, start_ts, end_ts, CASE WHEN event_type = 'purchase' THEN 'DISTANCE_WALKING' ELSE 'STEP_COUNT' END AS activity_type,
         round(value, 6) AS value, CASE WHEN event_type = 'purchase' THEN 'km' ELSE 'count' END AS unit,
         CASE WHEN start_ts IS NULL THEN 'bad date' WHEN end_ts < start_ts THEN 'end before start' WHEN value IS NULL THEN 'bad value'
              WHEN value < 0 THEN 'negative value' END AS reason FROM told WHERE event_type IN ('click', 'purchase')""")(
    lambda t: J.flat_activity(flat(t, "event_type IN ('click', 'purchase')")).select(
        "user_id", "source_name", "start_ts", "end_ts", "activity_type", "value", "unit", "reason"))
