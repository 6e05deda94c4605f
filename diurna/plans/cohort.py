"""Cohort, label, baseline, calibration and evaluation queries."""

from pyspark.sql import functions as F

from diurna.functions import exprs as E
from diurna.operators import cohort as CO
from diurna.operators import daily as D
from diurna.operators import intervals as I
from diurna.operators import modelling as MO
from diurna.operators import rolling as R
from diurna.plans.nights import r
from diurna.plans.registry import query, view
from diurna.plans.rules import patient_days
from diurna.session import scratch
from diurna.sources.stored import StoredTable

K = ["user_id", "date"]
CLASSES = {"benzodiazepine": ["ring"], "ssri": ["widget"]}
ITEMS = [f"q{i}" for i in range(1, 10)]

query("cohort_daily_activity", "A18", f"""
  WITH d AS (
    SELECT user_id, day, sum(intensity) AS total_activity, avg(intensity) AS mean_activity, stddev_samp(intensity) AS std_activity,
           count(*) FILTER (intensity < 100) AS sedentary_minutes, count(*) FILTER (intensity >= 100 AND intensity < 760) AS moderate_minutes,
           count(*) FILTER (intensity >= 760) AS vigorous_minutes FROM actigraphy GROUP BY ALL)
  SELECT user_id, day, sedentary_minutes, moderate_minutes, vigorous_minutes, {r('total_activity', 'mean_activity', 'std_activity')} FROM d""")(
    lambda t: CO.cohort_daily(t.actigraphy))
view("scores", "SELECT user_id, q1+q2+q3+q4+q5+q6+q7+q8+q9 AS total FROM survey")
query("questionnaire_score", "A19", "SELECT user_id, total, (total >= 10)::INTEGER AS depressed FROM scores")(
    lambda t: CO.questionnaire(t.survey, ITEMS))
view("med_flags", """
  SELECT user_id, coalesce(max((drug_id LIKE '%ring%')::INTEGER), 0) AS benzodiazepine, coalesce(max((drug_id LIKE '%widget%')::INTEGER), 0) AS ssri
  FROM rx LEFT JOIN drugs USING (drug_key) GROUP BY user_id""")
query("medication_flags", "A20 J7", "SELECT user_id, benzodiazepine, ssri, ssri AS antidepressant FROM med_flags")(
    lambda t: CO.medication_flags(t.rx, t.drugs, CLASSES))
query("medication_class_tokens", "A20", f"""
  SELECT user_id, benzodiazepine, ssri, ssri AS antidepressant FROM (
    SELECT user_id, coalesce(max(regexp_matches(drug_id, '{'|'.join(CO.BENZODIAZEPINES)}')::INTEGER), 0) AS benzodiazepine,
           coalesce(max(regexp_matches(drug_id, '{'|'.join(CO.SSRIS)}')::INTEGER), 0) AS ssri
    FROM rx LEFT JOIN drugs USING (drug_key) GROUP BY user_id)""")(
    lambda t: CO.medication_flags(t.rx, t.drugs, {"benzodiazepine": CO.BENZODIAZEPINES, "ssri": CO.SSRIS}))
query("attached_drug_ids", "J7", """
  SELECT drug_id, count(*) AS prescriptions FROM rx LEFT JOIN drugs USING (drug_key) GROUP BY drug_id""")(
    lambda t: CO.with_drug_id(t.rx, t.drugs).groupBy("drug_id").agg(F.count(F.lit(1)).alias("prescriptions")))
query("cohort_assembled", "J6 U4", """
  SELECT a.user_id, total, (total >= 10)::INTEGER AS depressed, coalesce(benzodiazepine, 0) AS benzodiazepine, coalesce(ssri, 0) AS ssri, ssri AS antidepressant
  FROM (SELECT DISTINCT user_id FROM actigraphy) a LEFT JOIN scores USING (user_id) LEFT JOIN med_flags USING (user_id)""")(
    lambda t: CO.assemble(t.actigraphy, CO.questionnaire(t.survey, ITEMS), CO.medication_flags(t.rx, t.drugs, CLASSES)))
query("distinct_subjects", "U4", "SELECT DISTINCT user_id FROM actigraphy")(lambda t: t.actigraphy.select("user_id").distinct())
query("sliding_sequences", "W22", """
  WITH p AS (
    SELECT user_id, intensity, (minute_no % 7)::INTEGER AS label, row_number() OVER (PARTITION BY user_id ORDER BY day, minute_no) - 1 AS i FROM actigraphy),
  w AS (
    SELECT user_id, k AS window_no, intensity, label, i FROM p, range(0, 100000) g(k) WHERE k BETWEEN (i - 19) / 5 AND i // 5 AND i BETWEEN k * 5 AND k * 5 + 19)
  SELECT user_id, window_no, count(*)::INTEGER AS size, round(sum(intensity), 6) AS total,
         round(sum(intensity * (i - window_no * 5)), 6) AS mass, max(label) FILTER (i = window_no * 5 + 10) AS label FROM w GROUP BY user_id, window_no HAVING count(*) = 20""")(
    lambda t: CO.sliding_sequences(t.actigraphy, 20, 5, (F.col("minute_no") % 7).cast("int")).select(
        "user_id", "window_no", "label", F.size("sequence").alias("size"), F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.aggregate(F.transform("sequence", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x).alias("mass")))

# ---- labels -------------------------------------------------------------------------
query("episode_conflicts", "J11", """
  SELECT c.rec_id, c.user_id FROM episodes c WHERE rec_id % 2 = 0 AND EXISTS (
    SELECT 1 FROM episodes s WHERE s.user_id = c.user_id AND s.rec_id % 2 = 1 AND s.start_date <= c.end_date AND s.end_date >= c.start_date)""")(
    lambda t: I.conflicting(t.episodes.filter("rec_id % 2 = 0"), t.episodes.filter("rec_id % 2 = 1")).select("rec_id", "user_id"))
query("label_agreement", "J15", """
  WITH l AS (SELECT user_id, start_ts::DATE AS date, CASE WHEN sum(rec_id) % 3 = 0 THEN 'depressive' ELSE 'manic' END AS label FROM sleep GROUP BY ALL),
  p AS (SELECT user_id, date, CASE WHEN steps > 3000 THEN 'manic' ELSE 'depressive' END AS predicted FROM act_days)
  SELECT user_id, date, label, predicted, label = predicted AS model_agreed FROM l LEFT JOIN p USING (user_id, date)""")(
    lambda t: CO.label_agreement(
        t.sleep.groupBy("user_id", F.to_date("start_ts").alias("date")).agg(
            F.when(F.sum("rec_id") % 3 == 0, "depressive").otherwise("manic").alias("label")),
        D.daily_activity(t.activity).select(*K, F.when(F.col("steps") > 3000, "manic").otherwise("depressive").alias("predicted"))))
query("label_stats", "A26 A28", """
  SELECT episode_type, count(*) AS labels, count(DISTINCT rater_id) AS raters, min(start_date) AS first_day, max(end_date) AS last_day,
         round(avg(end_date - start_date + 1), 6) AS avg_days, min(end_date - start_date + 1)::INTEGER AS min_days,
         max(end_date - start_date + 1)::INTEGER AS max_days, round(avg(severity), 6) AS avg_severity,
         round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM episodes GROUP BY episode_type""")(
    lambda t: CO.label_stats(t.episodes))
query("rater_names", "A26", "SELECT DISTINCT episode_type, rater_id FROM episodes")(lambda t: CO.rater_names(t.episodes))
query("label_duration_check", "R17", """
  WITH d AS (
    SELECT rec_id, (end_date - start_date + 1)::INTEGER AS days,
           CASE episode_type WHEN 'depressive' THEN 14 WHEN 'hypomanic' THEN 4 ELSE 7 END AS required_days FROM episodes)
  SELECT *, days >= required_days AS is_long_enough FROM d""")(
    lambda t: CO.duration_check(t.episodes).select("rec_id", "days", "required_days", "is_long_enough"))
query("episodes_in_range", "R18", """
  SELECT rec_id, user_id, start_date, end_date FROM episodes WHERE start_date >= DATE '1996-01-01' AND end_date <= DATE '1997-12-31'""")(
    lambda t: t.episodes.filter("start_date >= DATE '1996-01-01' AND end_date <= DATE '1997-12-31'")
    .select("rec_id", "user_id", "start_date", "end_date").orderBy("start_date", "rec_id"))
query("episodes_by_rater", "R18", "SELECT rec_id, user_id, rater_id FROM episodes WHERE rater_id = 'r3'")(
    lambda t: t.episodes.filter(F.col("rater_id") == "r3").select("rec_id", "user_id", "rater_id"))
query("upserted_episodes", "K7", """
  WITH n AS (
    SELECT user_id, start_date, rater_id, severity, labeled_at, rec_id FROM episodes UNION ALL
    SELECT user_id, start_date, rater_id, severity + 10, labeled_at + INTERVAL 1 DAY, rec_id FROM episodes WHERE rec_id % 7 = 0)
  SELECT user_id, start_date, rater_id, severity, labeled_at, rec_id FROM n
  QUALIFY row_number() OVER (PARTITION BY user_id, start_date, rater_id ORDER BY labeled_at DESC, rec_id DESC) = 1""")(
    lambda t: CO.upsert(
        t.episodes.select("user_id", "start_date", "rater_id", "severity", "labeled_at", "rec_id"),
        t.episodes.filter("rec_id % 7 = 0").select(
            "user_id", "start_date", "rater_id", (F.col("severity") + 10).alias("severity"),
            F.expr("labeled_at + interval 1 day").alias("labeled_at"), "rec_id"),
        ["user_id", "start_date", "rater_id"], [F.col("labeled_at"), F.col("rec_id")]))


def stored_episodes(t):
    """Two batches into a stored table; the second meets a seventh of the rows."""
    columns = ["user_id", "start_date", "rater_id", "severity", "labeled_at", "rec_id"]
    first = t.episodes.select(*columns)
    table = StoredTable(t.spark, scratch(t.spark), first.schema, ("user_id", "start_date", "rater_id"), buckets=8, bucket_by=("user_id",))
    newest = [F.col("labeled_at"), F.col("rec_id")]
    table.upsert(first, newest)
    table.upsert(first.filter("rec_id % 7 = 0").withColumns(
        {"severity": F.col("severity") + 10, "labeled_at": F.expr("labeled_at + interval 1 day")}), newest)
    return table.read()


query("stored_episodes", "K7", """
  WITH n AS (
    SELECT user_id, start_date, rater_id, severity, labeled_at, rec_id FROM episodes UNION ALL
    SELECT user_id, start_date, rater_id, severity + 10, labeled_at + INTERVAL 1 DAY, rec_id FROM episodes WHERE rec_id % 7 = 0)
  SELECT user_id, start_date, rater_id, severity, labeled_at, rec_id FROM n
  QUALIFY row_number() OVER (PARTITION BY user_id, start_date, rater_id ORDER BY labeled_at DESC, rec_id DESC) = 1""")(stored_episodes)
query("first_row_per_date", "K2", """
  SELECT user_id, start_ts::DATE AS date, rec_id, start_ts FROM sleep
  QUALIFY row_number() OVER (PARTITION BY user_id, start_ts::DATE ORDER BY start_ts, rec_id) = 1""")(
    lambda t: CO.once_per_date(t.sleep.select("user_id", F.to_date("start_ts").alias("date"), "rec_id", "start_ts"),
                               [F.col("start_ts"), F.col("rec_id")]))

# ---- baselines ------------------------------------------------------------------------
view("baselines", """
  SELECT user_id, date AS as_of, 'sleep' AS feature_name, mean, std, n, (date + 1)::TIMESTAMP AS effective_ts FROM sleep_state
  UNION ALL
  SELECT user_id, date, 'activity', avg(steps) OVER w, sqrt(round(CASE WHEN count(*) OVER w > 1 THEN greatest(avg(steps * steps) OVER w
         - (avg(steps) OVER w) ** 2, 0.0) ELSE 0.0 END, 9)), count(*) OVER w, (date + 1)::TIMESTAMP FROM act_days
  WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING)""")


def sleep_snaps(t):
    return CO.snapshots(R.incremental_baseline(D.daily_sleep(t.sleep), "sleep_hours"), "sleep")


def snaps(t):
    return sleep_snaps(t).unionByName(CO.snapshots(R.incremental_baseline(D.daily_activity(t.activity), "steps"), "activity"))


query("latest_baseline", "M12 J14", f"""
  SELECT user_id, feature_name, as_of, n, {r('mean')}, round(std, 6) AS std FROM baselines
  QUALIFY row_number() OVER (PARTITION BY user_id, feature_name ORDER BY as_of DESC) = 1""")(
    lambda t: CO.latest_snapshot(snaps(t)))
query("baseline_as_of", "J14", """
  SELECT a.user_id, a.date, b.as_of AS baseline_date, round(b.mean, 6) AS baseline_mean, round(b.std, 6) AS baseline_std
  FROM act_days a ASOF LEFT JOIN (SELECT * FROM baselines WHERE feature_name = 'sleep') b ON a.user_id = b.user_id AND a.date >= b.as_of""")(
    lambda t: CO.as_of(D.daily_activity(t.activity).select(*K), sleep_snaps(t)))
HIST = """
  WITH w AS (
    SELECT user_id, as_of, coalesce(max(mean) FILTER (feature_name = 'sleep'), 7.0) AS sleep_mean,
           coalesce(max(mean) FILTER (feature_name = 'activity'), 8000.0) AS activity_mean FROM baselines GROUP BY ALL)
  SELECT user_id, as_of, round(sleep_mean, 6) AS sleep_mean, round(activity_mean, 6) AS activity_mean,
         (row_number() OVER (PARTITION BY user_id ORDER BY as_of {0}))::INTEGER AS nth FROM w QUALIFY nth <= 10"""
query("baseline_history", "W17 Q12", HIST.format("ASC"))(
    lambda t: CO.baseline_history(snaps(t), {"sleep": 7.0, "activity": 8000.0}))
query("baseline_history_latest", "W17 Q12", HIST.format("DESC"))(
    lambda t: CO.baseline_history(snaps(t), {"sleep": 7.0, "activity": 8000.0}, latest=True))
query("baseline_buckets", "A21 Q14", """
  SELECT user_id, feature_name, as_of AS bucket, round(avg(mean), 6) AS avg_value, round(stddev_samp(mean), 6) AS std_value, count(*) AS n,
         max(effective_ts) AS latest FROM baselines WHERE as_of > DATE '2023-12-31' AND as_of <= DATE '2024-01-30' GROUP BY ALL""")(
    lambda t: CO.baseline_buckets(snaps(t), F.lit("2024-01-30").cast("date")))
query("bitemporal_rows", "K8", """
  SELECT user_id, as_of, feature_name, round(value, 6) AS value FROM (
    SELECT user_id, date AS as_of, 'mean' AS feature_name, mean AS value FROM sleep_state UNION ALL
    SELECT user_id, date, 'std', std FROM sleep_state)""")(
    lambda t: CO.long_snapshot(sleep_snaps(t), ["mean", "std"]))


def known_versions(t):
    """Sleep baselines as first known, and a correction of some that came twelve days after."""
    first = sleep_snaps(t)
    late = first.filter("(user_id + unix_date(as_of)) % 5 = 0").withColumns(
        {"mean": F.col("mean") + 1, "effective_ts": F.col("effective_ts") + F.expr("interval 12 days")})
    return first.unionByName(late)


query("baseline_as_known", "K8 J14", """
  WITH v AS (
    SELECT user_id, as_of, effective_ts, mean, std FROM baselines WHERE feature_name = 'sleep' UNION ALL
    SELECT user_id, as_of, effective_ts + INTERVAL 12 DAY, mean + 1, std FROM baselines
    WHERE feature_name = 'sleep' AND (user_id + (as_of - DATE '1970-01-01')) % 5 = 0),
  q AS (SELECT user_id, date, date::TIMESTAMP + to_days((CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 15 END)::INTEGER) AS known_at FROM act_days)
  SELECT q.user_id, q.date, q.known_at, v.as_of, v.effective_ts, round(v.mean, 6) AS mean, round(v.std, 6) AS std
  FROM q LEFT JOIN v ON q.user_id = v.user_id AND v.as_of <= q.date AND v.effective_ts <= q.known_at
  QUALIFY row_number() OVER (PARTITION BY q.user_id, q.date ORDER BY v.as_of DESC NULLS LAST, v.effective_ts DESC) = 1""")(
    lambda t: CO.as_known(
        D.daily_activity(t.activity).select(*K, (
            F.col("date").cast("timestamp_ntz") + F.expr("make_dt_interval(CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 15 END)")).alias("known_at")),
        known_versions(t).select("user_id", "as_of", "effective_ts", "mean", "std"), ["user_id"]))
query("personal_sleep_baseline", "M1", """
  WITH n AS (SELECT * FROM nights QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC) <= 30)
  SELECT user_id, round(avg(sleep_hours), 6) AS mean_sleep, round(stddev_samp(sleep_hours), 6) AS std_sleep,
         round(avg(efficiency), 6) AS mean_efficiency, round(avg(bedtime_minute / 60), 6) AS mean_onset FROM n GROUP BY user_id""")(
    lambda t: CO.sleep_baseline(D.daily_sleep(t.sleep)))
HOURLY = """
  h AS (SELECT user_id, hour(start_ts) AS hr, avg(value) AS m, stddev_samp(value) AS s FROM activity GROUP BY ALL),
  pk AS (SELECT user_id, hr FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(m, 9) DESC, hr) = 1)"""
query("personal_activity_baseline", "M2", f"""
  WITH d AS (SELECT user_id, date, sum(value) AS v FROM acts GROUP BY ALL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC) <= 30),
  l AS (SELECT user_id, avg(v) AS m FROM d GROUP BY user_id), {HOURLY}
  SELECT h.user_id, round(any_value(l.m), 6) AS mean_daily_activity, round(stddev_samp(h.m), 6) AS activity_rhythm,
         any_value(pk.hr)::DOUBLE AS peak_hour, round(max(h.m) - min(h.m), 6) AS amplitude
  FROM h JOIN l USING (user_id) JOIN pk USING (user_id) GROUP BY h.user_id""".replace("GROUP BY ALL QUALIFY", "GROUP BY user_id, date QUALIFY"))(
    lambda t: CO.activity_baseline(t.activity))
query("personal_circadian_baseline", "M3", f"""
  WITH {HOURLY.strip()}
  SELECT h.user_id, any_value(pk.hr)::DOUBLE AS circadian_phase, round(max(m) - min(m), 6) AS circadian_amplitude,
         round(1 - avg(CASE WHEN m > 0 THEN s / m ELSE 0.0 END), 6) AS circadian_stability FROM h JOIN pk USING (user_id) GROUP BY h.user_id""")(
    lambda t: CO.circadian_baseline(t.activity))
query("baseline_deviations", "M4", """
  WITH d AS (SELECT user_id, date, sum(value) AS v FROM acts GROUP BY user_id, date),
  l AS (SELECT user_id, avg(v) AS ma FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC) <= 30) GROUP BY user_id),
  s AS (SELECT user_id, avg(sleep_hours) AS ms, stddev_samp(sleep_hours) AS ss FROM (
    SELECT * FROM nights QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC) <= 30) GROUP BY user_id)
  SELECT user_id, date, round((sleep_hours - ms) / nullif(coalesce(ss, 30.0), 0), 6) AS sleep_z, round((v - ma) / nullif(ma, 0) * 100, 6) AS activity_change_pct
  FROM nights JOIN d USING (user_id, date) JOIN l USING (user_id) JOIN s USING (user_id)""")(
    lambda t: CO.deviations(
        D.daily_sleep(t.sleep).select(*K, "sleep_hours").join(
            t.activity.groupBy("user_id", F.to_date("start_ts").alias("date")).agg(F.sum("value").alias("activity")), K),
        CO.sleep_baseline(D.daily_sleep(t.sleep)).join(CO.activity_baseline(t.activity), "user_id")))

# ---- evaluation and calibration ------------------------------------------------------------
view("scored", """
  SELECT l.doc_id, l.quality AS y, l.toxic AS p, ((l.doc_id * 37 + l.quality * 20) % 101) / 100 AS s, (l.doc_id % 7)::INTEGER AS user_id FROM labels l""")
SCORED = lambda t: t.raw("labels").select(
    "doc_id", F.col("quality").alias("y"), F.col("toxic").alias("p"),
    ((F.col("doc_id") * 37 + F.col("quality") * 20) % 101 / 100).alias("s"), (F.col("doc_id") % 7).cast("int").alias("user_id"))
query("binary_metrics", "M7", """
  WITH c AS (
    SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y <> 1 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p <> 1) AS fn,
           count(*) FILTER (y <> 1 AND p <> 1) AS tn FROM scored)
  SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
         round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1,
         round(coalesce(tn / nullif(tn + fp, 0), 0.0), 6) AS specificity FROM c""")(lambda t: MO.binary_metrics(SCORED(t), "y", "p"))
query("roc_auc", "M7", """
  WITH k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM scored),
  g AS (SELECT sum(r) FILTER (y = 1) AS sr, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM k)
  SELECT round((sr - p * (p + 1) / 2) / (p * n), 6) AS auc FROM g""")(lambda t: MO.auc(SCORED(t), "y", "s"))
query("time_series_splits", "M6", """
  WITH o AS (
    SELECT user_id, date, row_number() OVER (PARTITION BY user_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM nights),
  f AS (SELECT *, f::INTEGER AS fold, floor(n * 0.2) AS sz FROM o, range(3) g(f)),
  s AS (SELECT *, n - (3 - fold) * sz AS st FROM f)
  SELECT user_id, date, fold, CASE WHEN i < st THEN 'train' ELSE 'test' END AS part FROM s WHERE sz > 0 AND st > 0 AND i < st + sz""")(
    lambda t: MO.time_splits(D.daily_sleep(t.sleep).select(*K)))
query("calibrated_probabilities", "M5", """
  WITH f AS (
    SELECT user_id, coalesce(least(1.0, avg(((s > 0.5)::INTEGER = y)::INTEGER) FILTER (s > 0.8 OR s < 0.2) + 0.2), 1.0) AS factor FROM scored GROUP BY user_id)
  SELECT doc_id, round(factor, 6) AS factor, round(least(1.0, greatest(0.0, CASE WHEN s > 0.7 THEN 0.5 + (s - 0.5) * factor
         WHEN s < 0.3 THEN 0.5 - (0.5 - s) * factor ELSE s END)), 6) AS calibrated FROM scored JOIN f USING (user_id)""")(
    lambda t: SCORED(t).join(MO.calibration_factor(SCORED(t), "s", "y", ["user_id"]), "user_id").select(
        "doc_id", "factor", MO.calibrated(F.col("s"), F.col("factor")).alias("calibrated")))
query("record_outcomes", "A29", """
  SELECT source_name, count(*) AS records, count(*) FILTER (end_ts > start_ts AND value >= 0) AS accepted,
         count(*) FILTER (NOT (end_ts > start_ts AND value >= 0)) AS rejected FROM activity GROUP BY source_name""")(
    lambda t: t.activity.withColumn("ok", (F.col("end_ts") > F.col("start_ts")) & (F.col("value") >= 0)).groupBy("source_name").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected")))


RISK_INPUTS = ["sleep_hours", "efficiency", "fragmentation", "steps", "sedentary_hours"]
RISK_LABELS = {"depression": "low_mood", "hypomanic": "high_mood", "manic": "very_high_mood"}


def trained(t):
    """Three risks per night from questionnaire labels, each night scored by a model of earlier ones."""
    days = patient_days(t).select(
        *K, *RISK_INPUTS, (F.col("phq") >= 10).cast("int").alias("low_mood"),
        F.col("asrm").between(6, 10).cast("int").alias("high_mood"), (F.col("asrm") >= 11).cast("int").alias("very_high_mood"))
    flagged = days.join(MO.split_flags(days), K)
    models = MO.fit_risks(flagged, RISK_INPUTS, RISK_LABELS, scratch(t.spark))
    return MO.score_risks(flagged, models, list(RISK_LABELS))


query("trained_scores", "M8 M9")(trained)
