"""Rule-scoring queries over patient-days derived from nights, days and survey rows."""

from pyspark.sql import functions as F

from diurna.functions import exprs as E
from diurna.operators import cohort as CO
from diurna.operators import daily as D
from diurna.operators import modelling as MO
from diurna.operators import rolling as R
from diurna.operators import rules as X
from diurna.operators import thresholds as TH
from diurna.plans.nights import r
from diurna.plans.registry import query, view

K = ["user_id", "date"]

view("patient_days", """
  SELECT n.user_id, n.date, n.sleep_hours, n.efficiency, a.steps, a.sedentary_hours, n.fragmentation,
         ((q1+q2+q3+q4+q5+q6+q7+q8+q9 + (n.date - DATE '1970-01-01')) % 28)::INTEGER AS phq,
         ((q1+q2+q3 + (n.date - DATE '1970-01-01') * 5) % 21)::INTEGER AS asrm,
         q9 = 3 AND day(n.date) % 5 = 0 AS suicidal, q8 = 3 AND day(n.date) % 7 = 0 AS psychotic,
         q1 >= 2 AS racing_thoughts, q2 >= 2 AS anhedonia, q3 >= 2 AS increased_energy, q4 >= 2 AS decreased_sleep,
         q5 >= 2 AS depressed_mood, q6 >= 2 AS guilt, n.efficiency < 0.85 AS sleep_disturbance,
         q7 / 3.0 AS adherence, q7, q8
  FROM nights n LEFT JOIN act_days a USING (user_id, date) LEFT JOIN survey s ON s.user_id = n.user_id""")


def patient_days(t):
    n = D.daily_sleep(t.sleep).select(*K, "sleep_hours", "efficiency", "fragmentation")
    a = D.daily_activity(t.activity).select(*K, "steps", "sedentary_hours")
    day = F.unix_date("date")
    q = [F.col(f"q{i}") for i in range(1, 10)]
    total = sum(q[1:], q[0])
    j = n.join(a, K, "left").join(t.survey, "user_id", "left")
    return j.select(
        *K, "sleep_hours", "efficiency", "fragmentation", "steps", "sedentary_hours",
        ((total + day) % 28).alias("phq"), ((q[0] + q[1] + q[2] + day * 5) % 21).alias("asrm"),
        ((q[8] == 3) & (F.dayofmonth("date") % 5 == 0)).alias("suicidal"),
        ((q[7] == 3) & (F.dayofmonth("date") % 7 == 0)).alias("psychotic"),
        *[(F.col(f"q{i}") >= 2).alias(n) for i, n in enumerate(
            ["racing_thoughts", "anhedonia", "increased_energy", "decreased_sleep", "depressed_mood", "guilt"], 1)],
        (F.col("efficiency") < 0.85).alias("sleep_disturbance"), (q[6] / 3.0).alias("adherence"), "q7", "q8")


def text(df, *arrays):
    """Arrays of texts as one string, so both engines compare plain values."""
    return df.withColumns({a: F.concat_ws("; ", a) for a in arrays})


query("depression_risk_level", "R1", """
  WITH b AS (
    SELECT *, CASE WHEN phq < 9 THEN 'low' WHEN phq < 14 THEN 'moderate' WHEN phq < 27 THEN 'high' ELSE 'critical' END AS lv,
           CASE WHEN phq < 4 THEN 'Minimal depressive symptoms' WHEN phq < 9 THEN 'Mild depressive symptoms'
                WHEN phq < 14 THEN 'Moderate depression indicated' WHEN phq < 27 THEN 'Severe depression indicated'
                ELSE 'Very severe depression' END AS tx,
           CASE WHEN phq < 4 THEN NULL WHEN phq < 9 THEN 'mild PHQ-9 score' WHEN phq < 14 THEN 'moderate PHQ-9 score'
                WHEN phq < 27 THEN 'severe PHQ-9 score' ELSE 'very severe PHQ-9 score' END AS f,
           (CASE WHEN sleep_hours < 6 THEN 1.2::DOUBLE WHEN sleep_hours > 12 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END)
             * (CASE WHEN steps <= 2000 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) AS m
    FROM patient_days)
  SELECT user_id, date, CASE WHEN suicidal THEN 'critical' WHEN m > 1.3 AND lv = 'moderate' THEN 'high' ELSE lv END AS risk_level,
         concat_ws('; ', f, CASE WHEN sleep_hours < 6 THEN 'severe insomnia' WHEN sleep_hours > 12 THEN 'hypersomnia' END,
           CASE WHEN steps <= 2000 THEN 'severe hypoactivity' END, CASE WHEN suicidal THEN 'suicidal ideation' END) AS risk_factors,
         CASE WHEN steps IS NULL THEN 'activity data' ELSE '' END AS missing_factors, round(m, 6) AS biomarker_modifier,
         CASE WHEN steps IS NULL THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence,
         CASE WHEN suicidal THEN 'Suicidal ideation present - immediate intervention required'
              WHEN m > 1.3 AND lv = 'moderate' THEN tx || ' with severe biomarker severity' ELSE tx END
           || CASE WHEN steps IS NULL THEN ' (limited data: activity data missing)' ELSE '' END AS rationale FROM b""")(
    lambda t: text(X.depression_risk(patient_days(t)), "risk_factors", "missing_factors"))
query("depression_episode_reading", "R1 Q8", """
  WITH b AS (
    SELECT *, CASE WHEN phq <= 9 THEN CASE WHEN sleep_hours > 12 THEN 'moderate' ELSE 'low' END WHEN phq <= 14 THEN 'moderate'
              WHEN phq <= 19 THEN 'high' ELSE 'critical' END AS lv,
           CASE WHEN phq <= 4 THEN 'Depression screening within normal range.'
                WHEN phq <= 9 THEN 'Mild depressive symptoms below clinical threshold.'
                WHEN phq <= 14 THEN 'Moderate depression detected requiring clinical attention.'
                WHEN phq <= 19 THEN 'Moderately severe depression requiring prompt intervention.'
                ELSE 'Severe depression requiring immediate intervention.' END AS tx FROM patient_days)
  SELECT user_id, date, CASE WHEN suicidal THEN 'critical' ELSE lv END AS risk_level,
         CASE WHEN phq <= 9 THEN 'none' ELSE 'depressive' END AS episode_type, phq >= 10 AS criteria_met,
         tx || CASE WHEN sleep_hours > 12 THEN ' Hypersomnia pattern detected.' ELSE '' END
            || CASE WHEN steps < 2000 AND lv <> 'critical' THEN ' Severe activity reduction noted.' ELSE '' END
            || CASE WHEN suicidal THEN ' Suicidal ideation present - urgent assessment needed.' ELSE '' END AS summary FROM b""")(
    lambda t: X.depression_episode(patient_days(t)))
query("mania_risk_level", "R2", """
  SELECT user_id, date, CASE WHEN psychotic THEN 'critical' WHEN asrm < 5 THEN 'low' WHEN asrm < 10 THEN 'moderate'
         WHEN asrm < 15 THEN 'high' ELSE 'critical' END AS risk_level,
         concat_ws('; ', CASE WHEN asrm < 5 THEN NULL WHEN asrm < 10 THEN 'elevated ASRM score' WHEN asrm < 15
           THEN 'high ASRM score' ELSE 'very high ASRM score' END, CASE WHEN sleep_hours < 5 THEN 'reduced sleep' END,
           CASE WHEN steps >= 15000 THEN 'hyperactivity' END, CASE WHEN psychotic THEN 'psychotic features' END) AS risk_factors,
         CASE WHEN psychotic THEN 'Manic episode with psychotic features - immediate intervention required'
              WHEN asrm < 5 THEN 'No manic symptoms detected' WHEN asrm < 10 THEN 'Hypomanic symptoms present'
              WHEN asrm < 15 THEN 'Manic episode likely' ELSE 'Severe manic episode' END AS rationale,
         0.85::DOUBLE AS confidence FROM patient_days""")(lambda t: text(X.mania_risk(patient_days(t)), "risk_factors"))
MANIA_CASES = """CASE WHEN asrm <= 5 THEN 'Mania screening within normal range.'
      WHEN asrm <= 10 THEN 'Hypomanic symptoms detected requiring monitoring.'
      WHEN asrm <= 15 THEN 'Significant hypomanic symptoms requiring intervention.'
      ELSE 'Severe manic symptoms requiring immediate intervention.' END
      || CASE WHEN sleep_hours < 3 THEN ' Critical sleep reduction indicates mania.' ELSE '' END"""
query("mania_episode_reading", "R2", f"""
  WITH b AS (
    SELECT *, CASE WHEN psychotic OR sleep_hours < 3 THEN 'critical' WHEN asrm <= 5 THEN 'low' WHEN asrm <= 10 THEN 'moderate'
                   WHEN asrm <= 15 THEN 'high' ELSE 'critical' END AS lv FROM patient_days)
  SELECT user_id, date, CASE WHEN lv = 'moderate' AND steps > 20000 THEN 'high' ELSE lv END AS risk_level,
         CASE WHEN psychotic OR sleep_hours < 3 OR asrm > 15 THEN 'manic' WHEN asrm <= 5 THEN 'none' ELSE 'hypomanic' END AS episode_type,
         asrm >= 6 AS criteria_met,
         CASE WHEN psychotic THEN 'Manic episode with psychotic features - immediate hospitalization may be required.'
              ELSE {MANIA_CASES} END
           || CASE WHEN steps > 20000 THEN ' Significantly elevated activity level.' ELSE '' END AS summary FROM b""")(
    lambda t: X.mania_episode(patient_days(t)))
query("mixed_risk_level", "R3", """
  WITH b AS (
    SELECT *, sleep_disturbance::INTEGER + racing_thoughts::INTEGER + anhedonia::INTEGER + increased_energy::INTEGER AS n,
           phq >= 20 OR asrm >= 11 AS sev FROM patient_days)
  SELECT user_id, date, n AS mixed_features, greatest(phq, asrm)::DOUBLE AS severity_score,
         CASE WHEN sev THEN 'critical' WHEN n >= 2 THEN 'high' ELSE 'moderate' END AS risk_level,
         CASE WHEN phq > asrm * 1.5 THEN 'depressive' WHEN asrm > phq * 1.5 THEN 'manic' ELSE 'balanced' END AS dominant_pole,
         CASE WHEN sev THEN 'Severe mixed episode' WHEN n >= 3 THEN 'Mixed mood episode with multiple features'
              WHEN n >= 2 THEN 'Mixed features present' ELSE 'Possible mixed state' END AS rationale,
         concat_ws('; ', CASE WHEN sleep_disturbance THEN 'sleep disturbance' END, CASE WHEN racing_thoughts THEN 'racing thoughts' END,
           CASE WHEN anhedonia THEN 'anhedonia' END, CASE WHEN increased_energy THEN 'increased energy' END,
           CASE WHEN phq >= 10 AND asrm >= 6 THEN 'concurrent depression and mania symptoms' END) AS risk_factors FROM b""")(
    lambda t: text(X.mixed_risk(patient_days(t)), "risk_factors"))
query("mixed_episode_reading", "R3", f"""
  WITH b AS (
    SELECT *, racing_thoughts::INTEGER + increased_energy::INTEGER + (decreased_sleep OR sleep_hours < 6)::INTEGER AS up,
           depressed_mood::INTEGER + anhedonia::INTEGER + guilt::INTEGER AS dn FROM patient_days),
  k AS (
    SELECT *, CASE WHEN phq >= 10 AND up >= 3 THEN 1 WHEN asrm >= 6 AND dn >= 3 THEN 2 WHEN phq >= asrm THEN 3 ELSE 4 END AS k,
           CASE WHEN phq <= 9 THEN CASE WHEN sleep_hours > 12 THEN 'moderate' ELSE 'low' END WHEN phq <= 14 THEN 'moderate'
                WHEN phq <= 19 THEN 'high' ELSE 'critical' END AS ld,
           CASE WHEN sleep_hours < 3 THEN 'critical' WHEN asrm <= 5 THEN 'low' WHEN asrm <= 10 THEN
                CASE WHEN steps > 20000 THEN 'high' ELSE 'moderate' END WHEN asrm <= 15 THEN 'high' ELSE 'critical' END AS lm FROM b)
  SELECT user_id, date, CASE k WHEN 1 THEN 'high' WHEN 2 THEN 'high' WHEN 3 THEN ld ELSE lm END AS risk_level,
         CASE k WHEN 1 THEN 'depressive_with_mixed_features' WHEN 2 THEN 'manic_with_mixed_features'
                WHEN 3 THEN CASE WHEN phq <= 9 THEN 'none' ELSE 'depressive' END
                ELSE CASE WHEN sleep_hours < 3 OR asrm > 15 THEN 'manic' WHEN asrm <= 5 THEN 'none' ELSE 'hypomanic' END END AS episode_type,
         CASE WHEN k <= 2 THEN TRUE WHEN k = 3 THEN phq >= 10 ELSE asrm >= 6 END AS criteria_met,
         CASE k WHEN 1 THEN 'Major depressive episode with mixed features detected.'
                WHEN 2 THEN 'Manic episode with mixed features detected.'
                WHEN 3 THEN CASE WHEN phq <= 4 THEN 'Depression screening within normal range.'
                  WHEN phq <= 9 THEN 'Mild depressive symptoms below clinical threshold.'
                  WHEN phq <= 14 THEN 'Moderate depression detected requiring clinical attention.'
                  WHEN phq <= 19 THEN 'Moderately severe depression requiring prompt intervention.'
                  ELSE 'Severe depression requiring immediate intervention.' END
                  || CASE WHEN sleep_hours > 12 THEN ' Hypersomnia pattern detected.' ELSE '' END
                  || CASE WHEN steps < 2000 AND ld <> 'critical' THEN ' Severe activity reduction noted.' ELSE '' END
                ELSE {MANIA_CASES} || CASE WHEN steps > 20000 THEN ' Significantly elevated activity level.' ELSE '' END END AS summary
  FROM k""")(lambda t: X.mixed_episode(patient_days(t)))
query("composite_risk", "R4", """
  WITH b AS (
    SELECT *, CASE WHEN phq < 9 THEN 0 WHEN phq < 14 THEN 1 WHEN phq < 27 THEN 2 ELSE 3 END AS a,
           CASE WHEN asrm < 5 THEN 0 WHEN asrm < 10 THEN 1 WHEN asrm < 15 THEN 2 ELSE 3 END AS m FROM patient_days),
  n AS (SELECT *, ['low', 'moderate', 'high', 'critical'] AS names, greatest(a, m) AS top FROM b)
  SELECT user_id, date, names[a + 1] AS depression_level, names[m + 1] AS mania_level,
         CASE WHEN top = 1 AND adherence < 0.7 THEN 'high' ELSE names[top + 1] END AS overall_level,
         CASE WHEN top = 0 THEN 'none' WHEN m > a THEN 'mania' ELSE 'depression' END AS primary_concern FROM n""")(
    lambda t: X.composite_risk(patient_days(t)))

BIO = lambda t: patient_days(t).select(
    "*", (F.col("q7") * 1.0).alias("timing_variance"), (F.col("q8") * 1.0).alias("phase_advance"),
    F.col("efficiency").alias("interdaily_stability"), (F.col("fragmentation") * 3).alias("intradaily_variability"))
query("biomarker_factors", "R5", """
  WITH b AS (
    SELECT *, (sleep_hours < 3)::INTEGER + (efficiency < 0.85)::INTEGER + (q7 > 2)::INTEGER AS s,
           coalesce((steps > 15000)::INTEGER + (steps > 20000)::INTEGER + (sedentary_hours < 4)::INTEGER, 0) AS a,
           (q8 > 2)::INTEGER AS ci, coalesce((steps < 2000)::INTEGER, 0) AS dn FROM patient_days)
  SELECT user_id, date, s AS sleep_factors, a AS activity_factors, ci AS circadian_factors, s + a + ci AS mania_factors,
         dn AS depression_factors, CASE WHEN efficiency < 0.5 OR fragmentation * 3 > 1 THEN 'high' ELSE 'low' END AS instability,
         CASE WHEN sleep_hours < 3 THEN 'urgent' ELSE 'routine' END AS priority,
         concat_ws('; ', CASE WHEN sleep_hours < 3 THEN 'Critical short sleep duration indicates mania risk' END,
           CASE WHEN efficiency < 0.85 THEN 'Poor sleep efficiency' END, CASE WHEN q7 > 2 THEN 'Highly variable sleep schedule' END,
           CASE WHEN steps > 15000 THEN 'Significantly elevated activity level' END,
           CASE WHEN steps > 20000 THEN 'Extreme activity elevation' END, CASE WHEN sedentary_hours < 4 THEN 'Minimal rest periods' END,
           CASE WHEN steps < 2000 THEN 'Severe activity reduction' END, CASE WHEN q8 > 2 THEN 'Significant circadian phase advance' END,
           CASE WHEN efficiency < 0.5 THEN 'Low circadian rhythm stability' END,
           CASE WHEN fragmentation * 3 > 1 THEN 'High circadian fragmentation' END) AS notes,
         CASE WHEN s + a + ci > 0 OR dn > 0 THEN 'Digital biomarkers indicate ' || (s + a + ci) || ' mania risk factors and '
              || dn || ' depression risk factors' ELSE '' END AS summary FROM b""")(
    lambda t: text(X.biomarkers(BIO(t)), "notes"))

CRIT = lambda t: t.episodes.select(
    "rec_id", F.when(F.col("episode_type") == "mixed", F.when(F.col("severity") >= 3, "depressive_mixed").otherwise("manic_mixed"))
    .otherwise(F.col("episode_type")).alias("episode_type"),
    (F.datediff("end_date", "start_date") + 1).alias("symptom_days"), (F.col("rec_id") % 8).cast("int").alias("symptoms"),
    (F.col("rec_id") % 9 == 0).alias("hospitalized"), (F.col("rec_id") % 3 == 0).alias("work"),
    (F.col("rec_id") % 5 == 0).alias("social"), (F.col("rec_id") % 7 == 0).alias("self_care"))
query("diagnostic_criteria", "R6", """
  WITH e AS (
    SELECT rec_id, CASE WHEN episode_type <> 'mixed' THEN episode_type WHEN severity >= 3 THEN 'depressive_mixed'
           ELSE 'manic_mixed' END AS k, end_date - start_date + 1 AS d, rec_id % 8 AS sy, rec_id % 9 = 0 AS h FROM episodes),
  q AS (
    SELECT *, CASE WHEN k IN ('manic', 'manic_mixed') THEN 7 WHEN k = 'hypomanic' THEN 4 ELSE 14 END AS need,
           CASE WHEN k LIKE 'depressive%' THEN 5 ELSE 3 END AS want,
           concat_ws('; ', CASE WHEN rec_id % 3 = 0 THEN 'work/occupational' END, CASE WHEN rec_id % 5 = 0 THEN 'social/interpersonal' END,
             CASE WHEN rec_id % 7 = 0 THEN 'self-care' END, CASE WHEN h THEN 'hospitalization required' END) AS domains FROM e),
  m AS (SELECT *, CASE WHEN k IN ('manic', 'manic_mixed') THEN d >= need OR h WHEN k = 'hypomanic' THEN d >= need AND NOT h
                       ELSE d >= need END AS met FROM q)
  SELECT rec_id, need AS required_days, met AS duration_met,
         CASE WHEN met THEN 'Episode duration of ' || d || ' days meets DSM-5 criteria'
                || CASE WHEN h AND k = 'manic' THEN ' (hospitalization overrides duration requirement)' ELSE '' END
              WHEN h AND k = 'hypomanic' THEN 'Hospitalization invalidates hypomanic episode (would be manic)'
              ELSE 'Duration insufficient for ' || k || ' episode (' || d || ' days < ' || need || ' days required)' END AS duration_note,
         want AS required_symptoms, sy >= want AS symptoms_met, domains, domains <> '' AS impairment_met,
         met AND sy >= want AND domains <> '' AS all_met,
         CASE WHEN met AND sy >= want AND domains <> '' THEN 'Meets' ELSE 'Does not meet' END || ' DSM-5 criteria for ' || k
           || ' episode' AS summary FROM m""")(lambda t: text(X.criteria(CRIT(t)), "domains"))

query("criteria_notes", "R6", """
  WITH e AS (
    SELECT rec_id, rec_id % 8 AS sy, CASE WHEN episode_type = 'depressive' OR (episode_type = 'mixed' AND severity >= 3) THEN 5 ELSE 3 END AS want,
           concat_ws(', ', CASE WHEN rec_id % 3 = 0 THEN 'work/occupational' END, CASE WHEN rec_id % 5 = 0 THEN 'social/interpersonal' END,
             CASE WHEN rec_id % 7 = 0 THEN 'self-care' END, CASE WHEN rec_id % 9 = 0 THEN 'hospitalization required' END) AS domains FROM episodes)
  SELECT rec_id, CASE WHEN sy >= want THEN sy || ' symptoms meets minimum requirement of ' || want
                      ELSE 'Insufficient symptoms: ' || sy || ' < ' || want || ' required' END AS symptom_note,
         CASE WHEN domains <> '' THEN 'Significant impairment in: ' || domains ELSE 'No significant functional impairment documented' END
           AS impairment_note FROM e""")(lambda t: X.criteria_notes(CRIT(t)))
view("change_days", """
  WITH n AS (
    SELECT user_id, date, sleep_hours, mid_sleep_minute, avg(sleep_hours) OVER w AS ms, avg(mid_sleep_minute) OVER w AS mm,
           date - row_number() OVER (PARTITION BY user_id ORDER BY date)::INTEGER AS g FROM nights
    WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING)),
  a AS (
    SELECT user_id, date, steps, avg(steps) OVER (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS ma FROM act_days)
  SELECT n.user_id, n.date, round(sleep_hours - ms, 9) AS sleep_change,
         round(coalesce(CASE WHEN ma > 0 THEN (steps - ma) / ma * 100 END, 0.0), 9) AS activity_change,
         round((mid_sleep_minute - mm) / 60, 9) AS circadian_shift,
         row_number() OVER (PARTITION BY n.user_id, g ORDER BY n.date)::INTEGER AS consecutive_days,
         q1 = 3 AND day(n.date) % 3 = 0 AS fast_speech, q2 AS previous_episodes,
         CASE q3 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'high' ELSE 'critical' END AS risk_level
  FROM n LEFT JOIN a ON a.user_id = n.user_id AND a.date = n.date JOIN survey s ON s.user_id = n.user_id""")


def change_days(t):
    nights = D.daily_sleep(t.sleep)
    acts = D.daily_activity(t.activity)
    sleep = R.incremental_baseline(nights, "sleep_hours").select(*K, F.col("mean").alias("ms"))
    mid = R.incremental_baseline(nights, "mid_sleep_minute").select(*K, F.col("mean").alias("mm"))
    act = R.incremental_baseline(acts, "steps").select(*K, F.col("y").alias("steps"), F.col("mean").alias("ma"))
    run = F.date_sub("date", F.row_number().over(R.in_order()))
    base = nights.select(*K, "sleep_hours", "mid_sleep_minute", run.alias("run"))
    j = base.join(sleep, K).join(mid, K).join(act, K, "left").join(t.survey.select("user_id", "q1", "q2", "q3"), "user_id")
    from pyspark.sql import Window as W
    change = F.when(F.col("ma") > 0, (F.col("steps") - F.col("ma")) / F.col("ma") * 100)
    return j.select(
        *K, F.round(F.col("sleep_hours") - F.col("ms"), 9).alias("sleep_change"),
        F.round(F.coalesce(change, F.lit(0.0)), 9).alias("activity_change"),
        F.round((F.col("mid_sleep_minute") - F.col("mm")) / 60, 9).alias("circadian_shift"),
        F.row_number().over(W.partitionBy("user_id", "run").orderBy("date")).alias("consecutive_days"),
        ((F.col("q1") == 3) & (F.dayofmonth("date") % 3 == 0)).alias("fast_speech"), F.col("q2").alias("previous_episodes"),
        E.ladder((F.col("q3") == 0, "low"), (F.col("q3") == 1, "moderate"), (F.col("q3") == 2, "high"), otherwise="critical")
        .alias("risk_level"))


def warn_sql(sf: float | str, af: float | str) -> str:
    return f"""
  WITH x AS (SELECT *, sleep_change * {sf} AS s, activity_change * {af} AS a, consecutive_days AS run FROM change_days),
  n AS (
    SELECT *, (s > 2)::INTEGER + (a <= -30)::INTEGER + (circadian_shift > 1)::INTEGER AS dn,
           (s < -2)::INTEGER + (a > 50)::INTEGER + fast_speech::INTEGER AS up FROM x),
  w AS (
    SELECT user_id, date, sleep_change, risk_level, previous_episodes, consecutive_days, dn > 0 AS depression_warning, up > 0 AS mania_warning,
           dn + up >= 3 AND run >= 3 AS trigger_intervention,
           concat_ws('; ', CASE WHEN s > 2 THEN 'Significant sleep increase' END, CASE WHEN a <= -30 THEN 'Major activity reduction' END,
             CASE WHEN circadian_shift > 1 THEN 'Circadian phase delay' END, CASE WHEN s < -2 THEN 'Significant sleep reduction' END,
             CASE WHEN a > 50 THEN 'Major activity increase' END, CASE WHEN fast_speech THEN 'Increased speech rate' END) AS signs,
           dn + up AS sign_count, CASE WHEN dn + up >= 3 AND run >= 3 THEN 'high' WHEN dn + up >= 2 AND run >= 2 THEN 'moderate'
             WHEN dn + up >= 1 THEN 'low' ELSE 'none' END AS urgency, least(1.0, (dn + up) / 4.0)::DOUBLE AS severity,
           CASE WHEN run >= 3 THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence FROM n)"""


WARN = ["user_id", "date", "depression_warning", "mania_warning", "trigger_intervention", "signs", "sign_count", "urgency",
        "severity", "confidence"]
query("early_warnings", "R7", warn_sql(1, 1) + f"SELECT {', '.join(WARN)} FROM w")(
    lambda t: text(X.early_warnings(change_days(t)), "signs").select(*WARN))
query("early_warnings_personalized", "R7", warn_sql(1.5, 0.5) + f"SELECT {', '.join(WARN)} FROM w")(
    lambda t: text(X.early_warnings(change_days(t), 1.5, 0.5), "signs").select(*WARN))

# ---- thresholds from a parameter table --------------------------------------------------

def parameters(t):
    """Values for everyone, for a cohort and, from the questionnaires, for single users."""
    rows = t.spark.createDataFrame(
        [(None, None, "hypersomnia_hours", 11.0), (None, "b", "phq_mild_max", 11.0), (None, "b", "phq_moderate_max", 16.0),
         (None, "b", "normal_sleep_min", 5.5), (None, "b", "asrm_none_max", 3.0), (None, "b", "asrm_hypomanic_max", 8.0),
         (None, "b", "hypersomnia_hours", 10.0), (None, "b", "no_such_name", 1.0), (None, "b", "elevated_steps", -1.0)], TH.PARAMETERS)
    own = t.survey.filter("user_id % 5 = 0").select(
        "user_id", F.lit(None).cast("string").alias("cohort"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in (
            ("severe_low_steps", F.lit(3000)), ("sleep_sensitivity", 1 + F.col("q1") / 4), ("activity_sensitivity", 0.5 + F.col("q2") / 4))])))
    return rows.unionByName(own)


def limited(t, df):
    members = t.survey.select("user_id", F.when(F.col("user_id") % 2 == 1, "b").otherwise("a").alias("cohort"))
    return TH.attach(df, parameters(t), members)


view("limits", """
  SELECT d.*, CASE WHEN s.user_id % 2 = 1 THEN 11 ELSE 9 END AS l_mild, CASE WHEN s.user_id % 2 = 1 THEN 16 ELSE 14 END AS l_moderate,
         CASE WHEN s.user_id % 2 = 1 THEN 5.5 ELSE 6 END AS l_short, CASE WHEN s.user_id % 2 = 1 THEN 10 ELSE 11 END AS l_long,
         CASE WHEN s.user_id % 2 = 1 THEN 3 ELSE 5 END AS l_calm, CASE WHEN s.user_id % 2 = 1 THEN 8 ELSE 10 END AS l_hypomanic,
         CASE WHEN s.user_id % 5 = 0 THEN 3000 ELSE 2000 END AS l_still
  FROM patient_days d LEFT JOIN survey s ON s.user_id = d.user_id""")
query("depression_risk_by_parameters", "R1", """
  WITH b AS (
    SELECT *, CASE WHEN phq < l_mild THEN 'low' WHEN phq < l_moderate THEN 'moderate' WHEN phq < 27 THEN 'high' ELSE 'critical' END AS lv,
           (CASE WHEN sleep_hours < l_short THEN 1.2::DOUBLE WHEN sleep_hours > l_long THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END)
             * (CASE WHEN steps <= l_still THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) AS m FROM limits)
  SELECT user_id, date, CASE WHEN suicidal THEN 'critical' WHEN m > 1.3 AND lv = 'moderate' THEN 'high' ELSE lv END AS risk_level,
         round(m, 6) AS biomarker_modifier FROM b""")(
    lambda t: X.depression_risk(limited(t, patient_days(t))).select(*K, "risk_level", "biomarker_modifier"))
query("mania_risk_by_parameters", "R2", """
  SELECT user_id, date, CASE WHEN psychotic THEN 'critical' WHEN asrm < l_calm THEN 'low' WHEN asrm < l_hypomanic THEN 'moderate'
         WHEN asrm < 15 THEN 'high' ELSE 'critical' END AS risk_level FROM limits""")(
    lambda t: X.mania_risk(limited(t, patient_days(t))).select(*K, "risk_level"))
query("composite_risk_by_parameters", "R4", """
  WITH b AS (
    SELECT *, CASE WHEN phq < l_mild THEN 0 WHEN phq < l_moderate THEN 1 WHEN phq < 27 THEN 2 ELSE 3 END AS d,
           CASE WHEN asrm < l_calm THEN 0 WHEN asrm < l_hypomanic THEN 1 WHEN asrm < 15 THEN 2 ELSE 3 END AS m FROM limits),
  k AS (SELECT *, ['low', 'moderate', 'high', 'critical'] AS names FROM b)
  SELECT user_id, date, names[d + 1] AS depression_level, names[m + 1] AS mania_level,
         CASE WHEN adherence < 0.7 AND greatest(d, m) = 1 THEN 'high' ELSE names[greatest(d, m) + 1] END AS overall_level,
         CASE WHEN d = 0 AND m = 0 THEN 'none' WHEN m > d THEN 'mania' ELSE 'depression' END AS primary_concern FROM k""")(
    lambda t: X.composite_risk(limited(t, patient_days(t))))
query("parameter_checks", "R4", """
  SELECT NULL::BIGINT AS user_id, 'b' AS cohort, 'no_such_name' AS name, 1.0::DOUBLE AS value, 'unknown name' AS reason
  UNION ALL SELECT NULL, 'b', 'elevated_steps', -1.0, 'negative value'
  UNION ALL SELECT user_id, NULL, 'severe_low_steps', 3000.0, NULL FROM survey WHERE user_id % 5 = 0""")(
    lambda t: TH.checked(parameters(t)).filter("reason IS NOT NULL OR name = 'severe_low_steps'"))
SUMMARY = """
  SELECT user_id, date, sign_count, urgency,
         CASE WHEN sign_count = 0 THEN 'No significant warning signs ' || f
              WHEN depression_warning AND mania_warning THEN 'Mixed warning signs ' || f || ' - both depression and mania indicators present'
              WHEN depression_warning THEN 'Depression warning signs ' || f || ': ' || replace(signs, '; ', ', ')
              ELSE 'Mania warning signs ' || f || ': ' || replace(signs, '; ', ', ') END
           || CASE WHEN trigger_intervention THEN '. Immediate clinical intervention recommended'
                   WHEN consecutive_days < 3 AND sign_count > 0 THEN '. Continued monitoring required' ELSE '' END AS summary
  FROM (SELECT *, {found} AS f FROM w)"""
SUMMARIZED = [*K, "sign_count", "urgency", "summary"]
query("early_warning_summary", "R7", warn_sql(1, 1) + SUMMARY.format(found="'detected'"))(
    lambda t: X.warning_summary(X.early_warnings(change_days(t))).select(*SUMMARIZED))
PERSONAL = "CASE WHEN user_id % 5 = 0 AND sign_count > 0 AND user_id IN (SELECT user_id FROM survey) THEN 'detected (using personalized thresholds)' ELSE 'detected' END"
query("early_warning_per_user", "R7", warn_sql(
    "coalesce((SELECT 1 + q1 / 4 FROM survey y WHERE y.user_id = change_days.user_id AND y.user_id % 5 = 0), 1)",
    "coalesce((SELECT 0.5 + q2 / 4 FROM survey y WHERE y.user_id = change_days.user_id AND y.user_id % 5 = 0), 1)") + SUMMARY.format(found=PERSONAL))(
    lambda t: X.warning_summary(X.early_warnings(limited(t, change_days(t)))).select(*SUMMARIZED))
query("intervention_decision", "R8", warn_sql(1, 1) + """,
  i AS (
    SELECT *, urgency IN ('moderate', 'high') OR previous_episodes >= 2 AS yes, abs(sleep_change) AS sh FROM w),
  k AS (
    SELECT *, CASE WHEN NOT yes THEN 'monitoring' WHEN risk_level = 'low' THEN 'preventive'
                   WHEN risk_level IN ('moderate', 'high') THEN 'acute' ELSE 'maintenance' END AS kind,
           CASE WHEN risk_level = 'critical' OR sh > 4 THEN 'emergency' WHEN risk_level = 'high' OR sh > 2 THEN 'high'
                WHEN risk_level = 'moderate' THEN 'moderate' ELSE 'low' END AS soon FROM i)
  SELECT user_id, date, yes AS recommend, kind AS intervention_type, soon AS urgency,
         'Intervention recommended due to: ' || concat_ws(', ', CASE WHEN sh > 2 THEN 'significant sleep disruption' END,
           CASE WHEN previous_episodes >= 2 THEN 'history of multiple episodes' END,
           CASE WHEN urgency IN ('moderate', 'high') THEN urgency || ' early warning signs' END) AS rationale,
         concat_ws('; ', CASE WHEN soon = 'emergency' THEN 'Immediate psychiatric evaluation required' END,
           CASE kind WHEN 'preventive' THEN 'Increase monitoring frequency; Review and optimize sleep hygiene; Consider prophylactic medication adjustment'
                WHEN 'acute' THEN 'Schedule urgent clinical evaluation; Initiate acute treatment protocol; Daily symptom monitoring' END) AS actions
  FROM k""")(lambda t: text(X.interventions(X.early_warnings(change_days(t))), "actions"))

ASSESS = lambda t: patient_days(t).select(
    "*", (F.col("q7") * 7).alias("symptom_days"), F.col("q8").alias("comorbidities"), (F.col("q8") == 2).alias("substance_use"),
    F.col("guilt").alias("mixed_features"), (F.col("q7") >= 1).alias("impaired"))
query("clinical_assessment", "R9", """
  WITH b AS (
    SELECT *, CASE WHEN phq >= 10 AND asrm < 6 THEN 'depressive_episode' WHEN asrm >= 14 AND phq < 10 THEN 'manic_episode'
                   WHEN asrm >= 6 AND phq < 10 THEN 'hypomanic_episode' WHEN phq >= 10 THEN 'mixed_episode' ELSE 'euthymic' END AS dx,
           CASE WHEN suicidal OR psychotic THEN 'critical' WHEN phq >= 15 OR asrm >= 14 THEN 'high'
                WHEN phq >= 10 OR asrm >= 6 THEN 'moderate' ELSE 'low' END AS lv FROM patient_days),
  m AS (
    SELECT *, q7 >= 1 AND CASE dx WHEN 'depressive_episode' THEN q7 * 7 >= 14 WHEN 'manic_episode' THEN q7 * 7 >= 7
              WHEN 'hypomanic_episode' THEN q7 * 7 >= 4 WHEN 'mixed_episode' THEN q7 * 7 >= 7 ELSE FALSE END AS met FROM b)
  SELECT user_id, date, dx AS diagnosis, lv AS risk_level, met AS criteria_met,
         round(least(0.5 + (3 + (steps IS NOT NULL)::INTEGER) * 0.1, 0.95), 6)::DOUBLE AS confidence,
         ((q8 > 0)::INTEGER + (q8 = 2)::INTEGER + psychotic::INTEGER + guilt::INTEGER) / 4.0::DOUBLE AS complexity,
         CASE WHEN steps IS NULL THEN 0.75 ELSE 1.0 END::DOUBLE AS completeness, lv = 'critical' AS immediate, '' AS limitations,
         'Patient presents with ' || replace(dx, '_', ' ') || ' with ' || lv || ' risk level. Clinical presentation '
           || CASE WHEN met THEN 'meets' ELSE 'does not meet' END || ' DSM-5 criteria.' AS summary FROM m""")(
    lambda t: text(X.assessment(ASSESS(t)), "limitations"))
query("clinical_summary_text", "R11", """
  SELECT user_id, date, 'Clinical assessment indicates ' || CASE WHEN suicidal THEN 'critical' WHEN phq <= 9
           THEN CASE WHEN sleep_hours > 12 THEN 'moderate' ELSE 'low' END
           WHEN phq <= 14 THEN 'moderate' WHEN phq <= 19 THEN 'high' ELSE 'critical' END || ' risk'
         || CASE WHEN phq > 9 THEN '. for major depressive episode' ELSE '' END
         || CASE WHEN phq >= 10 THEN '. meeting DSM-5 criteria' ELSE '' END || '. (confidence: 85%). PHQ score: ' || phq || '.' AS summary
  FROM patient_days""")(
    lambda t: X.clinical_summary(X.depression_episode(patient_days(t)).join(patient_days(t).select(*K, "phq"), K)
                                 .withColumn("confidence", F.lit(0.85))))

view("stat_preds", """
  WITH p AS (
    SELECT user_id, date, ((user_id * 37 + (date - DATE '2024-01-01') * 11) % 101) / 100 AS depression,
           ((user_id * 53 + (date - DATE '2024-01-01') * 7) % 101) / 100 AS hypomanic,
           ((user_id * 29 + (date - DATE '2024-01-01') * 13) % 101) / 100 AS manic FROM nights WHERE date >= DATE '2024-01-01')
  SELECT *, abs(greatest(depression, hypomanic, manic) - 0.5) * 2 AS confidence FROM p""")
view("seq_preds", """
  WITH p AS (
    SELECT user_id, date, ((user_id * 17 + (date - DATE '2024-01-01') * 23) % 101) / 100 AS depression,
           ((user_id * 19 + (date - DATE '2024-01-01') * 31) % 101) / 100 AS hypomanic,
           ((user_id * 43 + (date - DATE '2024-01-01') * 3) % 101) / 100 AS manic FROM act_days)
  SELECT *, abs(greatest(depression, hypomanic, manic) - 0.5) * 2 AS confidence FROM p""")


def predictions(days, factors):
    """Stand-in scores for test rows: fixed arithmetic on user and date."""
    day = F.datediff("date", F.lit("2024-01-01").cast("date"))
    p = days.filter("date >= DATE '2024-01-01'").select(*K, *[
        (F.pmod(F.col("user_id") * a + day * b, F.lit(101)) / 100).alias(n) for n, (a, b) in factors.items()])
    return p.withColumn("confidence", MO.confidence(*[F.col(n) for n in factors]))


STAT = lambda t: predictions(D.daily_sleep(t.sleep).select(*K), {
    "depression": (37, 11), "hypomanic": (53, 7), "manic": (29, 13)})
SEQ = lambda t: predictions(D.deduped_steps(t.activity).select(*K).unionByName(
    t.activity.select("user_id", F.to_date("start_ts").alias("date"))).distinct(), {
    "depression": (17, 23), "hypomanic": (19, 31), "manic": (43, 3)})
query("prediction_interpretation", "R10", """
  WITH b AS (
    SELECT *, greatest(depression, manic, hypomanic) AS top, list_reverse_sort([depression, manic, hypomanic]) AS s,
           depression > 0.5 AND (manic > 0.3 OR hypomanic > 0.3) AS mx FROM stat_preds),
  d AS (
    SELECT *, CASE WHEN mx THEN 'Mixed Episode' WHEN top < 0.2 THEN 'Euthymic (Stable)' WHEN depression = top THEN
        CASE WHEN top >= 0.8 THEN 'Severe Depressive Episode' WHEN top >= 0.6 THEN 'Moderate Depressive Episode'
             WHEN top >= 0.4 THEN 'Mild Depressive Episode' ELSE 'Subclinical Depression' END
      WHEN manic = top THEN CASE WHEN top >= 0.8 THEN 'Manic Episode' WHEN top >= 0.6 THEN 'Hypomanic Episode with Manic Features'
             ELSE 'Subclinical Mania' END
      ELSE CASE WHEN top >= 0.6 THEN 'Hypomanic Episode' WHEN top >= 0.4 THEN 'Mild Hypomanic Episode' ELSE 'Subclinical Hypomania' END
      END AS diagnosis FROM b),
  l AS (
    SELECT *, CASE WHEN mx THEN 'critical' WHEN diagnosis IN ('Severe Depressive Episode', 'Manic Episode',
             'Hypomanic Episode with Manic Features') THEN 'high' WHEN diagnosis IN ('Moderate Depressive Episode',
             'Mild Depressive Episode', 'Subclinical Mania', 'Hypomanic Episode') THEN 'moderate' ELSE 'low' END AS risk_level FROM d)
  SELECT user_id, date, depression, hypomanic, manic, diagnosis, risk_level,
         CASE WHEN s[1] > 0.7 AND s[2] < 0.3 THEN 0.9 WHEN s[1] > 0.6 AND s[2] < 0.4 THEN 0.8 WHEN s[1] > 0.5 THEN 0.7
              WHEN s[1] < 0.2 AND round(s[1] - s[3], 9) < 0.1 THEN 0.8 WHEN round(s[1] - s[2], 9) < 0.1 THEN 0.5
              ELSE 0.6 END::DOUBLE AS confidence,
         CASE WHEN risk_level IN ('critical', 'high') THEN 'daily' WHEN risk_level = 'moderate' THEN 'weekly' ELSE 'monthly' END AS monitoring,
         round(least(1.0, least(depression, greatest(manic, hypomanic)) * 2), 6) AS mixed_risk,
         CASE WHEN round(abs(depression - manic), 9) < 0.3 AND greatest(depression, manic) > 0.5 THEN 0.7 ELSE 0.2 END::DOUBLE AS cycling_risk,
         round(CASE WHEN manic > 0.7 THEN manic * 0.7 ELSE 0.0 END, 6) AS psychosis_risk,
         round(CASE WHEN depression > 0.6 THEN depression * 0.8 ELSE depression * 0.3 END, 6) AS suicide_risk FROM l""")(
    lambda t: X.interpretation(STAT(t)))
query("prediction_notes", "R11", """
  WITH b AS (
    SELECT *, greatest(depression, manic, hypomanic) AS top, depression > 0.5 AND (manic > 0.3 OR hypomanic > 0.3) AS mx,
           manic > 0.3 OR hypomanic > 0.3 AS up FROM stat_preds),
  d AS (
    SELECT *, CASE WHEN mx THEN 'mixed' WHEN top < 0.2 THEN 'calm' WHEN depression = top THEN
             CASE WHEN top >= 0.8 THEN 'sevdep' WHEN top >= 0.6 THEN 'moddep' WHEN top >= 0.4 THEN 'milddep' ELSE 'subdep' END
           WHEN manic = top THEN CASE WHEN top >= 0.8 THEN 'manic' WHEN top >= 0.6 THEN 'hypmanic' ELSE 'submania' END
           ELSE CASE WHEN top >= 0.6 THEN 'hypo' WHEN top >= 0.4 THEN 'mildhypo' ELSE 'subhypo' END END AS g FROM b)
  SELECT user_id, date, concat_ws('; ',
      CASE WHEN g = 'mixed' THEN 'Mixed mood episode detected - simultaneous depressive and manic symptoms; High risk state requiring immediate intervention; Meets DSM-5 criteria for mixed features specifier' END,
      CASE WHEN g = 'calm' THEN 'Patient shows stable mood indicators; All mood scores within normal range' END,
      CASE WHEN g LIKE '%dep' THEN printf('Patient shows strong indicators of depression (score: %.2f)', depression) END,
      CASE WHEN g LIKE '%dep' AND depression > 0.8 THEN 'Severity level suggests significant functional impairment' END,
      CASE WHEN g LIKE '%dep' AND depression > 0.7 THEN 'Meets DSM-5 criteria for major depressive episode' END,
      CASE WHEN g IN ('manic', 'hypmanic') THEN printf('Patient exhibits manic symptoms (score: %.2f)', manic) END,
      CASE WHEN g IN ('manic', 'hypmanic') AND manic > 0.7 THEN 'High risk of impulsive behavior and poor judgment; Consistent with DSM-5 criteria for manic episode' END,
      CASE WHEN g IN ('hypo', 'mildhypo') THEN printf('Patient shows hypomania symptoms (score: %.2f)', hypomanic) END,
      CASE WHEN g IN ('hypo', 'mildhypo') THEN 'Monitor for potential escalation to mania' END,
      CASE WHEN g IN ('hypo', 'mildhypo') AND hypomanic > 0.6 THEN 'Meets DSM-5 criteria for hypomanic episode' END,
      CASE WHEN g NOT IN ('mixed', 'calm', 'subdep') AND depression > 0.3 THEN printf('Secondary depression risk detected (%.2f)', depression) END,
      CASE WHEN g NOT IN ('mixed', 'calm', 'manic', 'hypmanic') AND up THEN 'Elevated mood symptoms present as secondary feature' END) AS notes,
    CASE WHEN g = 'mixed' THEN 'Emergency psychiatric evaluation required; Crisis intervention team consultation; Consider immediate hospitalization'
      WHEN g IN ('sevdep', 'manic', 'hypmanic') THEN 'Urgent psychiatric evaluation recommended; Consider immediate safety assessment'
        || CASE WHEN g IN ('manic', 'hypmanic') THEN '; Evaluate need for mood stabilizers; Monitor for psychotic features; Consider emergency department evaluation' ELSE '' END
      WHEN g IN ('moddep', 'milddep', 'submania', 'hypo') THEN 'Schedule psychiatric follow-up within 1-2 weeks; Monitor symptom progression daily'
        || CASE WHEN g = 'hypo' THEN '; Maintain regular sleep schedule; Avoid stimulants and alcohol' ELSE '' END
      ELSE 'Continue current monitoring schedule; Maintain healthy lifestyle habits' END
    || '; Ensure medication adherence if prescribed; Track mood changes using daily logs' AS recommendations
  FROM d""")(lambda t: X.notes_and_advice(X.interpretation(STAT(t))))

# ---- treatments -----------------------------------------------------------------------
PATIENTS = lambda t: t.survey.select(
    "user_id", E.ladder(*[(F.col("user_id") % 5 == i, n) for i, n in enumerate(
        ["depressive", "manic", "hypomanic", "depressive_with_mixed_features"])], otherwise="manic_with_mixed_features").alias("episode_type"),
    E.ladder((F.col("q1") == 0, "low"), (F.col("q1") == 1, "moderate"), (F.col("q1") == 2, "high"), otherwise="critical").alias("risk_level"),
    (F.col("q2") == 3).alias("rapid_cycling"))
TAKEN = lambda t: t.survey.select("user_id", E.ladder(
    (F.col("q7") == 0, "Lithium"), (F.col("q7") == 1, "quetiapine"), (F.col("q7") == 2, "Lamotrigine"), otherwise=F.lit(None))
    .alias("treatment")).filter("treatment IS NOT NULL")
BARRED = lambda t: t.survey.select("user_id", E.ladder(
    (F.col("q8") == 0, "valproate"), (F.col("q8") == 1, "Lurasidone"), otherwise=F.lit(None)).alias("treatment")).filter(
    "treatment IS NOT NULL")
view("candidates", """
  SELECT s.user_id, r.rank, r.treatment, r.evidence FROM survey s JOIN (VALUES
    (0, TRUE, FALSE, 1, 'urgent psychiatric evaluation', 'first-line'), (0, FALSE, FALSE, 2, 'quetiapine', 'first-line'),
    (0, FALSE, FALSE, 3, 'lurasidone', 'first-line'), (0, FALSE, TRUE, 4, 'lamotrigine', 'first-line'),
    (1, TRUE, FALSE, 1, 'urgent hospitalization evaluation', 'first-line'), (1, FALSE, FALSE, 2, 'lithium', 'first-line'),
    (1, FALSE, FALSE, 3, 'quetiapine', 'first-line'), (1, FALSE, FALSE, 4, 'valproate', 'first-line'),
    (2, TRUE, FALSE, 1, 'urgent hospitalization evaluation', 'first-line'), (2, FALSE, FALSE, 2, 'lithium', 'first-line'),
    (2, FALSE, FALSE, 3, 'quetiapine', 'first-line'), (2, FALSE, FALSE, 4, 'valproate', 'first-line'),
    (3, FALSE, FALSE, 1, 'cariprazine', 'second-line'), (3, FALSE, FALSE, 2, 'lurasidone', 'second-line'),
    (4, FALSE, FALSE, 1, 'asenapine', 'second-line'), (4, FALSE, FALSE, 2, 'cariprazine', 'second-line'))
    r(kind, crit, cyc, rank, treatment, evidence) ON s.user_id % 5 = r.kind
  WHERE (NOT crit OR q1 = 3) AND NOT (cyc AND q2 = 3)""")
query("treatment_candidates", "R12 J13", """
  SELECT c.user_id, c.rank, c.treatment, c.evidence FROM candidates c JOIN survey s USING (user_id)
  WHERE treatment <> CASE q7 WHEN 0 THEN 'lithium' WHEN 1 THEN 'quetiapine' WHEN 2 THEN 'lamotrigine' ELSE '' END
    AND treatment <> CASE q8 WHEN 0 THEN 'valproate' WHEN 1 THEN 'lurasidone' ELSE '' END""")(
    lambda t: CO.without_listed(CO.without_listed(X.treatment_candidates(PATIENTS(t)), TAKEN(t), ["user_id"]), BARRED(t), ["user_id"])
    .select("user_id", "rank", "treatment", "evidence"))
query("treatment_contraindications", "R12", """
  WITH k AS (
    SELECT c.user_id, c.rank, c.treatment, CASE
             WHEN s.user_id % 5 IN (1, 2) AND treatment = 'lithium' THEN ['renal impairment', 'pregnancy']
             WHEN s.user_id % 5 IN (1, 2) AND treatment = 'quetiapine' THEN ['diabetes', 'metabolic syndrome']
             WHEN s.user_id % 5 IN (1, 2) AND treatment = 'valproate' THEN ['pregnancy', 'liver disease']
             WHEN s.user_id % 5 = 0 AND treatment = 'lamotrigine' THEN ['rapid cycling', 'Stevens-Johnson syndrome history'] ELSE [] END AS x,
           ['pregnancy', 'diabetes', 'liver disease', 'none'][q9 + 1] AS own
    FROM candidates c JOIN survey s USING (user_id))
  SELECT user_id, rank, treatment, array_to_string(x, '; ') AS contraindications, array_to_string(list_filter(x, lambda y: y = own), '; ') AS applying FROM k""")(
    lambda t: text(X.with_contraindications(X.treatment_candidates(PATIENTS(t)).join(t.survey.select("user_id", F.array(F.get(F.array(
        *[F.lit(x) for x in ("Pregnancy", "diabetes", "Liver disease", "none")]), F.col("q9"))).alias("conditions")), "user_id"), "conditions"),
        "contraindications", "applying").select("user_id", "rank", "treatment", "contraindications", "applying"))
query("treatment_approval", "R13", """
  WITH p AS (
    SELECT user_id, q1 < 3 AS bp, ['sertraline', 'venlafaxine', 'lithium', 'fluoxetine'][q2 + 1] AS drug, q3 < 2 AS low,
           q7 IN (0, 2) AS stab, q7 IN (0, 1, 2) AS cover FROM survey),
  d AS (
    SELECT *, bp AND low AND drug <> 'lithium' AND NOT cover AS alone,
           bp AND drug IN ('sertraline', 'fluoxetine') AND stab AS ok FROM p)
  SELECT user_id, NOT alone AS approved,
         CASE WHEN alone THEN 'Antidepressant monotherapy is contraindicated in bipolar disorder'
              WHEN ok THEN 'Antidepressant acceptable with mood stabilizer coverage'
              WHEN drug = 'lithium' THEN 'Lithium approved - ensure regular monitoring of levels and renal function'
              ELSE 'Treatment within clinical guidelines' END AS rationale FROM d""")(
    lambda t: X.treatment_approval(t.survey.select(
        "user_id", F.when(F.col("q1") < 3, "bipolar_disorder").otherwise("unipolar").alias("diagnosis"),
        F.get(F.array(*[F.lit(x) for x in ("Sertraline", "venlafaxine", "Lithium", "fluoxetine")]), F.col("q2")).alias("proposed"),
        F.array_compact(F.array(E.ladder((F.col("q7") == 0, "Lithium"), (F.col("q7") == 1, "quetiapine"),
                                         (F.col("q7") == 2, "Lamotrigine"), otherwise=F.lit(None)))).alias("current"),
        F.when(F.col("q3") < 2, "depressed").otherwise("stable").alias("mood_state"))))
query("adjusted_confidence", "R14", """
  WITH n AS (SELECT user_id, count(*) AS days FROM nights GROUP BY user_id),
  b AS (
    SELECT user_id, days, days / 30 AS comp, user_id % 3 = 0 AS a, user_id % 4 = 0 AS m,
           0.95 * CASE WHEN days / 30 < 0.75 THEN 0.8 ELSE 1.0 END * CASE WHEN days < 30 THEN 0.8 ELSE 1.0 END
           * CASE WHEN user_id % 3 = 0 OR user_id % 4 = 0 THEN 0.7 ELSE 1.0 END AS v FROM n)
  SELECT user_id, round(v, 6)::DOUBLE AS adjusted, CASE WHEN v >= 0.8 THEN 'high' WHEN v >= 0.6 THEN 'medium' ELSE 'low' END AS reliability,
         concat_ws('; ', CASE WHEN comp < 0.75 THEN 'Insufficient data completeness' END,
           CASE WHEN days < 30 THEN 'Limited historical data (' || days || ' days)' END,
           CASE WHEN a OR m THEN 'Missing critical features: ' || concat_ws(', ', CASE WHEN a THEN 'activity_level' END,
             CASE WHEN m THEN 'mood_scores' END) END) AS limitations FROM b""")(
    lambda t: text(X.adjusted_confidence(
        D.with_sleep_date(t.sleep).groupBy("user_id").agg(F.countDistinct("date").alias("days")).select(
            "user_id", "days", (F.col("days") / 30).alias("completeness"), F.lit(0.95).alias("confidence"),
            E.messages((F.lit(True), "light"), (F.col("user_id") % 3 == 0, "activity_level"),
                       (F.col("user_id") % 4 == 0, "mood_scores")).alias("missing_features"))), "limitations"))
query("personal_thresholds", "R15", """
  WITH s AS (SELECT user_id, avg(sleep_hours) AS m, stddev_pop(sleep_hours) AS d FROM nights GROUP BY user_id),
  a AS (SELECT user_id, avg(steps) AS m, stddev_pop(steps) AS d FROM act_days GROUP BY user_id)
  SELECT user_id, round(greatest(3.0, s.m - 2 * s.d), 6) AS sleep_low, round(least(12.0, s.m + 2 * s.d), 6) AS sleep_high,
         round(greatest(0.0, a.m - 2 * a.d), 6) AS activity_low, round(a.m + 2 * a.d, 6) AS activity_high FROM s JOIN a USING (user_id)""")(
    lambda t: X.personal_thresholds(
        D.daily_sleep(t.sleep).groupBy("user_id").agg(F.avg("sleep_hours").alias("sleep_mean"), F.stddev_pop("sleep_hours").alias("sleep_std"))
        .join(D.daily_activity(t.activity).groupBy("user_id").agg(
            F.avg("steps").alias("activity_mean"), F.stddev_pop("steps").alias("activity_std")), "user_id")))
query("score_levels", "R16", """
  SELECT user_id, date, CASE WHEN depression < 0.25 THEN 'low' WHEN depression < 0.5 THEN 'moderate' WHEN depression < 0.75 THEN 'high'
         ELSE 'critical' END AS unit_level, CASE WHEN depression >= 0.7 THEN 'HIGH' WHEN depression >= 0.4 THEN 'MODERATE' ELSE 'LOW' END AS report_level,
         CASE WHEN depression * 20 <= 1 THEN CASE WHEN depression * 20 < 0.25 THEN 'low' WHEN depression * 20 < 0.5 THEN 'moderate'
                WHEN depression * 20 < 0.75 THEN 'high' ELSE 'critical' END
              WHEN depression * 20 < 5 THEN 'low' WHEN depression * 20 < 10 THEN 'moderate' WHEN depression * 20 < 15 THEN 'high'
              ELSE 'critical' END AS raw_level FROM stat_preds""")(
    lambda t: STAT(t).select(*K, X.score_level(F.col("depression")).alias("unit_level"),
                             X.report_level(F.col("depression")).alias("report_level"),
                             X.score_level(F.col("depression") * 20).alias("raw_level")))
query("highest_risk", "L3", """
  SELECT user_id, date, CASE WHEN depression >= hypomanic AND depression >= manic THEN 'depression'
         WHEN hypomanic >= manic THEN 'hypomanic' ELSE 'manic' END AS risk_type, greatest(depression, hypomanic, manic) AS risk_value
  FROM stat_preds""")(lambda t: STAT(t).select(*K, *MO.highest_risk("depression", "hypomanic", "manic")))

# ---- ensemble and reports ---------------------------------------------------------------
view("ens", """
  SELECT user_id, date, coalesce(a.depression * 0.6 + b.depression * 0.4, a.depression, b.depression) AS depression,
         coalesce(a.hypomanic * 0.6 + b.hypomanic * 0.4, a.hypomanic, b.hypomanic) AS hypomanic,
         coalesce(a.manic * 0.6 + b.manic * 0.4, a.manic, b.manic) AS manic,
         coalesce((a.confidence + b.confidence) / 2, a.confidence, b.confidence) AS confidence
  FROM stat_preds a FULL JOIN seq_preds b USING (user_id, date)""")
ENS = lambda t: MO.ensemble(STAT(t), SEQ(t))
RISK = ["depression", "hypomanic", "manic", "confidence"]
query("ensemble_scores", "M10", f"SELECT user_id, date, {r(*RISK)} FROM ens")(ENS)
query("risk_summary", "A27", """
  SELECT user_id, round(avg(depression), 6) AS avg_depression, round(avg(hypomanic), 6) AS avg_hypomanic, round(avg(manic), 6) AS avg_manic,
         count(*) AS days, round(avg(confidence) * CASE WHEN count(*) < 25 THEN 0.7 ELSE 1.0 END, 6) AS confidence
  FROM ens GROUP BY user_id""")(lambda t: MO.risk_summary(ENS(t), F.count(F.lit(1)) < 25))
query("report_text", "M13", """
  WITH s AS (
    SELECT user_id, count(*) AS n, avg(depression) AS d, avg(hypomanic) AS h, avg(manic) AS m, avg(confidence) AS c FROM ens GROUP BY user_id),
  f AS (
    SELECT user_id, string_agg(strftime(date, '%Y-%m-%d') || ' ' || CASE WHEN depression >= 0.7 THEN 'HIGH' WHEN depression >= 0.4
           THEN 'MODERATE' ELSE 'LOW' END, ', ' ORDER BY date) AS txt
    FROM (SELECT * FROM ens QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date) <= 7) GROUP BY user_id)
  SELECT user_id, 'Analysis Period: ' || n || ' days | Depression Risk: ' || CASE WHEN d >= 0.7 THEN 'HIGH' WHEN d >= 0.4 THEN 'MODERATE'
         ELSE 'LOW' END || ' | Hypomanic Risk: ' || CASE WHEN h >= 0.7 THEN 'HIGH' WHEN h >= 0.4 THEN 'MODERATE' ELSE 'LOW' END
         || ' | Manic Risk: ' || CASE WHEN m >= 0.7 THEN 'HIGH' WHEN m >= 0.4 THEN 'MODERATE' ELSE 'LOW' END
         || CASE WHEN d > 0.7 THEN ' | HIGH DEPRESSION RISK DETECTED' WHEN d > 0.4 THEN ' | MODERATE DEPRESSION RISK' ELSE ' | Low depression risk' END
         || CASE WHEN h > 0.5 OR m > 0.3 THEN ' | ELEVATED MOOD EPISODE RISK' ELSE '' END
         || CASE WHEN n < 25 THEN ' | Warnings: short history' ELSE '' END || ' | ' || txt AS report FROM s JOIN f USING (user_id)""")(
    lambda t: MO.report(ENS(t), {"short history": F.count(F.lit(1)) < 25}))
