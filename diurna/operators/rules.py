"""Threshold rules as projections over patient-day tables.

Each function reads fixed column names and returns its input columns ``keys``
plus the outcome, so a rule costs one pass and no shuffle. Lists of factors are
arrays in rule order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diurna import schemas as S, wording
from diurna.functions import exprs as E
from diurna.operators.thresholds import limit_of

KEY = ["user_id", "date"]
LEVELS = ["low", "moderate", "high", "critical"]


def c(name: str) -> Column:
    return F.col(name)


def joined(*parts: Column) -> Column:
    return F.concat(*parts)


def level_number(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level) - 1


# ---- depression and mania, strict edges -----------------------------------------

def depression_risk(df: DataFrame) -> DataFrame:
    """Level from the score, raised by biomarkers; upper edges belong to the next band."""
    phq, sleep, steps = c("phq"), c("sleep_hours"), c("steps")
    at = limit_of(df)
    bands = [phq < at(f"phq_{k}_max") for k in ("none", "mild", "moderate", "severe")]

    def pick(*values: object) -> Column:
        return E.ladder(*zip(bands, values[:-1]), otherwise=values[-1])

    factor = pick(None, wording.MILD_PHQ_9, wording.MODERATE_PHQ_9, wording.SEVERE_PHQ_9, wording.VERY_SEVERE_PHQ)
    short, long, still = sleep < at("normal_sleep_min"), sleep > at("hypersomnia_hours"), steps <= at("severe_low_steps")
    modifier = (E.ladder((short, 1.2), (long, 1.1), otherwise=1.0) * E.ladder((still, 1.2), otherwise=1.0))
    base = pick("low", "low", "moderate", "high", "critical")
    raised = (modifier > 1.3) & (base == "moderate")
    text = pick(wording.MINIMAL_DEPRESSIVE_SYMPTOMS, wording.MILD_DEPRESSIVE_SYMPTOMS, wording.MODERATE_DEPRESSION_INDICATED,
                wording.SEVERE_DEPRESSION_INDICATED, wording.VERY_SEVERE_DEPRESSION)
    absent = E.messages((sleep.isNull(), wording.SLEEP_DATA), (steps.isNull(), wording.ACTIVITY_DATA))
    urgent = c("suicidal")
    return df.select(
        *KEY, E.ladder((urgent, "critical"), (raised, "high"), otherwise=base).alias("risk_level"),
        E.messages((factor.isNotNull(), factor), (short, wording.SEVERE_INSOMNIA), (~short & long, "hypersomnia"),
                   (still, wording.SEVERE_HYPOACTIVITY), (urgent, wording.SUICIDAL_IDEATION)).alias("risk_factors"),
        absent.alias("missing_factors"), modifier.alias("biomarker_modifier"),
        (F.when(sleep.isNull(), 0.9).otherwise(1.0) * F.when(steps.isNull(), 0.9).otherwise(1.0)).alias("confidence"),
        joined(
            E.ladder((urgent, wording.SUICIDAL_IDEATION_PRESENT),
                     (raised, joined(text, F.lit(wording.WITH_SEVERE_BIOMARKER))), otherwise=text),
            F.when(F.size(absent) > 0, joined(F.lit(wording.LIMITED_DATA), F.concat_ws(", ", absent), F.lit(" missing)")))
            .otherwise("")).alias("rationale"))


def mania_risk(df: DataFrame) -> DataFrame:
    asrm, at = c("asrm"), limit_of(df)
    bands = [asrm < at(f"asrm_{k}_max") for k in ("none", "hypomanic", "manic_moderate")]
    pick = lambda *v: E.ladder(*zip(bands, v[:-1]), otherwise=v[-1])
    factor = pick(None, wording.ELEVATED_ASRM_SCORE, wording.HIGH_ASRM_SCORE, wording.VERY_HIGH_ASRM)
    urgent = c("psychotic")
    return df.select(
        *KEY, F.when(urgent, "critical").otherwise(pick("low", "moderate", "high", "critical")).alias("risk_level"),
        E.messages((factor.isNotNull(), factor), (c("sleep_hours") < at("reduced_sleep"), wording.REDUCED_SLEEP),
                   (c("steps") >= at("elevated_steps"), "hyperactivity"), (urgent, wording.PSYCHOTIC_FEATURES)).alias("risk_factors"),
        F.when(urgent, wording.MANIC_EPISODE_WITH).otherwise(
            pick(wording.NO_MANIC_SYMPTOMS, wording.HYPOMANIC_SYMPTOMS_PRESENT, wording.MANIC_EPISODE_LIKELY,
                 wording.SEVERE_MANIC_EPISODE)).alias("rationale"),
        F.lit(0.85).alias("confidence"))


def mixed_risk(df: DataFrame) -> DataFrame:
    """Count of mixed features, level and the pole that outweighs the other by half."""
    phq, asrm, at = c("phq"), c("asrm"), limit_of(df)
    flags = [(c("sleep_disturbance"), wording.SLEEP_DISTURBANCE), (c("racing_thoughts"), wording.RACING_THOUGHTS),
             (c("anhedonia"), "anhedonia"), (c("increased_energy"), wording.INCREASED_ENERGY)]
    n = E.count_true(*[f for f, _ in flags])
    severe = (phq >= at("phq_severe_min")) | (asrm >= at("asrm_manic_moderate_min"))
    both = (phq >= at("phq_moderate_min")) & (asrm >= at("asrm_hypomanic_min"))
    return df.select(
        *KEY, n.alias("mixed_features"), F.greatest(phq, asrm).cast("double").alias("severity_score"),
        E.ladder((severe, "critical"), (n >= 2, "high"), otherwise="moderate").alias("risk_level"),
        E.ladder((phq > asrm * 1.5, "depressive"), (asrm > phq * 1.5, "manic"), otherwise="balanced").alias("dominant_pole"),
        E.ladder((severe, wording.SEVERE_MIXED_EPISODE), (n >= 3, wording.MIXED_MOOD_EPISODE),
                 (n >= 2, wording.MIXED_FEATURES_PRESENT), otherwise=wording.POSSIBLE_MIXED_STATE).alias("rationale"),
        E.messages(*flags, (both, wording.CONCURRENT_DEPRESSION_AND)).alias("risk_factors"))


# ---- episode reading, inclusive edges ---------------------------------------------

def _depression_reading(suicidal: Column, at: Callable[[str], Column]) -> dict[str, Column]:
    phq = c("phq")
    bands = [phq <= at(f"phq_{k}_max") for k in ("none", "mild", "moderate", "moderately_severe")]
    pick = lambda *v: E.ladder(*zip(bands, v[:-1]), otherwise=v[-1])
    level = pick("low", "low", "moderate", "high", "critical")
    sleepy = c("sleep_hours") > at("hypersomnia_hours")
    level = F.when(sleepy & (level == "low"), "moderate").otherwise(level)
    still = (c("steps") < at("severe_low_steps")) & (level != "critical")
    summary = joined(
        pick(wording.DEPRESSION_SCREENING_WITHIN, wording.MILD_DEPRESSIVE_SYMPTOMS_BELOW,
             wording.MODERATE_DEPRESSION_DETECTED,
             wording.MODERATELY_SEVERE_DEPRESSION,
             wording.SEVERE_DEPRESSION_REQUIRING),
        F.when(sleepy, wording.HYPERSOMNIA_PATTERN_DETECTED).otherwise(""),
        F.when(still, wording.SEVERE_ACTIVITY_REDUCTION).otherwise(""),
        F.when(suicidal, wording.SUICIDAL_IDEATION_PRESENT_URGENT).otherwise(""))
    return {"risk_level": F.when(suicidal, "critical").otherwise(level),
            "episode_type": pick("none", "none", "depressive", "depressive", "depressive"),
            "criteria_met": phq >= at("phq_moderate_min"), "summary": summary}


def _mania_reading(psychotic: Column, at: Callable[[str], Column]) -> dict[str, Column]:
    asrm = c("asrm")
    bands = [asrm <= at(f"asrm_{k}_max") for k in ("none", "hypomanic", "manic_moderate")]
    pick = lambda *v: E.ladder(*zip(bands, v[:-1]), otherwise=v[-1])
    sleepless = F.coalesce(c("sleep_hours") < at("critical_sleep"), F.lit(False))
    extreme = F.coalesce(c("steps") > at("extreme_steps"), F.lit(False))
    forced = sleepless | psychotic
    level = F.when(forced, "critical").otherwise(pick("low", "moderate", "high", "critical"))
    summary = F.when(
        psychotic, wording.MANIC_EPISODE_WITH_PSYCHOTIC
    ).otherwise(joined(
        pick(wording.MANIA_SCREENING_WITHIN, wording.HYPOMANIC_SYMPTOMS_DETECTED,
             wording.SIGNIFICANT_HYPOMANIC_SYMPTOMS,
             wording.SEVERE_MANIC_SYMPTOMS),
        F.when(sleepless, wording.CRITICAL_SLEEP_REDUCTION).otherwise("")))
    return {"risk_level": F.when(extreme & (level == "moderate"), "high").otherwise(level),
            "episode_type": F.when(forced, "manic").otherwise(pick("none", "hypomanic", "hypomanic", "manic")),
            "criteria_met": asrm >= at("asrm_hypomanic_min"),
            "summary": joined(summary, F.when(extreme, wording.SIGNIFICANTLY_ELEVATED_ACTIVITY).otherwise(""))}


def depression_episode(df: DataFrame) -> DataFrame:
    """Level, episode type, criterion and text; upper edges belong to the band."""
    return df.select(*KEY, *[v.alias(n) for n, v in _depression_reading(c("suicidal"), limit_of(df)).items()])


def mania_episode(df: DataFrame) -> DataFrame:
    return df.select(*KEY, *[v.alias(n) for n, v in _mania_reading(c("psychotic"), limit_of(df)).items()])


def mixed_episode(df: DataFrame) -> DataFrame:
    """Full criteria of one pole with at least three symptoms of the other, else the leading pole."""
    at = limit_of(df)
    manic = E.count_true(c("racing_thoughts"), c("increased_energy"),
                         c("decreased_sleep") | F.coalesce(c("sleep_hours") < at("normal_sleep_min"), F.lit(False)))
    low = E.count_true(c("depressed_mood"), c("anhedonia"), c("guilt"))
    down = (c("phq") >= at("phq_moderate_min")) & (manic >= 3)
    up = (c("asrm") >= at("asrm_hypomanic_min")) & (low >= 3)
    dep, man = _depression_reading(F.lit(False), at), _mania_reading(F.lit(False), at)
    fixed_down = {"risk_level": "high", "episode_type": "depressive_with_mixed_features", "criteria_met": True,
                  "summary": wording.MAJOR_DEPRESSIVE_EPISODE}
    fixed_up = {"risk_level": "high", "episode_type": "manic_with_mixed_features", "criteria_met": True,
                "summary": wording.MANIC_EPISODE_WITH_MIXED}
    return df.select(*KEY, *[
        E.ladder((down, fixed_down[n]), (up, fixed_up[n]), (c("phq") >= c("asrm"), dep[n]), otherwise=man[n]).alias(n)
        for n in dep])


def composite_risk(df: DataFrame) -> DataFrame:
    """Larger of the two component levels; poor adherence turns moderate into high."""
    phq, asrm, at = c("phq"), c("asrm"), limit_of(df)
    dep = E.ladder((phq < at("phq_mild_max"), "low"), (phq < at("phq_moderate_max"), "moderate"),
                   (phq < at("phq_severe_max"), "high"), otherwise="critical")
    man = E.ladder((asrm < at("asrm_none_max"), "low"), (asrm < at("asrm_hypomanic_max"), "moderate"),
                   (asrm < at("asrm_manic_moderate_max"), "high"), otherwise="critical")
    a, b = level_number(dep), level_number(man)
    top = F.when(b > a, man).otherwise(dep)
    return df.select(
        *KEY, dep.alias("depression_level"), man.alias("mania_level"),
        F.when((c("adherence") < 0.7) & (top == "moderate"), "high").otherwise(top).alias("overall_level"),
        E.ladder(((a == 0) & (b == 0), "none"), (b > a, "mania"), otherwise="depression").alias("primary_concern"))


# ---- biomarkers ----------------------------------------------------------------------

def biomarkers(df: DataFrame) -> DataFrame:
    """Sleep, activity and rhythm factors with their combination."""
    s, e, v = c("sleep_hours"), c("efficiency"), c("timing_variance")
    steps, rest = c("steps"), c("sedentary_hours")
    adv, stab, var = c("phase_advance"), c("interdaily_stability"), c("intradaily_variability")
    at = limit_of(df)
    weak, broken, ahead = stab < at("stability_low"), var > at("variability_high"), adv > at("phase_advance_high")
    sleep_rules = [(s < at("critical_sleep"), wording.CRITICAL_SHORT_SLEEP),
                   (e < at("efficiency_low"), wording.POOR_SLEEP_EFFICIENCY), (v > at("timing_variance_high"), wording.HIGHLY_VARIABLE_SLEEP)]
    up_rules = [(steps > at("elevated_steps"), wording.SIGNIFICANTLY_ELEVATED_ACTIVITY_LEVEL),
                (steps > at("extreme_steps"), wording.EXTREME_ACTIVITY_ELEVATION), (rest < 4, wording.MINIMAL_REST_PERIODS)]
    down_rule = (steps < at("severe_low_steps"), wording.SEVERE_ACTIVITY_REDUCTION_2)
    clock_rules = [(ahead, wording.SIGNIFICANT_CIRCADIAN_PHASE), (weak, wording.LOW_CIRCADIAN_RHYTHM),
                   (broken, wording.HIGH_CIRCADIAN_FRAGMENTATION)]
    n_sleep, n_up = E.count_true(*[r for r, _ in sleep_rules]), E.count_true(*[r for r, _ in up_rules])
    n_clock, n_down = E.count_true(ahead), E.count_true(down_rule[0])
    unstable = F.coalesce(weak, F.lit(False)) | F.coalesce(broken, F.lit(False))
    mania = n_sleep + n_up + n_clock
    return df.select(
        *KEY, n_sleep.alias("sleep_factors"), n_up.alias("activity_factors"), n_clock.alias("circadian_factors"),
        mania.alias("mania_factors"), n_down.alias("depression_factors"),
        F.when(unstable, "high").otherwise("low").alias("instability"),
        F.when(s < at("critical_sleep"), "urgent").otherwise("routine").alias("priority"),
        E.messages(*sleep_rules, *up_rules, down_rule, *clock_rules).alias("notes"),
        F.when((mania > 0) | (n_down > 0), F.format_string(
            wording.DIGITAL_BIOMARKERS_INDICATE, mania, n_down))
        .otherwise("").alias("summary"))


# ---- diagnostic criteria ----------------------------------------------------------------

def _wanted_symptoms() -> Column:
    return F.when(F.contains(c("episode_type"), F.lit("depressive")), 5).otherwise(3)


def _impaired_domains() -> Column:
    return E.messages((c("work"), "work/occupational"), (c("social"), "social/interpersonal"),
                      (c("self_care"), "self-care"), (c("hospitalized"), wording.HOSPITALIZATION_REQUIRED))


def criteria_notes(df: DataFrame) -> DataFrame:
    """What was found of symptoms and of impairment, as text."""
    found, wanted, domains = c("symptoms"), _wanted_symptoms(), _impaired_domains()
    return df.select(
        "rec_id",
        F.when(found >= wanted, F.format_string(wording.ENOUGH_SYMPTOMS, found, wanted))
        .otherwise(F.format_string(wording.TOO_FEW_SYMPTOMS, found, wanted)).alias("symptom_note"),
        F.when(F.size(domains) > 0, joined(F.lit(wording.IMPAIRMENT_IN), F.concat_ws(", ", domains)))
        .otherwise(wording.NO_IMPAIRMENT).alias("impairment_note"))


def criteria(df: DataFrame) -> DataFrame:
    """Duration, symptom count and impairment of an episode row, and their conjunction."""
    kind, days, ward = c("episode_type"), c("symptom_days"), c("hospitalized")
    mixed = F.contains(kind, F.lit("mixed"))
    at = limit_of(df)
    manic, hypomanic, low = (at(f"{k}_days").cast("int") for k in ("manic", "hypomanic", "depressive"))
    need = E.ladder((kind == "manic", manic), (kind == "hypomanic", hypomanic), (kind == "depressive", low),
                    (mixed & F.contains(kind, F.lit("depressive")), low), (mixed, manic), otherwise=0)
    long = days >= need
    met = E.ladder((kind == "manic", long | ward), (kind == "hypomanic", long & ~ward), (kind == "depressive", long),
                   (mixed, long | (F.contains(kind, F.lit("manic")) & ward)), otherwise=False)
    note = E.ladder(
        (met, joined(F.format_string(wording.EPISODE_DURATION_OF, days),
                     F.when(ward & (kind == "manic"), wording.HOSPITALIZATION_OVERRIDES_DURATION).otherwise(""))),
        (ward & (kind == "hypomanic"), F.lit(wording.HOSPITALIZATION_INVALIDATES_HYPOMANIC)),
        otherwise=F.format_string(wording.DURATION_INSUFFICIENT_FOR, kind, days, need))
    wanted, domains = _wanted_symptoms(), _impaired_domains()
    enough = c("symptoms") >= wanted
    impaired = F.size(domains) > 0
    every = met & enough & impaired
    return df.select(
        "rec_id", need.alias("required_days"), met.alias("duration_met"), note.alias("duration_note"),
        wanted.alias("required_symptoms"), enough.alias("symptoms_met"), domains.alias("domains"),
        impaired.alias("impairment_met"), every.alias("all_met"),
        joined(F.when(every, "Meets").otherwise(wording.DOES_NOT_MEET), F.lit(wording.DSM_5_CRITERIA), kind, F.lit(" episode"))
        .alias("summary"))


# ---- early warnings and interventions ------------------------------------------------------

def early_warnings(df: DataFrame, sleep_factor: float = 1.0, activity_factor: float = 1.0) -> DataFrame:
    """Signs against the user's own baseline; the factors, and each row's own sensitivities, scale the changes."""
    at = limit_of(df)
    sleep = c("sleep_change") * sleep_factor * at("sleep_sensitivity")
    act = c("activity_change") * activity_factor * at("activity_sensitivity")
    down = [(sleep > at("sleep_increase_hours"), wording.SIGNIFICANT_SLEEP_INCREASE),
            (act <= -at("activity_decrease_percent"), wording.MAJOR_ACTIVITY_REDUCTION),
            (c("circadian_shift") > at("circadian_delay_hours"), wording.CIRCADIAN_PHASE_DELAY)]
    up = [(sleep < -at("sleep_decrease_hours"), wording.SIGNIFICANT_SLEEP_REDUCTION),
          (act > at("activity_increase_percent"), wording.MAJOR_ACTIVITY_INCREASE),
          (c("fast_speech"), wording.INCREASED_SPEECH_RATE)]
    n_down, n_up = E.count_true(*[r for r, _ in down]), E.count_true(*[r for r, _ in up])
    n, run = n_down + n_up, c("consecutive_days")
    act_now = (n >= 3) & (run >= 3)
    return df.select(
        *df.columns, (n_down > 0).alias("depression_warning"), (n_up > 0).alias("mania_warning"),
        act_now.alias("trigger_intervention"), E.messages(*down, *up).alias("signs"), n.alias("sign_count"),
        E.ladder((act_now, "high"), ((n >= 2) & (run >= 2), "moderate"), (n >= 1, "low"), otherwise="none").alias("urgency"),
        F.least(F.lit(1.0), n / 4.0).alias("severity"), F.when(run >= 3, 1.0).otherwise(0.8).alias("confidence"))


def warning_summary(warned: DataFrame, days: str = "consecutive_days") -> DataFrame:
    """warned with the text of its signs; ``personal`` rows say that their own sensitivities were used."""
    down, up, signs = c("depression_warning"), c("mania_warning"), F.concat_ws(", ", "signs")
    any_sign = c("sign_count") > 0
    found = F.lit(wording.DETECTED)
    if "personal" in warned.columns:
        found = F.when(c("personal") & any_sign, wording.DETECTED_PERSONALLY).otherwise(found)
    text = E.ladder(
        (~any_sign, joined(F.lit(wording.NO_WARNING_SIGNS), found)),
        (down & up, joined(F.lit(wording.MIXED_WARNING_SIGNS), found, F.lit(wording.BOTH_INDICATORS))),
        (down, joined(F.lit(wording.DEPRESSION_WARNING_SIGNS), found, F.lit(": "), signs)),
        otherwise=joined(F.lit(wording.MANIA_WARNING_SIGNS), found, F.lit(": "), signs))
    after = E.ladder((c("trigger_intervention"), wording.INTERVENE_NOW), ((c(days) < 3) & any_sign, wording.KEEP_MONITORING), otherwise="")
    return warned.withColumn("summary", joined(text, after))


def interventions(warned: DataFrame) -> DataFrame:
    """Whether to intervene, how, and how soon, from warnings, current level and past episodes."""
    level, urgency, past = c("risk_level"), c("urgency"), c("previous_episodes")
    shift = F.abs("sleep_change")
    yes = urgency.isin("moderate", "high") | (past >= 2)
    kind = E.ladder((~yes, "monitoring"), (level == "low", "preventive"), (level.isin("moderate", "high"), "acute"),
                    otherwise="maintenance")
    soon = E.ladder(((level == "critical") | (shift > 4), "emergency"), ((level == "high") | (shift > 2), "high"),
                    (level == "moderate", "moderate"), otherwise="low")
    actions = E.messages(
        (soon == "emergency", wording.IMMEDIATE_PSYCHIATRIC_EVALUATION),
        (kind == "preventive", wording.INCREASE_MONITORING_FREQUENCY),
        (kind == "preventive", wording.REVIEW_AND_OPTIMIZE),
        (kind == "preventive", wording.CONSIDER_PROPHYLACTIC_MEDICATION),
        (kind == "acute", wording.SCHEDULE_URGENT_CLINICAL),
        (kind == "acute", wording.INITIATE_ACUTE_TREATMENT), (kind == "acute", wording.DAILY_SYMPTOM_MONITORING))
    reasons = E.messages(
        (shift > 2, wording.SIGNIFICANT_SLEEP_DISRUPTION), (past >= 2, wording.HISTORY_OF_MULTIPLE),
        (urgency.isin("moderate", "high"), joined(urgency, F.lit(wording.EARLY_WARNING_SIGNS))))
    return warned.select(*KEY, yes.alias("recommend"), kind.alias("intervention_type"), soon.alias("urgency"),
                         joined(F.lit(wording.INTERVENTION_RECOMMENDED_DUE), F.concat_ws(", ", reasons)).alias("rationale"),
                         actions.alias("actions"))


# ---- assessment --------------------------------------------------------------------------------

def assessment(df: DataFrame) -> DataFrame:
    """Diagnosis, level, confidence, complexity and completeness of one patient-day."""
    phq, asrm = F.coalesce(c("phq"), F.lit(0)), F.coalesce(c("asrm"), F.lit(0))
    low, up = phq >= 10, asrm >= 6
    diagnosis = E.ladder((low & ~up, "depressive_episode"), (up & ~low & (asrm >= 14), "manic_episode"),
                         (up & ~low, "hypomanic_episode"), (low & up, "mixed_episode"), otherwise="euthymic")
    level = E.ladder((c("suicidal") | c("psychotic"), "critical"), ((phq >= 15) | (asrm >= 14), "high"),
                     (low | up, "moderate"), otherwise="low")
    kind = E.map_episode_type(diagnosis, E.TO_DIAGNOSTIC)
    symptoms = F.when(low, 5).otherwise(0) + F.when(up, 3).otherwise(0)
    need = E.ladder((kind == "manic", 7), (kind == "hypomanic", 4), (kind == "depressive", 14), (kind == "mixed", 7),
                    otherwise=0)
    lasting = (kind != "euthymic") & (c("symptom_days") >= need)
    meets = lasting & (symptoms >= F.when(kind == "depressive", 5).otherwise(3)) & c("impaired")
    has = lambda n: c(n).isNotNull().cast("int")
    points = has("phq") + has("asrm") + has("sleep_hours") + has("steps")
    burden = E.count_true(c("comorbidities") > 0, c("substance_use"), c("psychotic"), c("mixed_features"))
    return df.select(
        *KEY, diagnosis.alias("diagnosis"), level.alias("risk_level"), meets.alias("criteria_met"),
        F.least(0.5 + points * 0.1, F.lit(0.95)).alias("confidence"), (burden / 4.0).alias("complexity"),
        (((has("phq") + has("asrm")) / 2 + (has("sleep_hours") + has("steps")) / 2) / 2).alias("completeness"),
        (level == "critical").alias("immediate"),
        E.messages((c("phq").isNull(), wording.MISSING_DEPRESSION_SCREENING), (c("sleep_hours").isNull(), wording.MISSING_SLEEP_DATA))
        .alias("limitations"),
        joined(F.lit(wording.PATIENT_PRESENTS_WITH), F.replace(diagnosis, F.lit("_"), F.lit(" ")), F.lit(" with "), level,
               F.lit(wording.RISK_LEVEL_CLINICAL), F.when(meets, "meets").otherwise(wording.DOES_NOT_MEET_2),
               F.lit(wording.DSM_5_CRITERIA_2)).alias("summary"))


def clinical_summary(df: DataFrame) -> DataFrame:
    """One sentence per row from level, episode type, criteria, confidence and score."""
    kind = F.replace(c("episode_type"), F.lit("_"), F.lit(" "))
    kind = F.when(kind == "depressive", wording.MAJOR_DEPRESSIVE_EPISODE_2).otherwise(kind)
    parts = E.messages(
        (F.lit(True), joined(F.lit(wording.CLINICAL_ASSESSMENT_INDICATES), c("risk_level"), F.lit(" risk"))),
        (c("episode_type") != "none", joined(F.lit("for "), kind)), (c("criteria_met"), wording.MEETING_DSM_5),
        (F.lit(True), F.format_string(wording.CONFIDENCE, F.round(c("confidence") * 100).cast("int"))),
        (c("phq").isNotNull(), F.format_string(wording.PHQ_SCORE, c("phq"))))
    return df.select(*KEY, joined(F.concat_ws(". ", parts), F.lit(".")).alias("summary"))


def adjusted_confidence(df: DataFrame) -> DataFrame:
    """Confidence lowered for gaps, short history and missing critical features."""
    critical = F.array_intersect("missing_features", F.array(*[
        F.lit(x) for x in ("sleep_duration", "activity_level", "mood_scores")]))
    thin, young, blind = c("completeness") < 0.75, c("days") < 30, F.size(critical) > 0
    cut = lambda f, x: F.when(f, x).otherwise(1.0)
    value = F.round(c("confidence") * cut(thin, 0.8) * cut(young, 0.8) * cut(blind, 0.7), 9)
    return df.select(
        "user_id", value.alias("adjusted"),
        E.ladder((value >= 0.8, "high"), (value >= 0.6, "medium"), otherwise="low").alias("reliability"),
        E.messages((thin, wording.INSUFFICIENT_DATA_COMPLETENESS),
                   (young, F.format_string(wording.LIMITED_HISTORICAL_DATA, c("days"))),
                   (blind, joined(F.lit(wording.MISSING_CRITICAL_FEATURES), F.concat_ws(", ", critical)))).alias("limitations"))


def personal_thresholds(df: DataFrame) -> DataFrame:
    s, ds, a, da = c("sleep_mean"), c("sleep_std"), c("activity_mean"), c("activity_std")
    return df.select("user_id", F.greatest(F.lit(3.0), s - 2 * ds).alias("sleep_low"),
                     F.least(F.lit(12.0), s + 2 * ds).alias("sleep_high"),
                     F.greatest(F.lit(0.0), a - 2 * da).alias("activity_low"), (a + 2 * da).alias("activity_high"))


def score_level(score: Column) -> Column:
    """Level of a score on the unit scale (up to 1) or the raw scale."""
    unit = E.ladder((score < 0.25, "low"), (score < 0.5, "moderate"), (score < 0.75, "high"), otherwise="critical")
    raw = E.ladder((score < 5, "low"), (score < 10, "moderate"), (score < 15, "high"), otherwise="critical")
    return F.when(score <= 1.0, unit).otherwise(raw)


def report_level(score: Column) -> Column:
    return E.ladder((score >= 0.7, "HIGH"), (score >= 0.4, "MODERATE"), otherwise="LOW")


# ---- reading of model scores ----------------------------------------------------------------------

def interpretation(df: DataFrame) -> DataFrame:
    """Label, level, confidence, monitoring and secondary risks of three scores."""
    d, m, h = c("depression"), c("manic"), c("hypomanic")
    top = F.greatest(d, m, h)
    ranked = F.sort_array(F.array(d, m, h), asc=False)
    first, second, third = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1)), F.get(ranked, F.lit(2))
    mixed = (d > 0.5) & ((m > 0.3) | (h > 0.3))
    rules = [
        (mixed, wording.MIXED_EPISODE, "critical"), (top < 0.2, wording.EUTHYMIC_STABLE, "low"),
        ((d == top) & (d >= 0.8), wording.SEVERE_DEPRESSIVE_EPISODE, "high"),
        ((d == top) & (d >= 0.6), wording.MODERATE_DEPRESSIVE_EPISODE, "moderate"),
        ((d == top) & (d >= 0.4), wording.MILD_DEPRESSIVE_EPISODE, "moderate"),
        (d == top, wording.SUBCLINICAL_DEPRESSION, "low"),
        ((m == top) & (m >= 0.8), wording.MANIC_EPISODE, "high"),
        ((m == top) & (m >= 0.6), wording.HYPOMANIC_EPISODE_WITH, "high"),
        (m == top, wording.SUBCLINICAL_MANIA, "moderate"),
        (h >= 0.6, wording.HYPOMANIC_EPISODE, "moderate"), (h >= 0.4, wording.MILD_HYPOMANIC_EPISODE, "low"),
    ]
    label = E.ladder(*[(r, n) for r, n, _ in rules], otherwise=wording.SUBCLINICAL_HYPOMANIA)
    level = E.ladder(*[(r, n) for r, _, n in rules], otherwise="low")
    sure = E.ladder(
        ((first > 0.7) & (second < 0.3), 0.9), ((first > 0.6) & (second < 0.4), 0.8), (first > 0.5, 0.7),
        ((first < 0.2) & (F.round(first - third, 9) < 0.1), 0.8), (F.round(first - second, 9) < 0.1, 0.5), otherwise=0.6)
    return df.select(
        *KEY, "depression", "hypomanic", "manic", label.alias("diagnosis"), level.alias("risk_level"),
        sure.alias("confidence"),
        E.ladder((level.isin("critical", "high"), "daily"), (level == "moderate", "weekly"), otherwise="monthly")
        .alias("monitoring"),
        F.least(F.lit(1.0), F.least(d, F.greatest(m, h)) * 2).alias("mixed_risk"),
        F.when((F.round(F.abs(d - m), 9) < 0.3) & (F.greatest(d, m) > 0.5), 0.7).otherwise(0.2).alias("cycling_risk"),
        F.when(m > 0.7, m * 0.7).otherwise(0.0).alias("psychosis_risk"),
        F.when(d > 0.6, d * 0.8).otherwise(d * 0.3).alias("suicide_risk"))


def notes_and_advice(read: DataFrame) -> DataFrame:
    """Notes and recommendations for an interpreted row."""
    d, m, h, label, level = (c(n) for n in ("depression", "manic", "hypomanic", "diagnosis", "risk_level"))
    has = lambda word: F.contains(label, F.lit(word))
    mixed, calm = has("Mixed"), has("Euthymic")
    low = ~mixed & ~calm & (has("Depressive") | has("Depression"))
    manic = ~mixed & ~calm & ~low & has("Manic")
    hypo = ~mixed & ~calm & ~low & ~manic & has("Hypomanic")
    other = ~mixed & ~calm
    lifted = (m > 0.3) | (h > 0.3)
    two = lambda text, v: F.format_string(text, v)
    notes = E.messages(
        (mixed, wording.MIXED_MOOD_EPISODE_DETECTED),
        (mixed, wording.HIGH_RISK_STATE),
        (mixed, wording.MEETS_DSM_5),
        (calm, wording.PATIENT_SHOWS_STABLE), (calm, wording.ALL_MOOD_SCORES),
        (low, two(wording.PATIENT_SHOWS_STRONG, d)),
        (low & (d > 0.8), wording.SEVERITY_LEVEL_SUGGESTS),
        (low & (d > 0.7), wording.MEETS_DSM_5_CRITERIA),
        (manic, two(wording.PATIENT_EXHIBITS_MANIC, m)),
        (manic & (m > 0.7), wording.HIGH_RISK_OF),
        (manic & (m > 0.7), wording.CONSISTENT_WITH_DSM),
        (hypo, two(wording.PATIENT_SHOWS_HYPOMANIA, h)),
        (hypo, wording.MONITOR_FOR_POTENTIAL),
        (hypo & (h > 0.6), wording.MEETS_DSM_5_CRITERIA_FOR),
        (other & (d > 0.3) & ~has("Depression"), two(wording.SECONDARY_DEPRESSION_RISK, d)),
        (other & lifted & ~has("Manic"), wording.ELEVATED_MOOD_SYMPTOMS),
        (other & (d > 0.5) & lifted, wording.MIXED_FEATURES_PRESENT_INCREASED),
        (other & (d > 0.5) & lifted, wording.MIXED_EPISODE_PER))
    is_ = lambda name: level == name
    high_low, high_up = is_("high") & has("Depression"), is_("high") & ~has("Depression") & has("Manic")
    mid_low, mid_up = is_("moderate") & has("Depression"), is_("moderate") & ~has("Depression") & has("Hypomanic")
    advice = E.messages(
        (is_("critical"), wording.EMERGENCY_PSYCHIATRIC_EVALUATION),
        (is_("critical"), wording.CRISIS_INTERVENTION_TEAM), (is_("critical"), wording.CONSIDER_IMMEDIATE_HOSPITALIZATION),
        (is_("high"), wording.URGENT_PSYCHIATRIC_EVALUATION), (is_("high"), wording.CONSIDER_IMMEDIATE_SAFETY),
        (high_low, wording.ASSESS_SUICIDE_RISK), (high_low, wording.CONSIDER_ANTIDEPRESSANT_THERAPY),
        (high_up, wording.EVALUATE_NEED_FOR), (high_up, wording.MONITOR_FOR_PSYCHOTIC),
        (high_up, wording.CONSIDER_EMERGENCY_DEPARTMENT),
        (is_("moderate"), wording.SCHEDULE_PSYCHIATRIC_FOLLOW),
        (is_("moderate"), wording.MONITOR_SYMPTOM_PROGRESSION),
        (mid_low, wording.CONSIDER_PSYCHOTHERAPY_REFERRAL), (mid_low, wording.ENCOURAGE_BEHAVIORAL_ACTIVATION),
        (mid_up, wording.MAINTAIN_REGULAR_SLEEP), (mid_up, wording.AVOID_STIMULANTS_AND),
        (is_("low"), wording.CONTINUE_CURRENT_MONITORING), (is_("low"), wording.MAINTAIN_HEALTHY_LIFESTYLE),
        (F.lit(True), wording.ENSURE_MEDICATION_ADHERENCE), (F.lit(True), wording.TRACK_MOOD_CHANGES))
    return read.select(*KEY, F.concat_ws("; ", notes).alias("notes"), F.concat_ws("; ", advice).alias("recommendations"))


# ---- treatments ---------------------------------------------------------------------------------------

# Candidate treatments by episode type (type, only when critical, unless rapid cycling,
# rank, treatment, evidence, description).
_MANIA = [
    (True, False, 1, "urgent hospitalization evaluation", "first-line", "Immediate safety assessment required"),
    (False, False, 2, "lithium", "first-line", "First-line mood stabilizer for acute mania"),
    (False, False, 3, "quetiapine", "first-line", "Atypical antipsychotic for acute mania"),
    (False, False, 4, "valproate", "first-line", "Mood stabilizer effective for acute mania"),
]
TREATMENTS = [("manic", *row) for row in _MANIA] + [("hypomanic", *row) for row in _MANIA] + [
    ("depressive", True, False, 1, "urgent psychiatric evaluation", "first-line",
     "Urgent assessment required for severe depression"),
    ("depressive", False, False, 2, "quetiapine", "first-line", "First-line treatment for bipolar depression"),
    ("depressive", False, False, 3, "lurasidone", "first-line", "FDA-approved for bipolar depression"),
    ("depressive", False, True, 4, "lamotrigine", "first-line",
     "Mood stabilizer for bipolar depression (not for rapid cycling)"),
    ("depressive_with_mixed_features", False, False, 1, "cariprazine", "second-line",
     "Cariprazine is effective for depression with mixed features"),
    ("depressive_with_mixed_features", False, False, 2, "lurasidone", "second-line",
     "Lurasidone is an alternative for mixed depression"),
    ("manic_with_mixed_features", False, False, 1, "asenapine", "second-line", "Effective for mania with mixed features"),
    ("manic_with_mixed_features", False, False, 2, "cariprazine", "second-line",
     "Covers both manic and depressive symptoms"),
]
TREATMENT_SCHEMA = ("episode_type string, only_critical boolean, unless_cycling boolean, rank int, treatment string, "
                    "evidence string, description string")


def treatment_candidates(patients: DataFrame) -> DataFrame:
    """Candidates per patient row from the rule table, a fixed handful of rows."""
    table = patients.sparkSession.createDataFrame(TREATMENTS, TREATMENT_SCHEMA)
    return patients.join(F.broadcast(table), "episode_type").filter(
        (~c("only_critical") | (c("risk_level") == "critical")) & ~(c("unless_cycling") & c("rapid_cycling")))


# Conditions that speak against a candidate, by episode type and treatment.
_MANIA_CONTRA = {"lithium": ["renal impairment", "pregnancy"], "quetiapine": ["diabetes", "metabolic syndrome"],
                 "valproate": ["pregnancy", "liver disease"]}
CONTRAINDICATIONS = {"manic": _MANIA_CONTRA, "hypomanic": _MANIA_CONTRA,
                     "depressive": {"lamotrigine": ["rapid cycling", "Stevens-Johnson syndrome history"]}}


def with_contraindications(candidates: DataFrame, conditions: str | None = None) -> DataFrame:
    """candidates with the conditions that speak against each; with a column of the patient's own
    conditions (an array) also those of them that apply, compared without case."""
    none = F.array().cast("array<string>")
    against = E.ladder(*[
        ((c("episode_type") == kind) & (c("treatment") == drug), F.array(*[F.lit(x) for x in listed]))
        for kind, table in CONTRAINDICATIONS.items() for drug, listed in table.items()], otherwise=none)
    out = candidates.withColumn("contraindications", against)
    if conditions is None:
        return out
    own = F.transform(F.coalesce(F.col(conditions), none), lambda x: F.lower(x))
    return out.withColumn("applying", F.filter("contraindications", lambda x: F.array_contains(own, F.lower(x))))


def treatment_approval(df: DataFrame) -> DataFrame:
    """Ordered decision rules; the first that applies decides."""
    drug = F.lower("proposed")
    meds = F.transform("current", lambda x: F.lower(x))
    any_of = lambda *names: F.arrays_overlap(meds, F.array(*[F.lit(n) for n in names]))
    bipolar = c("diagnosis") == "bipolar_disorder"
    alone = (bipolar & F.contains(c("mood_state"), F.lit("depressed"))
             & drug.isin("sertraline", "fluoxetine", "escitalopram", "venlafaxine")
             & ~any_of("lithium", "valproate", "lamotrigine", "quetiapine"))
    covered = (bipolar & drug.isin("sertraline", "fluoxetine", "escitalopram")
               & any_of("lithium", "valproate", "lamotrigine"))
    return df.select("user_id", (~alone).alias("approved"), E.ladder(
        (alone, wording.ANTIDEPRESSANT_MONOTHERAPY_IS),
        (covered, wording.ANTIDEPRESSANT_ACCEPTABLE_WITH),
        (drug == "lithium", wording.LITHIUM_APPROVED_ENSURE),
        otherwise=wording.TREATMENT_WITHIN_CLINICAL).alias("rationale"))
