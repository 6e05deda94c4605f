"""Canonical table schemas and the fixed values shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _D, _S, _I = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType()
_TS, _DATE = T.TimestampNTZType(), T.DateType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SLEEP = _schema(user_id=_L, source_name=_S, start_ts=_TS, end_ts=_TS, state=_S, rec_id=_L)
ACTIVITY = _schema(
    user_id=_L, source_name=_S, start_ts=_TS, end_ts=_TS,
    activity_type=_S, value=_D, unit=_S, rec_id=_L,
)
HEART = _schema(
    user_id=_L, source_name=_S, ts=_TS, metric_type=_S,
    value=_D, unit=_S, motion_context=_S, rec_id=_L,
)
EPISODES = _schema(
    user_id=_L, start_date=_DATE, end_date=_DATE, episode_type=_S, severity=_I,
    notes=_S, rater_id=_S, labeled_at=_TS,
)
BASELINES = _schema(
    user_id=_L, as_of=_DATE, feature_name=_S, mean=_D, std=_D, n=_L, effective_ts=_TS,
)
ACTIGRAPHY = _schema(user_id=_L, day=_I, minute_no=_I, intensity=_D)
SURVEY = T.StructType(
    [T.StructField("user_id", _L)] + [T.StructField(f"q{i}", _I) for i in range(1, 10)]
)

# Sleep states by their platform identifier, and their reading.
SLEEP_STATES = {
    "HKCategoryValueSleepAnalysisInBed": "IN_BED",
    "HKCategoryValueSleepAnalysisAsleep": "ASLEEP",
    "HKCategoryValueSleepAnalysisAwake": "AWAKE",
    "HKCategoryValueSleepAnalysisREM": "REM",
    "HKCategoryValueSleepAnalysisCore": "CORE",
    "HKCategoryValueSleepAnalysisDeep": "DEEP",
    "HKCategoryValueSleepAnalysisAsleepCore": "ASLEEP_CORE",
    "HKCategoryValueSleepAnalysisAsleepDeep": "ASLEEP_DEEP",
    "HKCategoryValueSleepAnalysisAsleepREM": "ASLEEP_REM",
    "HKCategoryValueSleepAnalysisAsleepUnspecified": "ASLEEP_UNSPECIFIED",
}
ASLEEP_STATES = [
    "ASLEEP", "REM", "CORE", "DEEP",
    "ASLEEP_CORE", "ASLEEP_DEEP", "ASLEEP_REM", "ASLEEP_UNSPECIFIED",
]
SLEEP_QUALITY = {
    "DEEP": "restorative", "ASLEEP_DEEP": "restorative", "REM": "rem", "ASLEEP_REM": "rem",
    "CORE": "light", "ASLEEP_CORE": "light", "ASLEEP": "general",
    "ASLEEP_UNSPECIFIED": "general", "IN_BED": "resting", "AWAKE": "disrupted",
}

# Platform identifiers of the activity and heart records.
ACTIVITY_TYPES = {
    "HKQuantityTypeIdentifierStepCount": "STEP_COUNT",
    "HKQuantityTypeIdentifierDistanceWalkingRunning": "DISTANCE_WALKING",
    "HKQuantityTypeIdentifierFlightsClimbed": "FLIGHTS_CLIMBED",
    "HKQuantityTypeIdentifierActiveEnergyBurned": "ACTIVE_ENERGY",
    "HKQuantityTypeIdentifierBasalEnergyBurned": "BASAL_ENERGY",
    "HKQuantityTypeIdentifierAppleExerciseTime": "EXERCISE_TIME",
    "HKQuantityTypeIdentifierAppleStandTime": "STAND_TIME",
}
HEART_METRICS = {
    "HKQuantityTypeIdentifierHeartRate": "HEART_RATE",
    "HKQuantityTypeIdentifierHeartRateVariabilitySDNN": "HRV_SDNN",
    "HKQuantityTypeIdentifierRestingHeartRate": "RESTING_HEART_RATE",
    "HKQuantityTypeIdentifierWalkingHeartRateAverage": "WALKING_HEART_RATE_AVG",
    "HKQuantityTypeIdentifierHeartRateRecoveryOneMinute": "HEART_RATE_RECOVERY",
}
MOTION_METADATA_KEY = "HKMetadataKeyHeartRateMotionContext"
MOTION_CONTEXTS = ["sedentary", "active", "unknown"]

# Merge threshold for sleep episodes, in hours.
MERGE_THRESHOLD_HOURS = 3.75

# Cut-offs of the rule tables.
PHQ_MAX = {"none": 4, "mild": 9, "moderate": 14, "moderately_severe": 19, "severe": 27}
PHQ_MIN = {"none": 0, "mild": 5, "moderate": 10, "moderately_severe": 15, "severe": 20}
ASRM_MAX = {"none": 5, "hypomanic": 10, "manic_moderate": 15, "manic_severe": 20}
ASRM_MIN = {"none": 0, "hypomanic": 6, "manic_moderate": 11, "manic_severe": 16}
HYPERSOMNIA_HOURS, NORMAL_SLEEP_MIN, NORMAL_SLEEP_MAX = 12.0, 6.0, 9.0
CRITICAL_SLEEP, REDUCED_SLEEP = 3.0, 5.0
SEVERE_LOW_STEPS, ELEVATED_STEPS, EXTREME_STEPS = 2000, 15000, 20000
REQUIRED_DAYS = {"manic": 7, "hypomanic": 4, "depressive": 14}
BIOMARKERS = {"efficiency_low": 0.85, "timing_variance_high": 2.0, "phase_advance_high": 2.0, "stability_low": 0.5, "variability_high": 1.0}
EARLY_WARNING = {"sleep_increase_hours": 2.0, "activity_decrease_percent": 30.0, "circadian_delay_hours": 1.0, "sleep_decrease_hours": 2.0,
                 "activity_increase_percent": 50.0}
