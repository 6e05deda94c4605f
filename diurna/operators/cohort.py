"""Cohort tables, labels, episodes and baselines as joins and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diurna import schemas as S
from diurna.functions import exprs as E
from diurna.operators import ordering as O

# Tokens that mark the two medication classes.
BENZODIAZEPINES = [
    "d00321", "d00732", "d00149", "d00533", "d00674", "d00541", "alprazolam", "xanax", "lorazepam", "ativan",
    "clonazepam", "klonopin", "diazepam", "valium", "temazepam", "restoril",
]
SSRIS = [
    "d00283", "d00859", "d00415", "d00823", "d04851", "d00506", "fluoxetine", "prozac", "sertraline", "zoloft",
    "paroxetine", "paxil", "citalopram", "celexa", "escitalopram", "lexapro",
]


# ---- cohort ----------------------------------------------------------------------

def cohort_daily(actigraphy: DataFrame) -> DataFrame:
    """Daily totals, sample deviation and minutes by intensity band."""
    x = F.col("intensity")
    return actigraphy.groupBy("user_id", "day").agg(
        F.sum(x).alias("total_activity"), F.avg(x).alias("mean_activity"), F.stddev_samp(x).alias("std_activity"),
        F.count_if(x < 100).alias("sedentary_minutes"), F.count_if((x >= 100) & (x < 760)).alias("moderate_minutes"),
        F.count_if(x >= 760).alias("vigorous_minutes"))


def questionnaire(survey: DataFrame, items: list[str], cutoff: int = 10) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in items])
    return survey.select("user_id", total.alias("total")).withColumn(
        "depressed", (F.col("total") >= cutoff).cast("int"))


def with_drug_id(rx: DataFrame, drugs: DataFrame) -> DataFrame:
    """Unmatched prescriptions stay, without an id. The optimizer sizes the join."""
    return rx.join(drugs, "drug_key", "left")


def medication_flags(rx: DataFrame, drugs: DataFrame, classes: dict[str, list[str]]) -> DataFrame:
    """Whether any drug of the subject carries a class token.

    Tokens are matched once per drug, not once per prescription.
    """
    name = F.lower("drug_id")
    flagged = drugs.select("drug_key", *[
        F.coalesce(name.rlike("|".join(tokens)), F.lit(False)).cast("int").alias(c) for c, tokens in classes.items()])
    per_pair = rx.groupBy("user_id", "drug_key").agg(F.count(F.lit(1)).alias("n"))
    g = per_pair.join(flagged, "drug_key", "left").groupBy("user_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in classes])
    return g.withColumn("antidepressant", F.col("ssri")) if "ssri" in classes else g


def assemble(actigraphy: DataFrame, scores: DataFrame, medications: DataFrame) -> DataFrame:
    """Distinct subjects with their score and flags; missing flags are 0, missing scores stay null."""
    flags = [c for c in medications.columns if c in ("benzodiazepine", "ssri")]
    return (
        actigraphy.select("user_id").distinct().join(scores, "user_id", "left")
        .join(medications, "user_id", "left").na.fill(0, flags)
    )


def sliding_sequences(actigraphy: DataFrame, size: int = 60, stride: int = 30, label: Column | None = None) -> DataFrame:
    """Windows of ``size`` minutes every ``stride`` minutes in (day, minute) order; short tails are dropped.

    ``label`` is read from the middle row of each window; without one it is null.

    Positions come from hour counts plus the place inside the hour, so no task
    orders a whole subject.
    """
    hour = F.col("day").cast("long") * 1_000_000 + F.floor(F.col("minute_no") / 60)
    rows = O.ordered_scan(
        actigraphy, ["user_id"], hour, ["day", "minute_no"], pos=O.running_sum(F.lit(1))
    ).withColumn("pos", F.col("pos") - 1)
    last = F.floor(F.col("pos") / stride)
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / stride))
    return (
        rows.select("user_id", "pos", "intensity", (F.lit(None) if label is None else label).alias("label"), F.explode(F.sequence(first, last)).alias("window_no"))
        .groupBy("user_id", "window_no")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "intensity", "label"))).alias("v"))
        .filter(F.size("v") == size)
        .select("user_id", "window_no", F.transform("v", lambda x: x.intensity).alias("sequence"),
                F.get("v", F.lit(size // 2))["label"].alias("label"))
    )


# ---- labels ----------------------------------------------------------------------

def label_agreement(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per-day labels beside the prediction of the day; no prediction leaves the flag null."""
    return labels.join(predictions, ["user_id", "date"], "left").withColumn(
        "model_agreed", F.col("label") == F.col("predicted"))


def label_stats(episodes: DataFrame) -> DataFrame:
    """Counts, share, span, duration and severity by type; raters as a count of distinct names."""
    days = F.datediff("end_date", "start_date") + 1
    g = episodes.groupBy("episode_type").agg(
        F.count(F.lit(1)).alias("labels"), F.countDistinct("rater_id").alias("raters"),
        F.min("start_date").alias("first_day"), F.max("end_date").alias("last_day"),
        F.avg(days).alias("avg_days"), F.min(days).alias("min_days"), F.max(days).alias("max_days"),
        F.avg("severity").alias("avg_severity"))
    # the grouped table has one row per episode type
    return g.withColumn("percent", F.col("labels") / F.sum("labels").over(W.partitionBy()) * 100)


def rater_names(episodes: DataFrame) -> DataFrame:
    return episodes.select("episode_type", "rater_id").distinct()


def duration_check(episodes: DataFrame) -> DataFrame:
    """Whether each label lasts as long as its type requires."""
    table = {**S.REQUIRED_DAYS, "mixed": 7}
    needed = F.coalesce(E.lookup({k: str(v) for k, v in table.items()}, F.col("episode_type")).cast("int"), F.lit(1))
    days = F.datediff("end_date", "start_date") + 1
    return episodes.select("*", days.alias("days"), needed.alias("required_days"),
                           (days >= needed).alias("is_long_enough"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """Latest row per key; a struct maximum combines before the shuffle, unlike a ranked window."""
    rows = stored.unionByName(incoming)
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def once_per_date(rows: DataFrame, order: list[Column]) -> DataFrame:
    """First row per (user, date) in the given order."""
    rest = [c for c in rows.columns if c not in ("user_id", "date")]
    g = rows.groupBy("user_id", "date").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return g.select("user_id", "date", *[F.col(f"_r.{c}").alias(c) for c in rest])


def without_listed(candidates: DataFrame, listed: DataFrame, by: list[str], name: str = "treatment") -> DataFrame:
    """Candidates whose lower-cased name is not on the list of the same keys."""
    low = listed.select(*by, F.lower(name).alias("_low")).distinct()
    return candidates.withColumn("_low", F.lower(name)).join(low, [*by, "_low"], "left_anti").drop("_low")


# ---- baselines -------------------------------------------------------------------

def snapshots(state: DataFrame, feature: str) -> DataFrame:
    """State rows as stored baseline rows; the effective time is midnight after the date."""
    return state.select(
        "user_id", F.col("date").alias("as_of"), F.lit(feature).alias("feature_name"), "mean", "std", "n",
        (F.date_add("date", 1)).cast("timestamp_ntz").alias("effective_ts"))


def latest_snapshot(baselines: DataFrame) -> DataFrame:
    keys = ["user_id", "feature_name"]
    g = baselines.groupBy(*keys).agg(
        F.max_by(F.struct("as_of", "mean", "std", "n"), F.struct("as_of", "effective_ts")).alias("b"))
    return g.select(*keys, "b.*")


def as_of(daily: DataFrame, baselines: DataFrame) -> DataFrame:
    """Latest snapshot at or before each date: both sides are distinct per (user, day)."""
    marks = baselines.groupBy("user_id", F.col("as_of").alias("date")).agg(
        F.max_by(F.struct("as_of", "mean", "std"), "effective_ts").alias("b"))
    w = W.partitionBy("user_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    both = daily.withColumn("_asked", F.lit(True)).join(marks, ["user_id", "date"], "full")
    both = both.withColumn("b", F.last("b", True).over(w)).filter("_asked").drop("_asked")
    return both.select(*daily.columns, F.col("b.as_of").alias("baseline_date"), F.col("b.mean").alias("baseline_mean"),
                       F.col("b.std").alias("baseline_std"))


def as_known(requests: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """The version that was valid at ``date`` as it was known at ``known_at``, for each request.

    versions: an append-only table with ``as_of`` (from when it is valid) and ``effective_ts`` (when
    it became known); a correction is a later row for the same ``as_of``. Wanted is the latest
    ``as_of`` up to the date, and of that the latest row, among what was known by then.

    No history is sorted. Versions lie in blocks of one month of ``as_of``; a block's summary is
    when anything in it was first known. A request meets its own month and at most one earlier
    one, the last in which something was known, so a version meets only requests of its block.
    Requests without an answer have nulls.
    """
    asked = [*keys, "date", "known_at"]
    month = lambda c: F.trunc(c, "month")
    rest = [c for c in versions.columns if c not in (*keys, "as_of", "effective_ts")]
    v = versions.select(*keys, month("as_of").alias("_block"), "as_of", "effective_ts", F.struct(*rest).alias("_rest"))
    blocks = v.groupBy(*keys, "_block").agg(F.min("effective_ts").alias("first_known"))
    summary = blocks.groupBy(*keys).agg(F.collect_list(F.struct("_block", "first_known")).alias("_blocks"))
    known = lambda b: (b["_block"] < month(F.col("date"))) & (b["first_known"] <= F.col("known_at"))
    before = F.array_max(F.transform(F.filter("_blocks", known), lambda b: b["_block"]))
    wanted = requests.select(*asked).distinct().join(summary, keys).select(
        *asked, F.explode(F.array_compact(F.array(month("date"), before))).alias("_block"))
    found = wanted.join(v, [*keys, "_block"]).filter("as_of <= date AND effective_ts <= known_at")
    best = found.groupBy(*asked).agg(F.max_by(F.struct("as_of", "effective_ts", "_rest"), F.struct("as_of", "effective_ts")).alias("_b"))
    return requests.join(best, asked, "left").select(
        *requests.columns, "_b.as_of", "_b.effective_ts", *[F.col(f"_b._rest.{c}").alias(c) for c in rest])


def baseline_history(baselines: DataFrame, features: dict[str, float], limit: int = 10, latest: bool = False) -> DataFrame:
    """First (or last) ``limit`` snapshot dates per user with the metrics side by side."""
    order = F.col("as_of").desc() if latest else F.col("as_of").asc()
    wide = baselines.groupBy("user_id", "as_of").agg(*[
        F.coalesce(F.max(F.when(F.col("feature_name") == f, F.col("mean"))), F.lit(d)).alias(f"{f}_mean")
        for f, d in features.items()])
    return wide.withColumn("nth", F.row_number().over(W.partitionBy("user_id").orderBy(order))).filter(
        F.col("nth") <= limit)


def baseline_buckets(rows: DataFrame, until: Column, window_days: int = 30) -> DataFrame:
    """Day buckets of the last ``window_days`` days per user and metric."""
    recent = rows.filter((F.col("as_of") > F.date_sub(until, window_days)) & (F.col("as_of") <= until))
    return recent.groupBy("user_id", "feature_name", F.col("as_of").alias("bucket")).agg(
        F.avg("mean").alias("avg_value"), F.stddev_samp("mean").alias("std_value"), F.count(F.lit(1)).alias("n"),
        F.max("effective_ts").alias("latest"))


def long_snapshot(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per metric, ready to append."""
    return wide.unpivot(["user_id", "as_of"], metrics, "feature_name", "value")


# ---- personal calibration ----------------------------------------------------------

def sleep_baseline(nights: DataFrame, size: int = 30) -> DataFrame:
    recent = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("date"))) <= size
    return nights.withColumn("_recent", recent).filter("_recent").groupBy("user_id").agg(
        F.avg("sleep_hours").alias("mean_sleep"), F.stddev_samp("sleep_hours").alias("std_sleep"),
        F.avg("efficiency").alias("mean_efficiency"), F.avg(F.col("bedtime_minute") / 60).alias("mean_onset"))


def _hour_table(activity: DataFrame) -> DataFrame:
    return activity.groupBy("user_id", F.hour("start_ts").alias("hour")).agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))


def _peak() -> Column:
    """Busiest hour, the earliest on a tie."""
    return F.max_by("hour", F.struct(F.round("m", 9), -F.col("hour"))).cast("double")


def activity_baseline(activity: DataFrame, size: int = 30) -> DataFrame:
    daily = activity.groupBy("user_id", F.to_date("start_ts").alias("date")).agg(F.sum("value").alias("v"))
    recent = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("date"))) <= size
    level = daily.withColumn("_recent", recent).filter("_recent").groupBy("user_id").agg(
        F.avg("v").alias("mean_daily_activity"))
    shape = _hour_table(activity).groupBy("user_id").agg(
        F.stddev_samp("m").alias("activity_rhythm"), _peak().alias("peak_hour"),
        (F.max("m") - F.min("m")).alias("amplitude"))
    return level.join(shape, "user_id")


def circadian_baseline(activity: DataFrame) -> DataFrame:
    """Peak hour, amplitude and one minus the mean hourly CV (hours with one reading have none)."""
    cv = F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0)
    return _hour_table(activity).groupBy("user_id").agg(
        _peak().alias("circadian_phase"), (F.max("m") - F.min("m")).alias("circadian_amplitude"),
        (1 - F.avg(cv)).alias("circadian_stability"))


def deviations(daily: DataFrame, baseline: DataFrame, default_std: float = 30.0) -> DataFrame:
    """z of sleep and percent change of activity against the user's own baseline."""
    std = F.coalesce("std_sleep", F.lit(default_std))
    return daily.join(baseline, "user_id").select(
        "user_id", "date",
        F.when(std != 0, (F.col("sleep_hours") - F.col("mean_sleep")) / std).alias("sleep_z"),
        F.when(F.col("mean_daily_activity") != 0,
               (F.col("activity") - F.col("mean_daily_activity")) / F.col("mean_daily_activity") * 100)
        .alias("activity_change_pct"))
