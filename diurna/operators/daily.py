"""Daily aggregations: records to one row per (user, date).

All of these are hash aggregates with map-side partial results, so a user or a
user-day holding a large share of the rows is reduced before it is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diurna.functions import exprs as E

KEY = ["user_id", "date"]
HOUR = float(E.HOUR_US)
HOURS = range(24)


# ---- sleep -----------------------------------------------------------------

def sleep_date(start: str = "start_ts", end: str = "end_ts") -> Column:
    """Night a record belongs to: evening starts keep their date, early ones go back a day."""
    hour, day = F.hour(start), F.to_date(start)
    half = F.floor((E.micros(end) - E.micros(start)) / 2).cast("long")
    mid = E.from_micros(E.micros(start) + half)
    return E.ladder(
        (hour >= 18, day), (hour < 6, F.date_sub(day, 1)), (F.hour(mid) >= 12, F.to_date(mid)),
        otherwise=F.date_sub(F.to_date(mid), 1),
    )


def with_sleep_date(sleep: DataFrame) -> DataFrame:
    return sleep.withColumn("date", sleep_date())


def daily_sleep(sleep: DataFrame) -> DataFrame:
    """Nightly summary.

    The gaps between sessions telescope: with sessions in start order their sum
    is (sum of starts - first start) - (sum of ends - last end), so the
    fragmentation index needs no sort.
    """
    start, end = E.micros("start_ts"), E.micros("end_ts")
    asleep = E.is_asleep()
    midnight = F.unix_date("date") * F.lit(E.DAY_US)
    rows = with_sleep_date(sleep).select(
        *KEY, "rec_id",
        (start - midnight).alias("s"), (end - midnight).alias("e"), (end - start).alias("d"),
        asleep.alias("asleep"),
        E.clock_us("start_ts").alias("bed"), E.clock_us("end_ts").alias("wake"),
    )
    s, e, d = F.col("s"), F.col("e"), F.col("d")
    zz = F.col("asleep")
    rows = rows.groupBy(*KEY).agg(
        F.sum(d).alias("bed_us"),
        F.coalesce(F.sum(F.when(zz, d)), F.lit(0)).alias("sleep_us"),
        F.count_if(zz).alias("sleep_sessions"),
        F.coalesce(F.max(F.when(zz, d)), F.lit(0)).alias("longest_us"),
        F.sum(F.when(zz, s)).alias("sum_s"), F.sum(F.when(zz, e)).alias("sum_e"),
        F.min(F.when(zz, s)).alias("first_s"),
        F.max_by(e, F.when(zz, F.struct(s, e))).alias("last_e"),
        (F.min("bed") / E.MINUTE_US).alias("bedtime_minute"),
        (F.max("wake") / E.MINUTE_US).alias("wake_minute"),
        F.max(F.struct(d, -s, -F.col("rec_id"))).alias("main"),
    )
    gap = (F.col("sum_s") - F.col("first_s")) - (F.col("sum_e") - F.col("last_e"))
    period = F.col("last_e") - F.col("first_s")
    main_start, main_len = -F.col("main.col2"), F.col("main.d")
    return rows.select(
        *KEY,
        (F.col("bed_us") / HOUR).alias("bed_hours"),
        (F.col("sleep_us") / HOUR).alias("sleep_hours"),
        E.ratio(F.col("sleep_us"), F.col("bed_us")).alias("efficiency"),
        "sleep_sessions",
        (F.col("longest_us") / HOUR).alias("longest_hours"),
        F.when((F.col("sleep_sessions") > 1) & (period > 0), gap / period)
        .otherwise(0.0).alias("fragmentation"),
        "bedtime_minute", "wake_minute",
        ((main_start + main_len / 2) / E.MINUTE_US).alias("mid_sleep_minute"),
    )


def sleep_flags(nights: DataFrame) -> DataFrame:
    return nights.withColumn(
        "is_significant",
        (F.col("sleep_hours") < 4) | (F.col("sleep_hours") > 10)
        | (F.col("efficiency") < 0.70) | (F.col("fragmentation") > 0.3),
    )


def onset_and_wake(nights: DataFrame) -> DataFrame:
    """Wall-clock onset on the date; wake before noon belongs to the next day."""
    def at(day: Column, minute: Column) -> Column:
        us = F.unix_date(day) * F.lit(E.DAY_US) + F.round(minute * E.MINUTE_US).cast("long")
        return E.from_micros(us)

    wake = F.col("wake_minute")
    next_day = F.date_add("date", 1)
    return nights.select(
        *KEY,
        at(F.col("date"), F.coalesce("bedtime_minute", F.lit(23 * 60.0))).alias("onset_ts"),
        E.ladder(
            (wake.isNull(), at(next_day, F.lit(7 * 60.0))), (wake < 12 * 60, at(next_day, wake)),
            otherwise=at(F.col("date"), wake),
        ).alias("wake_ts"),
    )


# ---- activity --------------------------------------------------------------

def _dated(activity: DataFrame) -> DataFrame:
    return activity.withColumn("date", F.to_date("start_ts"))


def deduped_steps(activity: DataFrame) -> DataFrame:
    """Same period reported by several sources counts once, with the largest value."""
    return (
        _dated(activity).filter(F.col("activity_type") == "STEP_COUNT")
        .groupBy(*KEY, "start_ts", "end_ts").agg(F.max("value").alias("value"))
        .groupBy(*KEY).agg(F.sum("value").alias("steps"))
    )


def _hourly_rates(activity: DataFrame) -> DataFrame:
    """Rate of each record added to every clock hour from its start hour to its end hour."""
    first, last = F.hour("start_ts"), F.hour("end_ts")
    instant = F.col("start_ts") == F.col("end_ts")
    return (
        _dated(activity)
        .select(*KEY, E.intensity_per_hour().alias("rate"), first.alias("first"),
                F.when(instant, first).otherwise(last).alias("last"))
        .filter(F.col("first") <= F.col("last"))
        .select(*KEY, "rate", F.explode(F.sequence("first", "last")).alias("hour"))
        .groupBy(*KEY, "hour").agg(F.sum("rate").alias("rate"))
    )


def peak_hours(activity: DataFrame) -> DataFrame:
    """Busiest clock hour; a tie goes to the earlier hour."""
    rate = F.round("rate", 6)
    return _hourly_rates(activity).groupBy(*KEY).agg(
        F.max_by("hour", F.struct(rate, -F.col("hour"))).alias("peak_hour")
    )


def daily_activity(activity: DataFrame) -> DataFrame:
    kind, value = F.col("activity_type"), F.col("value")
    rate, hours = E.intensity_per_hour(), E.hours_between("start_ts", "end_ts")

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(kind == name, value)), F.lit(0.0))

    spread = E.ratio(F.stddev_pop("rate"), F.avg("rate"))
    base = (
        _dated(activity).withColumn("rate", rate).withColumn("hours", hours)
        .groupBy(*KEY).agg(
            total("ACTIVE_ENERGY").alias("energy"), total("DISTANCE_WALKING").alias("distance"),
            total("FLIGHTS_CLIMBED").alias("flights"), F.count(F.lit(1)).alias("sessions"),
            F.when(F.count(F.lit(1)) >= 2, F.least(spread / 1.5, F.lit(1.0)))
            .otherwise(0.0).alias("variance"),
            F.coalesce(F.sum(F.when(F.col("rate") < 250, F.col("hours"))), F.lit(0.0)).alias("sedentary_hours"),
            F.coalesce(F.sum(F.when(F.col("rate") >= 250, F.col("hours"))), F.lit(0.0)).alias("active_hours"),
            (F.min(E.clock_us("start_ts")) / E.MINUTE_US).alias("first_minute"),
            (F.max(E.clock_us("start_ts")) / E.MINUTE_US).alias("last_minute"),
        )
    )
    return (
        base.join(deduped_steps(activity), KEY, "left")
        .join(peak_hours(activity), KEY, "left")
        .withColumn("steps", F.coalesce("steps", F.lit(0.0)))
    )


def activity_flags(days: DataFrame) -> DataFrame:
    steps, energy = F.col("steps"), F.col("energy")
    return days.select(
        *KEY,
        ((steps > 15000) | (energy > 600) | ((F.col("active_hours") > 18) & (steps > 10000)))
        .alias("is_high"),
        ((steps < 2000) | (energy < 100) | (F.col("sedentary_hours") > 20)).alias("is_low"),
        (F.col("variance") > 0.5).alias("is_erratic"),
    )


def hour_bins(activity: DataFrame) -> DataFrame:
    """Per day with activity of any type the steps of each start hour: ``h0..h23`` per hour they lasted,
    ``r0..r23`` as counted, and their sum."""
    is_step = F.col("activity_type") == "STEP_COUNT"
    hours = E.hours_between("start_ts", "end_ts")
    share = F.col("value") / F.greatest(F.lit(1.0), hours)
    # one pair of sums per record, then the turn to columns over at most 24 rows per day
    hourly = (
        _dated(activity)
        .select(*KEY, F.hour("start_ts").alias("hour"),
                F.when(is_step, share).alias("share"), F.when(is_step, F.col("value")).alias("raw"))
        .groupBy(*KEY, "hour").agg(F.sum("share").alias("share"), F.sum("raw").alias("raw"))
    )
    of = lambda c, h: F.coalesce(F.sum(F.when(F.col("hour") == h, F.col(c))), F.lit(0.0))
    return hourly.groupBy(*KEY).agg(
        F.coalesce(F.sum("raw"), F.lit(0.0)).alias("daily_steps"),
        *[of("share", h).alias(f"h{h}") for h in HOURS], *[of("raw", h).alias(f"r{h}") for h in HOURS])


def hourly_step_metrics(activity: DataFrame) -> DataFrame:
    """Steps in 24 start-hour bins; every metric is arithmetic over the 24 columns."""
    return step_metrics(hour_bins(activity))


def step_metrics(bins: DataFrame, *keep: str) -> DataFrame:
    """The metrics of `hour_bins`, with other columns of it as asked."""
    # rounding and mean are stages of their own: inlined, they would repeat in every term below
    binned = bins.select(*KEY, *keep, "daily_steps", *[F.round(f"h{i}", 9).alias(f"h{i}") for i in HOURS])
    binned = binned.withColumn("mean", F.expr("(" + " + ".join(f"h{i}" for i in HOURS) + ") / 24"))

    def total(term: str, hours=HOURS) -> Column:
        return F.expr(" + ".join(term.format(i=i, j=i + 1) for i in hours))

    counted = binned.select(
        *KEY, *keep, "daily_steps",
        (total("(h{i} - mean) * (h{i} - mean)") / 24).alias("activity_variance"),
        total("int(h{i} < 250)").alias("rest"), total("int(h{i} >= 1000)").alias("busy"),
        total("int((h{i} < 250) != (h{j} < 250))", range(23)).alias("flips"),
        (F.expr("int(h0 < 250)") + total("int(h{j} < 250 AND h{i} >= 250)", range(23))).alias("bouts"))
    active = 24 - F.col("rest")
    return counted.select(
        *KEY, *keep, "daily_steps", "activity_variance", F.col("rest").cast("double").alias("sedentary_hours"),
        (F.col("flips") / 23.0).alias("activity_fragmentation"),
        F.when(F.col("bouts") > 0, F.col("rest") / F.col("bouts")).otherwise(24.0).alias("sedentary_bout_mean"),
        F.when(active > 0, F.col("busy") / active).otherwise(0.0).alias("activity_intensity_ratio"))


# ---- heart -----------------------------------------------------------------

def daily_heart(heart: DataFrame) -> DataFrame:
    value, motion = F.col("value"), F.col("motion_context")
    is_hr, is_hrv = F.col("metric_type") == "HEART_RATE", F.col("metric_type") == "HRV_SDNN"
    hr, hrv = F.when(is_hr, value), F.when(is_hrv, value)
    hour = F.hour("ts")

    def quiet(lo: int, hi: int) -> Column:
        return F.avg(F.when(is_hr & (motion != "active") & (hour >= lo) & (hour < hi), value))

    zero = F.lit(0.0)
    days = heart.withColumn("date", F.to_date("ts")).groupBy(*KEY).agg(
        F.coalesce(F.avg(F.when(motion.isin("sedentary", "unknown"), hr)), zero).alias("avg_resting_hr"),
        F.coalesce(F.min(hr), zero).alias("min_hr"), F.coalesce(F.max(hr), zero).alias("max_hr"),
        F.coalesce(F.avg(hrv), zero).alias("avg_hrv"), F.coalesce(F.min(hrv), zero).alias("min_hrv"),
        F.count(hr).alias("hr_readings"), F.count(hrv).alias("hrv_readings"),
        F.count_if(E.is_high_heart_rate()).alias("high_episodes"),
        F.count_if(E.is_low_heart_rate()).alias("low_episodes"),
        F.coalesce(quiet(6, 9), zero).alias("morning_hr"),
        F.coalesce(quiet(18, 22), zero).alias("evening_hr"),
    )
    both = (F.col("morning_hr") != 0) & (F.col("evening_hr") != 0)
    return days.withColumn(
        "hr_range", F.when(both, F.abs(F.col("evening_hr") - F.col("morning_hr"))).otherwise(0.0)
    )


def heart_flags(days: DataFrame) -> DataFrame:
    def low(c: str) -> Column:
        return (F.col(c) > 0) & (F.col(c) < 20)

    spread = F.col("hr_range")
    flags = {
        "high_resting": F.col("avg_resting_hr") > 90,
        "low_hrv": low("avg_hrv") | low("min_hrv"),
        "abnormal_range": (spread != 0) & ((spread < 10) | (spread > 30)),
        "many_episodes": (F.col("high_episodes") > 10) | (F.col("low_episodes") > 5),
    }
    days = days.select(*KEY, *[f.alias(n) for n, f in flags.items()])
    return days.withColumn("is_significant", reduce(lambda a, b: a | b, [F.col(n) for n in flags]))


# ---- scalars of a day's record set -----------------------------------------

def activity_scalars(activity: DataFrame) -> DataFrame:
    return _dated(activity).groupBy(*KEY).agg(E.pop_var(F.col("value")).alias("value_variance"))


def heart_scalars(heart: DataFrame) -> DataFrame:
    return heart.withColumn("date", F.to_date("ts")).groupBy(*KEY).agg(
        (F.max("value") - F.min("value")).alias("value_range"),
        F.coalesce(
            F.min_by(F.hour("ts").cast("double"),
                     F.struct("value", "ts", "rec_id")), F.lit(4.0)
        ).alias("lowest_hour"),
    )


def episode_fragmentation(sleep: DataFrame) -> DataFrame:
    return sleep.withColumn("date", F.to_date("start_ts")).groupBy(*KEY).agg(
        F.least(F.lit(1.0), (F.count(F.lit(1)) - 1) / 3.0).alias("episode_fragmentation")
    )


def first_onset_and_wake(sleep: DataFrame) -> DataFrame:
    """Hour of the first record starting on the date and of the first one ending the day after."""
    order = F.struct("start_ts", "end_ts", "source_name", "rec_id")
    hour = lambda c: F.hour(c) + F.minute(c) / 60.0
    begins = sleep.groupBy("user_id", F.to_date("start_ts").alias("date")).agg(
        F.min_by(hour("start_ts"), order).alias("onset_hour")
    )
    ends = sleep.groupBy("user_id", F.date_sub(F.to_date("end_ts"), 1).alias("date")).agg(
        F.min_by(hour("end_ts"), order).alias("wake_hour")
    )
    return begins.join(ends, KEY, "full").select(
        *KEY, F.coalesce("onset_hour", F.lit(23.0)).alias("onset_hour"),
        F.coalesce("wake_hour", F.lit(7.0)).alias("wake_hour"),
    )


# ---- joins of the daily tables ----------------------------------------------

def join_summaries(nights: DataFrame, days: DataFrame, hearts: DataFrame) -> DataFrame:
    """Every date any sensor has; a missing sensor gives its defaults."""
    left = nights.select(*KEY, "sleep_hours", "efficiency", F.lit(True).alias("has_sleep"))
    mid = days.select(*KEY, "steps", "energy", F.lit(True).alias("has_activity"))
    right = hearts.select(*KEY, "avg_resting_hr", "avg_hrv", F.lit(True).alias("has_heart"))
    joined = left.join(mid, KEY, "full").join(right, KEY, "full")
    zero = ["sleep_hours", "efficiency", "steps", "energy", "avg_resting_hr", "avg_hrv"]
    return joined.select(
        *KEY, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in zero],
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_sleep", "has_activity", "has_heart")],
    )
