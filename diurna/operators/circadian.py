"""Minute sequences, hourly rhythm metrics and weekly sequences.

Records are summed to (user, date, minute) or to 24 hour columns per (user,
date) first, so everything that follows works on groups the clock bounds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diurna.functions import exprs as E
from diurna.operators.rolling import days

KEY = ["user_id", "date"]
HOURS = range(24)
MINUTES_PER_DAY = 1440


# ---- minutes -----------------------------------------------------------------

def minute_totals(activity: DataFrame) -> DataFrame:
    """Steps by the minute a record starts in; only minutes with steps are kept."""
    return (
        activity.filter((F.col("activity_type") == "STEP_COUNT") & (F.col("value") > 0))
        .select("user_id", F.to_date("start_ts").alias("date"),
                (F.hour("start_ts") * 60 + F.minute("start_ts")).alias("minute"), "value")
        .groupBy(*KEY, "minute").agg(F.sum("value").alias("value"))
    )


def spread_minutes(activity: DataFrame) -> DataFrame:
    """Each value split evenly over the minutes it spans, first and last included, of every record."""
    def minute(ts: str) -> Column:
        return F.floor(E.micros(ts) / float(E.MINUTE_US)).cast("long")

    return (
        activity.select("user_id", "value", minute("start_ts").alias("a"),
                        F.greatest(minute("start_ts"), minute("end_ts")).alias("b"))
        .select("user_id", (F.col("value") / (F.col("b") - F.col("a") + 1)).alias("share"),
                F.explode(F.sequence("a", "b")).alias("m"))
        .groupBy("user_id", "m").agg(F.sum("share").alias("value"))
        .select("user_id", F.date_from_unix_date(F.floor(F.col("m") / MINUTES_PER_DAY).cast("int")).alias("date"),
                F.pmod("m", F.lit(MINUTES_PER_DAY)).cast("int").alias("minute"), "value")
    )


def sequence_stats(minutes: DataFrame, percent: int = 99) -> DataFrame:
    """Totals of the 1440-minute day; the percentile counts the silent minutes as zeros."""
    at = MINUTES_PER_DAY * percent // 100
    silent = MINUTES_PER_DAY - F.size("v")
    g = minutes.groupBy(*KEY).agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("active_minutes"),
        F.max("value").alias("max_minute"), F.array_sort(F.collect_list("value")).alias("v"))
    level = F.when(silent <= at, F.get("v", F.lit(min(at, MINUTES_PER_DAY - 1)) - silent)).otherwise(0.0)
    return g.select(*KEY, "total", "active_minutes", "max_minute", level.alias(f"p{percent}"))


def principal_time(minutes: DataFrame) -> DataFrame:
    """Centre of mass of the day and the activity of its four quarters."""
    v, m = F.col("value"), F.col("minute")

    def part(a: int, b: int) -> Column:
        return F.coalesce(F.sum(F.when((m >= a * 60) & (m < b * 60), v)), F.lit(0.0))

    g = minutes.groupBy(*KEY).agg(
        F.floor(F.sum(m * v) / F.sum(v) + 1e-9).cast("int").alias("pat_minute"),
        part(6, 12).alias("morning"), part(12, 18).alias("afternoon"),
        part(18, 24).alias("evening"), part(0, 6).alias("night"))
    return g.select("*", (F.col("pat_minute") / 60.0).alias("pat_hour"),
                    (F.col("evening") > F.col("morning")).alias("is_evening_type"))


def concentration(minutes: DataFrame) -> DataFrame:
    """One minus the normalised entropy of the active hours."""
    hours = minutes.groupBy(*KEY, F.floor(F.col("minute") / 60).alias("hour")).agg(F.sum("value").alias("v"))
    share = F.col("v") / F.sum("v").over(W.partitionBy(*KEY))
    g = hours.select(*KEY, share.alias("p")).groupBy(*KEY).agg(
        (-F.sum(F.col("p") * F.ln("p"))).alias("h"), F.count(F.lit(1)).alias("k"))
    return g.select(*KEY, F.when(F.col("k") == 1, 1.0).otherwise(
        E.clamp(1 - F.col("h") / F.ln("k"), 0, 1)).alias("concentration"))


def rest_alignment(days_with_data: DataFrame, minutes: DataFrame, start: int = 23, end: int = 7) -> DataFrame:
    """Share of activity outside the expected sleep hours; a silent day is fully aligned."""
    resting = F.when(E.in_sleep_hours(F.floor(F.col("minute") / 60), start, end), F.col("value"))
    g = minutes.groupBy(*KEY).agg((1 - F.coalesce(F.sum(resting), F.lit(0.0)) / F.sum("value")).alias("score"))
    return days_with_data.join(g, KEY, "left").select(
        *KEY, E.clamp(F.coalesce("score", F.lit(1.0)), 0, 1).alias("alignment"))


def longest_active_run(minutes: DataFrame) -> DataFrame:
    """Longest stretch of minutes at or above half the mean active minute."""
    day = W.partitionBy(*KEY)
    busy = minutes.withColumn("floor", F.avg("value").over(day) * 0.5).filter(
        F.col("value") >= F.col("floor"))
    island = F.col("minute") - F.row_number().over(day.orderBy("minute"))
    return (
        busy.withColumn("island", island).groupBy(*KEY, "island").agg(F.count(F.lit(1)).alias("len"))
        .groupBy(*KEY).agg(F.max("len").alias("longest_run"))
    )


def smoothed(minutes: DataFrame, width: int = 5) -> DataFrame:
    """Centred moving average of the dense day; minutes without activity nearby are not stored."""
    half = width // 2
    t = F.col("minute") + F.col("shift")
    size = F.least(t + half, F.lit(MINUTES_PER_DAY - 1)) - F.greatest(t - half, F.lit(0)) + 1
    return (
        minutes.select("*", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("shift"))
        .filter((t >= 0) & (t < MINUTES_PER_DAY))
        .select(*KEY, t.alias("minute"), (F.col("value") / size).alias("value"))
        .groupBy(*KEY, "minute").agg(F.sum("value").alias("smoothed"))
    )


# ---- hours -------------------------------------------------------------------

def hourly_wide(activity: DataFrame) -> DataFrame:
    """Step totals of every day that has activity of any type, one column per start hour."""
    is_step = F.col("activity_type") == "STEP_COUNT"
    # one sum per record, then the turn to columns over at most 24 rows per day
    hours = activity.groupBy("user_id", F.to_date("start_ts").alias("date"), F.hour("start_ts").alias("h")).agg(
        F.sum(F.when(is_step, F.col("value"))).alias("v"))
    return hours.groupBy(*KEY).agg(*[
        F.coalesce(F.sum(F.when(F.col("h") == h, F.col("v"))), F.lit(0.0)).alias(f"h{h}") for h in HOURS])


def hour_array() -> Column:
    return F.array(*[F.col(f"h{h}") for h in HOURS])


def circular_means(prefix: str, width: int) -> Column:
    """Mean of every circular block of ``width`` hours of the columns ``prefix0..23``, by start hour."""
    def block(start: int) -> str:
        return " + ".join(f"{prefix}{(start + i) % 24}" for i in range(width))

    return F.expr("array(" + ", ".join(f"round(({block(h)}) / {width}D, 9)" for h in HOURS) + ")")


def _first(values: Column, wanted: Column) -> Column:
    return (F.array_position(values, wanted) - 1).cast("int")


def _prepared(wide: DataFrame) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("date")
    add = lambda term, hours=HOURS: F.expr(" + ".join(term.format(i=i, j=i + 1) for i in hours))
    before = F.last("h23", True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = wide.select(
        "*", add("h{i}").alias("sum_x"), add("h{i} * h{i}").alias("sum_xx"),
        add("(h{j} - h{i}) * (h{j} - h{i})", range(23)).alias("inner_sq"),
        before.alias("before"), circular_means("h", 5).alias("low"))
    turn = F.lit(2 * 3.141592653589793 / 24)
    rows = rows.withColumn("angle", _first(F.col("low"), F.array_min("low")) * turn)
    present = F.col("h0").isNotNull()
    step = F.col("h0") - F.col("before")
    return rows.select(
        *wide.columns, "sum_x", "sum_xx", "inner_sq", F.when(present, step * step).alias("cross_sq"),
        F.when(present, F.sin("angle")).alias("l5_sin"), F.when(present, F.cos("angle")).alias("l5_cos"))


def _rhythm_inputs(over: Callable[[Column], Column]) -> list[Column]:
    first_cross = F.min_by("cross_sq", F.when(F.col("h0").isNotNull(), F.col("date")))
    return [
        over(F.count("h0")).alias("n"),
        *[F.round(over(F.avg(f"h{h}")), 6).alias(f"p{h}") for h in HOURS],
        over(F.sum("sum_x")).alias("sx"), over(F.sum("sum_xx")).alias("sxx"),
        (over(F.sum("inner_sq")) + F.coalesce(over(F.sum("cross_sq")), F.lit(0.0))
         - F.coalesce(over(first_cross), F.lit(0.0))).alias("sq"),
        over(F.sum("l5_sin")).alias("ss"), over(F.sum("l5_cos")).alias("cc"),
    ]


def _rhythm(inputs: DataFrame, keys: list[str]) -> DataFrame:
    n, cells = F.col("n"), F.col("n") * 24
    mean = F.col("sx") / cells
    var = F.greatest(F.col("sxx") / cells - mean * mean, F.lit(0.0))
    df = inputs.filter(n > 0).select(
        *keys, "n", "sq", "ss", "cc", F.round(var, 6).alias("var"), cells.alias("cells"),
        F.array(*[F.col(f"p{h}") for h in HOURS]).alias("profile"),
        circular_means("p", 5).alias("low"), circular_means("p", 10).alias("high"))
    p = F.col("profile")
    centre = E.vector_mean(p)
    profile_var = F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x) / 24 - centre * centre
    df = df.select("*", profile_var.alias("profile_var"))
    df = df.select("*", F.array_min("low").alias("l5_value"), F.array_max("high").alias("m10_value"))
    both = F.col("l5_value") + F.col("m10_value")
    return df.select(
        *keys, F.col("n").alias("days"),
        E.ladder((n < 2, F.lit(0.0)), (F.col("var") == 0, F.lit(1.0)),
                 otherwise=E.clamp(F.col("profile_var") / F.col("var"), 0, 1)).alias("interdaily_stability"),
        F.when(F.col("var") == 0, 0.0).otherwise(F.col("sq") / (F.col("cells") - 1) / F.col("var"))
        .alias("intradaily_variability"),
        F.when(both == 0, 0.0).otherwise(E.clamp((F.col("m10_value") - F.col("l5_value")) / both, 0, 1))
        .alias("relative_amplitude"),
        "l5_value", _first(F.col("low"), F.col("l5_value")).alias("l5_start"),
        "m10_value", _first(F.col("high"), F.col("m10_value")).alias("m10_start"),
        F.when(n < 3, 0.5).otherwise(F.sqrt(F.col("ss") ** 2 + F.col("cc") ** 2) / n)
        .alias("l5_consistency"), "profile",
    )


def rhythm(wide: DataFrame) -> DataFrame:
    """Stability, variability, amplitude and rest/activity blocks over all days of each user."""
    inputs = _prepared(wide).groupBy("user_id").agg(*_rhythm_inputs(lambda c: c))
    return _rhythm(inputs, ["user_id"])


def lookback_rhythm(wide: DataFrame, dates: DataFrame, size: int = 7, least: int = 3,
                    beside: dict[str, Column] | None = None) -> DataFrame:
    """The same metrics for every given date over its last ``size`` calendar days.

    beside: further columns over the dense days, which may name other columns of ``wide``.
    """
    w, beside = days(-(size - 1)), beside or {}
    dense = _prepared(dates.select(*KEY).join(wide, KEY, "left"))
    inputs = dense.select(*KEY, *[c.alias(n) for n, c in beside.items()], *_rhythm_inputs(lambda c: c.over(w)))
    return _rhythm(inputs.filter(F.col("n") >= least), [*KEY, *beside])


def phase_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Difference of the busiest block's start between two periods, wrapped to half a day."""
    a = rhythm(before).select("user_id", F.col("m10_start").alias("a"))
    b = rhythm(after).select("user_id", F.col("m10_start").alias("b"))
    d = F.col("b") - F.col("a")
    return a.join(b, "user_id").select(
        "user_id", E.ladder((d > 12, d - 24), (d < -12, d + 24), otherwise=d).cast("double").alias("shift_hours"))


def disruption(metrics: DataFrame) -> DataFrame:
    """One minus the mean of the four rhythm scores; fewer than three days use neutral ones."""
    few = F.col("days") < 3
    pick = lambda c, d: F.when(few, d).otherwise(F.col(c))
    good = (pick("interdaily_stability", 0.5)
            + (1 - F.least(pick("intradaily_variability", 1.0) / 2, F.lit(1.0)))
            + pick("relative_amplitude", 0.5) + pick("l5_consistency", 0.5)) / 4
    return metrics.select("user_id", E.clamp(1 - good, 0, 1).alias("disruption"))


# ---- weeks ---------------------------------------------------------------------

def user_calendar(*frames: DataFrame) -> DataFrame:
    """Every date between the first and last date of each user over the given daily frames."""
    spans = reduce(lambda a, b: a.unionByName(b), [
        f.groupBy("user_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi")) for f in frames])
    return spans.groupBy("user_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(
        "user_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))


def weekly_features(minutes: DataFrame, calendar: DataFrame, top: int = 1008) -> DataFrame:
    """Features of the 10,080-minute week ending on each calendar date, from sparse minutes.

    The peak is the mean of the ``top`` busiest minutes, a tenth of the week. A day's busiest
    minutes are one sorted array, and those of a week are chosen from its seven arrays, so
    minutes are never copied to the weeks that they lie in.
    """
    m, v = F.col("minute"), F.col("value")
    gap = m - F.lag("minute").over(W.partitionBy(*KEY).orderBy("minute"))
    per_day = minutes.withColumn("opens", gap.isNull() | (gap > 1)).groupBy(*KEY).agg(
        F.sum("value").alias("total"), F.sum(v * F.floor(m / 60)).alias("hour_mass"),
        F.count(F.lit(1)).alias("active"), F.count_if("opens").alias("runs"),
        F.slice(F.sort_array(F.collect_list("value"), False), 1, top).alias("busiest"),
        F.max(F.when(m == 0, 1).otherwise(0)).alias("head"),
        F.max(F.when(m == MINUTES_PER_DAY - 1, 1).otherwise(0)).alias("tail"))
    dense = calendar.join(per_day, KEY, "left").na.fill(0)
    order = W.partitionBy("user_id").orderBy("date")
    day = F.unix_date("date")
    dense = dense.select(
        *KEY, "total", "active", "busiest", day.alias("day"), (F.col("hour_mass") + F.col("total") * day * 24).alias("mass"),
        (2 * F.col("runs") - F.col("head") - F.col("tail")).alias("flips"),
        (F.coalesce(F.lag("tail").over(order), F.lit(0)) != F.col("head")).cast("int").alias("seam"))
    week, seams = order.rowsBetween(-6, 0), order.rowsBetween(-5, 0)
    total = F.sum("total").over(week)
    return dense.select(
        *KEY, total.alias("total_activity"), F.sum("active").over(week).alias("active_minutes"),
        F.when(total > 0, F.pmod(F.round(F.sum("mass").over(week) / total - (F.col("day") - 6) * 24, 6), F.lit(24.0)))
        .otherwise(0.0).alias("pat_hour"),
        ((F.sum("flips").over(week) + F.sum("seam").over(seams)) / 10080.0).alias("fragmentation"),
        (F.sum((F.col("total") > 0).cast("int")).over(week) / 7.0).alias("quality"),
        F.flatten(F.collect_list("busiest").over(week)).alias("busiest")).withColumn(
        "peak_activity", F.aggregate(F.slice(F.sort_array("busiest", False), 1, top), F.lit(0.0), lambda a, x: a + x) / top).drop("busiest")


def weekly_sequences(minutes: DataFrame, calendar: DataFrame, stride_days: int = 1) -> DataFrame:
    """The dense week per end date as an array, with its missing days and quality.

    Days are folded to 1440-vectors first; a week joins seven of them, so no
    task sees more than one user's calendar.
    """
    zero = F.array_repeat(F.lit(0.0), MINUTES_PER_DAY)
    per_day = minutes.groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("minute", F.col("value")))).alias("m")
    ).select(*KEY, F.transform(
        F.sequence(F.lit(0), F.lit(MINUTES_PER_DAY - 1)),
        lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))
    week = W.partitionBy("user_id").orderBy("date").rowsBetween(-6, 0)
    seen = F.row_number().over(W.partitionBy("user_id").orderBy("date"))
    rows = calendar.join(per_day, KEY, "left").select(
        *KEY, seen.alias("nth"), F.collect_list(F.coalesce("v", zero)).over(week).alias("days"),
        F.collect_list(F.when(F.col("v").isNull(), F.col("date"))).over(week).alias("missing_days"))
    return rows.filter((F.col("nth") >= 7) & ((F.col("nth") - 7) % stride_days == 0)).select(
        *KEY, F.flatten("days").alias("activity"), "missing_days",
        (1 - F.size("missing_days") / 7.0).alias("quality"))


# ---- cohort ----------------------------------------------------------------------

def cohort_circadian(daily: DataFrame) -> DataFrame:
    """Subject features over ordered daily totals (at most one row per subject and day)."""
    order = W.partitionBy("user_id").orderBy("day")
    by_size = W.partitionBy("user_id").orderBy("total_activity")
    whole = W.partitionBy("user_id")
    x = F.col("total_activity")
    r = daily.select("user_id", x, (F.row_number().over(order) - 1).alias("i"),
                     (x - F.lag(x).over(order)).alias("step"), F.row_number().over(by_size).alias("nth"),
                     F.count(F.lit(1)).over(whole).alias("n"))
    slots = r.groupBy("user_id", F.pmod("i", F.lit(24)).alias("slot")).agg(F.avg(x).alias("m"))
    between = slots.groupBy("user_id").agg((F.var_pop("m") * F.count(F.lit(1))).alias("between"))
    g = r.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("days"), F.var_pop(x).alias("var"), F.avg(F.col("step") * F.col("step")).alias("msd"),
        F.avg(F.when(F.col("nth") <= F.floor(F.col("n") / 5), x)).alias("l5"),
        F.avg(F.when(F.col("nth") > F.col("n") - F.ceil(F.col("n") / 10), x)).alias("m10"))
    both = F.col("m10") + F.col("l5")
    has = F.col("var") > 1e-9
    return g.join(between, "user_id").select(
        "user_id", "days",
        F.when(has, F.col("between") / (F.col("var") * F.col("days"))).otherwise(0.0).alias("stability"),
        F.when(has, F.col("msd") / F.col("var")).otherwise(0.0).alias("variability"),
        F.when(both > 0, (F.col("m10") - F.col("l5")) / both).otherwise(0.0).alias("amplitude"), "l5", "m10")
