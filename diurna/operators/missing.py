"""Sensor alignment, gap filling and density of daily series.

Inputs are daily frames (one row per user and date), so each user's group is
bounded by the calendar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diurna import wording
from diurna.functions import exprs as E
from diurna.operators.circadian import user_calendar

KEY = ["user_id", "date"]
START, END = W.unboundedPreceding, W.unboundedFollowing


def prefixed(df: DataFrame, name: str, keys: list[str], suffix: str = "") -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{name}_{c}{suffix}") for c in df.columns if c not in keys])


def align_intersection(sensors: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Only the keys every sensor has."""
    return reduce(lambda a, b: a.join(b, keys), [prefixed(d, n, keys) for n, d in sensors.items()])


def align_union(sensors: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Every key any sensor has; what is missing stays null."""
    return reduce(lambda a, b: a.join(b, keys, "full"), [prefixed(d, n, keys) for n, d in sensors.items()])


def to_daily(records: DataFrame, ts: str, name: str, numbers: list[str], others: list[str] = ()) -> DataFrame:
    """Sub-daily readings to days: means of numbers, first of the rest in time order.

    Days between a user's first and last reading exist even when empty.
    """
    order = F.struct(F.col(ts), F.col("rec_id"))
    by_day = records.withColumn("date", F.to_date(ts)).groupBy(*KEY).agg(
        *[F.avg(c).alias(f"{name}_{c}_mean") for c in numbers],
        *[F.min_by(c, order).alias(f"{name}_{c}") for c in others])
    return user_calendar(by_day).join(by_day, KEY, "left")


def align_daily(sensors: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, KEY), sensors)


def complete_grid(daily: DataFrame) -> DataFrame:
    """Every date between the user's first and last one."""
    return user_calendar(daily).join(daily, KEY, "left")


def hourly_grid(records: DataFrame, ts: str) -> DataFrame:
    """Every hour between the user's first and last reading."""
    hour = lambda c: F.floor(E.micros(c) / float(E.HOUR_US)).cast("long")
    span = records.groupBy("user_id").agg(F.min(hour(ts)).alias("a"), F.max(hour(ts)).alias("b"))
    return span.select("user_id", F.explode(F.sequence("a", "b")).alias("h")).select(
        "user_id", E.from_micros(F.col("h") * E.HOUR_US).alias("hour_ts"))


def fill_linear(grid: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """Linear in position; a point is filled when a value lies within ``limit`` rows of it.

    Before the first and after the last value the nearest one is extended.
    """
    order = W.partitionBy("user_id").orderBy("date")
    back, ahead = order.rowsBetween(START, 0), order.rowsBetween(0, END)
    g = grid.withColumn("_i", F.row_number().over(order))
    out: list[Column] = []
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).cast("double").alias("v")))
        p, n = F.last(at, True).over(back), F.first(at, True).over(ahead)
        g = g.withColumn(f"_p_{c}", p).withColumn(f"_n_{c}", n)
        left, right = F.col("_i") - F.col(f"_p_{c}.i"), F.col(f"_n_{c}.i") - F.col("_i")
        near = (F.coalesce(left, F.lit(limit + 1)) <= limit) | (F.coalesce(right, F.lit(limit + 1)) <= limit)
        pv, nv = F.col(f"_p_{c}.v"), F.col(f"_n_{c}.v")
        between = F.when(left + right == 0, pv).otherwise(pv + (nv - pv) * left / (left + right))
        out.append(F.when(near, F.coalesce(between, pv, nv)).alias(c))
    kept = [c for c in grid.columns if c not in columns]
    return g.select(*kept, *out)


def fill_forward(grid: DataFrame, columns: list[str], limit: int) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("date").rowsBetween(-limit, 0)
    kept = [c for c in grid.columns if c not in columns]
    return grid.select(*kept, *[F.last(c, True).over(w).alias(c) for c in columns])


def no_fill(grid: DataFrame) -> DataFrame:
    return grid


def align_interpolated(sensors: dict[str, DataFrame], limit: int = 3) -> DataFrame:
    """One calendar over all sensors, each column filled linearly up to ``limit`` days."""
    grid = user_calendar(*sensors.values())
    named = [prefixed(d, n, KEY) for n, d in sensors.items()]
    joined = reduce(lambda a, b: a.join(b, KEY, "left"), named, grid)
    return fill_linear(joined, [c for d in named for c in d.columns if c not in KEY], limit)


# ---- density ---------------------------------------------------------------------

def density(days: DataFrame) -> DataFrame:
    """Coverage, gaps, runs and missing-day pattern of distinct dates."""
    order = W.partitionBy("user_id").orderBy("date")
    d = days.select(*KEY).distinct().withColumn(
        "gap", F.datediff("date", F.lag("date").over(order)) - 1
    ).withColumn("run", F.date_sub("date", F.row_number().over(order)))
    runs = d.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("len"), F.min("date").alias("lo"),
                                           F.max("date").alias("hi"), F.max("gap").alias("gap"))
    g = runs.groupBy("user_id").agg(
        F.sum("len").alias("days"), (F.datediff(F.max("hi"), F.min("lo")) + 1).alias("total_days"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_days"), F.max("len").alias("consecutive_days"))
    cover, gap = F.col("coverage"), F.col("max_gap_days")
    return g.withColumn("coverage", F.col("days") / F.col("total_days")).withColumn(
        "density_class", E.ladder(
            ((cover > 0.8) & (gap < 3), "dense"), ((cover > 0.5) & (gap < 7), "moderate"),
            ((cover > 0.1) & (gap < 14), "sparse"), otherwise="very_sparse"))


def missing_pattern(days: DataFrame) -> DataFrame:
    """Weekend and weekday share of the missing dates, and whether they repeat."""
    have = days.select(*KEY).distinct()
    missing = user_calendar(have).join(have, KEY, "left_anti")
    order = W.partitionBy("user_id").orderBy("date")
    day = F.weekday("date")
    m = missing.select("user_id", day.alias("day"), (day >= 5).alias("weekend"),
                       F.datediff("date", F.lag("date").over(order)).alias("gap"))
    g = m.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("missing"), F.avg(F.col("weekend").cast("int")).alias("weekend_share"),
        F.countDistinct("gap").alias("gaps"), F.countDistinct("day").alias("weekdays"))
    users = have.select("user_id").distinct()
    n = F.coalesce("missing", F.lit(0))
    share = F.coalesce("weekend_share", F.lit(0.0))
    return users.join(g, "user_id", "left").select(
        "user_id", n.alias("missing"), share.alias("weekend_bias"),
        F.when(n > 0, 1 - share).otherwise(0.0).alias("weekday_bias"),
        ((n >= 3) & ((F.col("gaps") == 1) | (F.col("weekdays") <= 2))).alias("is_periodic"))


def density_confidence(dens: DataFrame) -> DataFrame:
    score = (F.col("coverage") * 0.5 + (1 - F.least(F.col("max_gap_days") / 7.0, F.lit(1.0))) * 0.3
             + F.least(F.col("consecutive_days") / 7.0, F.lit(1.0)) * 0.2)
    return dens.withColumn("confidence", E.clamp(score, 0, 1))


def processing_strategy(dens: DataFrame) -> DataFrame:
    """Algorithm by density class; the moderate class falls through to the minimal one."""
    kind = F.col("density_class")
    return dens.select(
        "user_id", "density_class",
        E.ladder((kind == "dense", "full_circadian_analysis"), (kind == "sparse", "interpolation_with_uncertainty"),
                 otherwise="minimal_analysis").alias("algorithm"),
        E.ladder((kind == "dense", ""), (kind == "sparse", wording.SPARSE_DATA_CONFIDENCE),
                 otherwise=wording.VERY_SPARSE_DATA).alias("warning"))


def available_features(dens: DataFrame) -> DataFrame:
    run, cover = F.col("consecutive_days"), F.col("coverage")
    return dens.select(
        "user_id", (run >= 1).alias("daily_summary"), (run >= 7).alias("weekly_patterns"),
        ((run >= 7) & (cover > 0.7)).alias("circadian_phase"),
        ((run >= 7) & (cover > 0.7)).alias("circadian_amplitude"),
        (F.col("total_days") >= 28).alias("monthly_trends"), (F.col("total_days") >= 90).alias("seasonal_patterns"))


def missingness(grid: DataFrame, columns: list[str]) -> DataFrame:
    """Null ratios, longest null run and weekday/weekend ratios over a complete grid."""
    order = W.partitionBy("user_id").orderBy("date")
    weekend = F.weekday("date") >= 5
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])
    g = grid.withColumn("_i", F.row_number().over(order)).withColumn("_nulls", nulls).withColumn("_we", weekend)
    for c in columns:
        seen = F.coalesce(F.last(F.when(F.col(c).isNotNull(), F.col("_i")), True).over(order.rowsBetween(START, 0)), F.lit(0))
        g = g.withColumn(f"_run_{c}", F.col("_i") - seen)
    width = len(columns)
    return g.groupBy("user_id").agg(
        (F.sum("_nulls") / (F.count(F.lit(1)) * width)).alias("missing_ratio"),
        *[F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_missing_ratio") for c in columns],
        *[F.max(f"_run_{c}").alias(f"{c}_longest_missing") for c in columns],
        F.greatest(*[F.max(f"_run_{c}") for c in columns]).alias("longest_missing")
        if width > 1 else F.max(f"_run_{columns[0]}").alias("longest_missing"),
        (F.sum(F.when(~F.col("_we"), F.col("_nulls"))) / (F.count_if(~F.col("_we")) * width)).alias("weekday_ratio"),
        (F.sum(F.when(F.col("_we"), F.col("_nulls"))) / F.nullif(F.count_if(F.col("_we")) * width, F.lit(0)))
        .alias("weekend_ratio"))


def completeness(nights: DataFrame, acts: DataFrame, hearts: DataFrame) -> DataFrame:
    """Per-day presence of the three sensors and what is missing."""
    flag = lambda d, n: d.select(*KEY, F.lit(True).alias(n))
    j = flag(nights, "sleep").join(flag(acts, "activity"), KEY, "full").join(flag(hearts, "heart"), KEY, "full")
    j = j.select(*KEY, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("sleep", "activity", "heart")])
    return j.withColumn("missing", F.concat_ws(",", E.messages(
        (~F.col("sleep"), "sleep"), (~F.col("activity"), "activity"), (~F.col("heart"), "heart"))))


def completeness_report(per_day: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    full = F.col("sleep") & F.col("activity") & F.col("heart")
    return per_day.groupBy("user_id").agg(
        n.alias("days"), *[(F.count_if(F.col(c)) / n).alias(f"{c}_coverage") for c in ("sleep", "activity", "heart")],
        F.count_if(full).alias("full_days"))


def data_summary(sleep: DataFrame, activity: DataFrame, heart: DataFrame) -> DataFrame:
    """Record and day counts per sensor, overall range, density and warnings."""
    per_day = reduce(lambda a, b: a.unionByName(b), [
        d.groupBy("user_id", F.to_date(ts).alias("date")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("sensor", F.lit(s))
        for s, d, ts in (("sleep", sleep, "start_ts"), ("activity", activity, "start_ts"), ("heart", heart, "ts"))])
    is_ = lambda s: F.col("sensor") == s
    by_date = per_day.groupBy(*KEY).agg(*[
        F.coalesce(F.sum(F.when(is_(s), F.col("n"))), F.lit(0)).alias(s) for s in ("sleep", "activity", "heart")])
    g = by_date.groupBy("user_id").agg(
        *[F.sum(s).alias(f"{s}_records") for s in ("sleep", "activity", "heart")],
        *[F.count_if(F.col(s) > 0).alias(f"{s}_days") for s in ("sleep", "activity", "heart")],
        F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    g = g.withColumn("density", F.col("days") / (F.datediff("last_day", "first_day") + 1))
    return g.withColumn("warnings", F.concat_ws("; ", E.messages(
        (F.col("sleep_records") == 0, wording.NO_SLEEP_DATA), (F.col("activity_records") == 0, wording.NO_ACTIVITY_DATA),
        (F.col("density") < 0.5, wording.SPARSE_DATA))))


def validation(summary: DataFrame) -> DataFrame:
    """Whether a user's data can be used, the share of days with sleep, and what is wanting; from `data_summary`."""
    share = F.when(F.col("sleep_records") > 0, F.col("sleep_days") / (F.datediff("last_day", "first_day") + 1))
    warned = E.messages(
        (F.col("sleep_records") == 0, wording.NO_SLEEP_RECORDS), (F.col("activity_records") == 0, wording.NO_ACTIVITY_RECORDS),
        (F.col("sleep_density") < 0.5, F.concat(
            F.lit(wording.SPARSE_SLEEP), F.format_number(F.col("sleep_density") * 100, 1), F.lit(wording.COVERAGE))))
    return summary.withColumn("sleep_density", share).select(
        "user_id", "sleep_records", "activity_records", "heart_records", "first_day", "last_day", "sleep_density",
        ((F.col("sleep_records") > 0) | (F.col("activity_records") > 0)).alias("is_valid"), F.concat_ws("; ", warned).alias("warnings"))


def monthly_coverage(nights: DataFrame, acts: DataFrame) -> DataFrame:
    """Days with sleep, activity and both, per user and month."""
    j = nights.select(*KEY, F.lit(1).alias("s")).distinct().join(
        acts.select(*KEY, F.lit(1).alias("a")).distinct(), KEY, "full")
    month = F.trunc("date", "month")
    length = F.dayofmonth(F.last_day("month"))
    g = j.groupBy("user_id", month.alias("month")).agg(
        F.count("s").alias("sleep_days"), F.count("a").alias("activity_days"),
        F.count_if(F.col("s").isNotNull() & F.col("a").isNotNull()).alias("both_days"))
    return g.select("*", *[(F.col(f"{c}_days") / length * 100).alias(f"{c}_pct") for c in ("sleep", "activity", "both")])
