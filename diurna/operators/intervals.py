"""Interval merging, gaps and islands, and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diurna import schemas as S, wording
from diurna.functions import exprs as E
from diurna.operators import ordering as O

USER = ["user_id"]


def _bounds(sleep: DataFrame, keys: list[str]) -> DataFrame:
    return sleep.select(
        *keys, E.micros("start_ts").alias("start_us"), E.micros("end_ts").alias("end_us")
    )


def _instants(sleep: DataFrame, keys: list[str]) -> DataFrame:
    """One row per start instant: among equal starts only the last end matters in order."""
    return (
        _bounds(sleep, keys).groupBy(*keys, "start_us")
        .agg(F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("n"))
    )


def episode_steps(
    sleep: DataFrame, keys: list[str] = USER, threshold_hours: float = S.MERGE_THRESHOLD_HOURS
) -> DataFrame:
    """Start instants with their window start, the gap before them and the end reached before.

    Starts in one time bucket no wider than the threshold can never be parted, so
    windows are decided between bucket summaries, whose number the calendar
    bounds; only the gaps inside a bucket need its rows in order.
    """
    limit = round(threshold_hours * E.HOUR_US)
    if limit <= 0:
        raise ValueError(wording.THE_MERGE_THRESHOLD)
    width = min(E.HOUR_US, limit)
    slot = F.floor(F.col("start_us") / F.lit(float(width))).cast("long")
    rows = _instants(sleep, keys).withColumn("slot", slot)
    part = [*keys, "slot"]

    across = W.partitionBy(*keys).orderBy("slot")
    summary = _bounds(sleep, keys).withColumn("slot", slot).groupBy(*part).agg(
        F.min("start_us").alias("first_us"),
        F.max_by("end_us", F.struct("start_us", "end_us")).alias("last_end"),
        F.max("end_us").alias("max_end"),
    ).withColumn("prev_end", F.lag("last_end").over(across))
    opens = F.col("prev_end").isNull() | (F.col("first_us") - F.col("prev_end") > limit)
    summary = summary.withColumn("opens", opens).withColumn(
        "window_us",
        F.last(F.when(F.col("opens"), F.col("first_us")), True)
        .over(across.rowsBetween(W.unboundedPreceding, 0)),
    )
    inside = W.partitionBy(*keys, "window_us").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        *part, "window_us", F.when(~F.col("opens"), F.col("prev_end")).alias("carry_end"),
        F.max("max_end").over(inside).alias("carry_reach"),
    )

    local = W.partitionBy(*part).orderBy("start_us")
    here = rows.select(
        "*", F.lag("end_us").over(local).alias("local_end"),
        F.max("end_us").over(local.rowsBetween(W.unboundedPreceding, -1)).alias("local_reach"),
    )
    gap = F.col("start_us") - F.coalesce("local_end", "carry_end")
    return here.join(carried, part).select(
        *keys, "window_us", "start_us", "end_us", "n",
        F.when(gap > 0, gap).alias("inner_gap_us"),
        F.greatest("local_reach", "carry_reach").alias("reach"),
    )


def _slot_chunks(sleep: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Per key and time slot: the distinct start instants in order, each with its last end, and the episodes.

    Copies of an episode combine before the shuffle. A slot is an hour at most, so at the second
    resolution of the exports an array has at most 3,600 entries.
    """
    slot = F.floor(F.col("start_us") / F.lit(float(min(E.HOUR_US, limit)))).cast("long")
    chunks = _bounds(sleep, keys).groupBy(*keys, slot.alias("slot")).agg(
        F.sort_array(F.collect_set(F.struct("start_us", "end_us"))).alias("pairs"), F.count(F.lit(1)).alias("n"))
    # of equal starts the last pair has the last end
    last = lambda x, i: ~F.coalesce(F.get("pairs", i + 1)["start_us"] == x["start_us"], F.lit(False))
    return chunks.withColumn("pairs", F.filter("pairs", last))


def merge_sleep_windows(
    sleep: DataFrame, keys: list[str] = USER, threshold_hours: float = S.MERGE_THRESHOLD_HOURS
) -> DataFrame:
    """Merge episodes whose gap to the episode before is within the threshold (equal merges).

    The hours slept are free of double counting: each episode adds only what lies
    beyond the furthest end seen before it in its window.

    Starts in one slot no wider than the threshold are never parted, so a slot is one chunk of
    one window: records are read and shuffled once, to chunks, and the chunks of a key, whose
    number the calendar bounds, once more to be put in order. What a chunk needs of those
    before it is the last end and the reach; its own instants are folded from there.
    """
    limit = round(threshold_hours * E.HOUR_US)
    if limit <= 0:
        raise ValueError(wording.THE_MERGE_THRESHOLD)
    hour = float(E.HOUR_US)
    across = W.partitionBy(*keys).orderBy("slot")
    chunks = _slot_chunks(sleep, keys, limit).withColumns({
        "first_us": F.col("pairs")[0]["start_us"], "last_end": F.element_at("pairs", -1)["end_us"],
        "max_end": F.array_max(F.transform("pairs", lambda x: x["end_us"]))})
    chunks = chunks.withColumn("prev_end", F.lag("last_end").over(across))
    opens = F.col("prev_end").isNull() | (F.col("first_us") - F.col("prev_end") > limit)
    chunks = chunks.withColumn("opens", opens).withColumn(
        "window_us", F.last(F.when(F.col("opens"), F.col("first_us")), True).over(across.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy(*keys, "window_us").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.when(~F.col("opens"), F.col("prev_end")).alias("last"), F.max("max_end").over(inside).alias("reach"),
        zero.alias("slept"), zero.alias("gaps"), zero.alias("gap_us"), F.lit(0.0).alias("gap_sq"))

    def folded(acc: Column, x: Column) -> Column:
        gap = F.greatest(F.coalesce(x["start_us"] - acc["last"], zero), zero)
        fresh = F.greatest(x["end_us"] - F.greatest(x["start_us"], acc["reach"]), zero)
        return F.struct(
            x["end_us"].alias("last"), F.greatest(acc["reach"], x["end_us"]).alias("reach"), (acc["slept"] + fresh).alias("slept"),
            (acc["gaps"] + F.when(gap > 0, 1).otherwise(0)).alias("gaps"), (acc["gap_us"] + gap).alias("gap_us"),
            (acc["gap_sq"] + (gap / hour) * (gap / hour)).alias("gap_sq"))

    told = chunks.withColumn("start", start).select(
        *keys, "window_us", "max_end", "n", F.aggregate("pairs", F.col("start"), folded).alias("f"))
    grouped = told.groupBy(*keys, "window_us").agg(
        F.max("max_end").alias("stop_us"), F.sum("n").alias("episodes"), F.sum("f.slept").alias("slept_us"),
        F.sum("f.gaps").alias("gaps"), F.sum("f.gap_us").alias("gap_us"), F.sum("f.gap_sq").alias("gap_sq"))
    span = (F.col("stop_us") - F.col("window_us")) / hour
    return grouped.select(
        *keys,
        E.from_micros("window_us").alias("window_start"),
        E.from_micros("stop_us").alias("window_end"),
        "episodes",
        (F.col("slept_us") / hour).alias("hours"),
        span.alias("span_hours"),
        "gaps",
        (F.col("gap_us") / hour).alias("gap_hours"),
        "gap_sq",
        E.ratio(F.col("gap_us") / hour, span).alias("fragmentation"),
        (F.col("episodes") > 1).alias("is_fragmented"),
    )


def window_gaps(sleep: DataFrame, keys: list[str] = USER,
                threshold_hours: float = S.MERGE_THRESHOLD_HOURS) -> DataFrame:
    """One row per positive gap inside a window; long form, so no list grows with the data."""
    return (
        episode_steps(sleep, keys, threshold_hours).filter(F.col("inner_gap_us").isNotNull())
        .select(
            *keys,
            E.from_micros("window_us").alias("window_start"),
            E.from_micros("start_us").alias("gap_end"),
            (F.col("inner_gap_us") / float(E.HOUR_US)).alias("gap_hours"),
        )
    )


def union_hours(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap-free hours per key."""
    steps = O.ordered_scan(
        _instants(intervals, keys), keys, E.hour_bucket("start_us"), ["start_us"],
        reach=O.max_before(F.col("end_us")),
    )
    fresh = F.greatest(
        F.col("end_us") - F.greatest(F.col("start_us"), F.col("reach")), F.lit(0)
    )
    return steps.groupBy(*keys).agg((F.sum(fresh) / float(E.HOUR_US)).alias("union_hours"))


def window_summary(windows: DataFrame, keys: list[str] = USER) -> DataFrame:
    n = F.count(F.lit(1))
    short, long = F.count_if(F.col("hours") < 6), F.count_if(F.col("hours") > 10)
    broken = F.count_if(F.col("is_fragmented"))
    return windows.groupBy(*keys).agg(
        n.alias("windows"), short.alias("short_windows"), long.alias("long_windows"),
        broken.alias("fragmented_windows"), F.avg("hours").alias("avg_hours"),
        (short / n * 100).alias("short_pct"), (long / n * 100).alias("long_pct"),
        (broken / n * 100).alias("fragmented_pct"),
    )


def daily_windows(sleep: DataFrame) -> DataFrame:
    """Windows of the episodes starting on each date."""
    return merge_sleep_windows(
        sleep.withColumn("date", F.to_date("start_ts")), ["user_id", "date"]
    )


def daily_window_metrics(sleep: DataFrame, counted: bool = False) -> DataFrame:
    """Metrics of the windows of each start date; counted: with the records behind them."""
    is_long = F.col("hours") >= S.MERGE_THRESHOLD_HOURS
    gaps, total, squares = F.sum("gaps"), F.sum("gap_hours"), F.sum("gap_sq")
    spread = F.sqrt(F.greatest(squares / gaps - (total / gaps) * (total / gaps), F.lit(0.0)))

    def part(flag: Column, value: Column | str) -> Column:
        return F.coalesce(F.sum(F.when(flag, E.col(value))), F.lit(0.0))

    more = [F.sum("episodes").alias("records")] if counted else []
    return daily_windows(sleep).groupBy("user_id", "date").agg(
        *more, (F.sum("hours") * 60 / 1440).alias("sleep_percentage"),
        # one gap has no spread; the moment formula alone would leave rounding noise
        F.when(gaps > 1, spread / (total / gaps)).otherwise(0.0).alias("sleep_amplitude"),
        F.count_if(is_long).alias("long_num"),
        part(is_long, "hours").alias("long_len"),
        part(is_long, "hours").alias("long_st"),
        part(is_long, "gap_hours").alias("long_wt"),
        F.count_if(~is_long).alias("short_num"),
        part(~is_long, "hours").alias("short_len"),
        part(~is_long, "hours").alias("short_st"),
        part(~is_long, "gap_hours").alias("short_wt"),
    )


def merge_adjacent(periods: DataFrame, keys: list[str] = USER, tolerance_seconds: int = 60) -> DataFrame:
    """Merge periods that overlap or lie within the tolerance of the running end.

    As above, starts within one tolerance-wide slot always merge, so the slot
    summaries alone decide the result.
    """
    limit = tolerance_seconds * 1_000_000
    slot = F.floor(F.col("start_us") / F.lit(float(limit))).cast("long")
    across = W.partitionBy(*keys).orderBy("slot")
    slots = (
        _bounds(periods, keys)
        .groupBy(*keys, slot.alias("slot"))
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
             F.count(F.lit(1)).alias("n"))
        .withColumn("reach", F.max("end_us").over(across.rowsBetween(W.unboundedPreceding, -1)))
    )
    opens = F.col("reach").isNull() | (F.col("start_us") - F.col("reach") > limit)
    return (
        slots.withColumn("first_us", F.last(F.when(opens, F.col("start_us")), True)
                         .over(across.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "first_us").agg(F.max("end_us").alias("last_us"), F.sum("n").alias("periods"))
        .select(*keys, E.from_micros("first_us").alias("start_ts"),
                E.from_micros("last_us").alias("end_ts"), "periods")
    )


# ---- islands over dates (bounded by the calendar per user) -----------------

def date_runs(days: DataFrame, keys: list[str] = USER, min_days: int = 3) -> DataFrame:
    """Maximal runs of consecutive dates of at least ``min_days``."""
    order = W.partitionBy(*keys).orderBy("date")
    runs = days.select(*keys, "date").distinct().withColumn(
        "run", F.date_sub("date", F.row_number().over(order))
    )
    return (
        runs.groupBy(*keys, "run")
        .agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"),
             F.count(F.lit(1)).alias("days"))
        .filter(F.col("days") >= min_days).drop("run")
    )


def overlap_runs(a: DataFrame, b: DataFrame, keys: list[str] = USER, min_days: int = 3) -> DataFrame:
    """Runs of dates both sensors have."""
    cols = [*keys, "date"]
    return date_runs(a.select(*cols).intersect(b.select(*cols)), keys, min_days)


def overlap_advice(runs: DataFrame, users: DataFrame) -> DataFrame:
    """What the number and length of the overlap runs allow, per user."""
    found = runs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("runs"), F.max("days").alias("longest_days"),
        F.sum("days").alias("overlap_days"),
    )
    n, longest = F.coalesce("runs", F.lit(0)), F.coalesce("longest_days", F.lit(0))
    return users.join(found, "user_id", "left").select(
        "user_id", n.alias("runs"), longest.alias("longest_days"),
        E.ladder(
            (n == 0, wording.USE_SENSOR_SPECIFIC),
            ((n == 1) & (longest - 1 < 7), wording.LIMITED_OVERLAP_USE),
            otherwise=wording.SUFFICIENT_OVERLAP_FOR,
        ).alias("advice"),
    )


def longest_run(rows: DataFrame, keys: list[str], order: str, flag: Column, name: str) -> DataFrame:
    """Longest run of row-adjacent flagged rows; the rows are bounded by the calendar."""
    w = W.partitionBy(*keys).orderBy(order)
    numbered = rows.select(*keys, order, flag.alias("flag")).withColumn("pos", F.row_number().over(w))
    hits = numbered.filter("flag").withColumn("island", F.col("pos") - F.row_number().over(w))
    runs = hits.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("len"))
    best = runs.groupBy(*keys).agg(F.max("len").alias(name))
    return rows.select(*keys).distinct().join(best, keys, "left").select(
        *keys, F.coalesce(name, F.lit(0)).alias(name)
    )


def expand_days(periods: DataFrame, *carry: str) -> DataFrame:
    """One row per day a period covers, ends included."""
    return periods.filter(F.col("end_date") >= F.col("start_date")).select(
        *carry, F.explode(F.sequence("start_date", "end_date", F.expr("interval 1 day"))).alias("date")
    )


# ---- interval joins --------------------------------------------------------

def records_covering(sleep: DataFrame) -> DataFrame:
    """Each record once per date it touches; then any date join is an equi-join."""
    days = F.sequence(F.to_date("start_ts"), F.to_date("end_ts"), F.expr("interval 1 day"))
    return sleep.select("*", F.explode(days).alias("date"))


def lookback(records: DataFrame, targets: DataFrame, days: int) -> DataFrame:
    """Records that start within the ``days`` dates up to and including each target date.

    The small side is fanned out: targets, not records, are repeated.
    """
    offsets = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    wanted = targets.select("user_id", "target_date", offsets.alias("back")).withColumn(
        "day", F.date_sub("target_date", F.col("back"))
    )
    return records.withColumn("day", F.to_date("start_ts")).join(wanted, ["user_id", "day"])


def sleep_hours_of_day(sleep: DataFrame) -> DataFrame:
    """Distinct (user, date, hour) slots an episode overlaps; an end on the hour is outside."""
    first = E.hour_bucket(E.micros("start_ts"))
    last = E.hour_bucket(E.micros("end_ts") - 1)
    slots = sleep.filter(F.col("end_ts") > F.col("start_ts")).select(
        "user_id", F.explode(F.sequence(first, last)).alias("slot")
    ).distinct()
    return slots.select(
        "user_id", F.date_from_unix_date(F.floor(F.col("slot") / 24).cast("int")).alias("date"),
        F.pmod("slot", F.lit(24)).cast("int").alias("hour"),
    )


def conflicting(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates overlapping any stored period of the same user (closed intervals).

    A candidate [s, e] conflicts exactly when the furthest end among stored
    periods starting on or before e reaches s, so no pairs are formed: one pass
    over distinct days per user and an equi-join on (user, e).
    """
    starts = stored.groupBy("user_id", F.col("start_date").alias("day")).agg(
        F.max("end_date").alias("reach")
    )
    asked = candidates.select("user_id", F.col("end_date").alias("day")).distinct()
    w = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    reach = asked.join(starts, ["user_id", "day"], "full").select(
        "user_id", F.col("day").alias("end_date"), F.max("reach").over(w).alias("reach")
    )
    return candidates.join(reach, ["user_id", "end_date"]).filter(
        F.col("reach") >= F.col("start_date")
    ).drop("reach")
