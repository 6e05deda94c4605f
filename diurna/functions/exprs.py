"""Column builders: record predicates, clock helpers and vector arithmetic (no UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from diurna import schemas as S

HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000
DAY_US = 86_400_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- time -----------------------------------------------------------------

def micros(ts: str | Column) -> Column:
    """Local wall-clock microseconds; exact because the session zone is pinned to UTC."""
    return F.unix_micros(col(ts).cast("timestamp"))


def from_micros(us: str | Column) -> Column:
    return F.timestamp_micros(col(us)).cast("timestamp_ntz")


def hours_between(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(HOUR_US))


def clock_us(ts: str | Column) -> Column:
    """Time of day in microseconds since midnight."""
    return F.pmod(micros(ts), F.lit(DAY_US))


def hour_bucket(us: str | Column) -> Column:
    return F.floor(col(us) / F.lit(float(HOUR_US))).cast("long")


def clock_hour(ts: str | Column) -> Column:
    """Hour of day with minutes as a fraction."""
    return F.hour(ts) + F.minute(ts) / 60.0


def evening_hour(h: Column) -> Column:
    """Bedtimes after midnight count as hours past 24."""
    return F.when(h < 12, h + 24).otherwise(h)


def day_number(d: str | Column) -> Column:
    return F.unix_date(col(d))


def in_sleep_hours(hour: str | Column, start: int = 23, end: int = 7) -> Column:
    h = col(hour)
    return ((h >= start) | (h < end)) if start > end else ((h >= start) & (h < end))


def local_timestamp(text: str | Column) -> Column:
    """First 19 characters, offset dropped; a bare date means midnight; else null."""
    t = F.trim(col(text))
    return F.coalesce(
        F.try_to_timestamp(F.replace(F.substring(t, 1, 19), F.lit("T"), F.lit(" ")),
                           F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(F.when(F.length(t) == 10, t), F.lit("yyyy-MM-dd")),
    ).cast("timestamp_ntz")


def safe_float(text: str | Column, default: float = 0.0) -> Column:
    return F.coalesce(col(text).try_cast("double"), F.lit(default))


def safe_int(text: str | Column, default: int = 0) -> Column:
    value = col(text).try_cast("double")
    return F.coalesce(F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("long"),
                      F.lit(default).cast("long"))


def starts_within(ts: str | Column, first: str | None = None, last: str | None = None) -> Column:
    """Start date in [first, last], either end open; plain comparisons, so Parquet can skip row groups."""
    c, keep = col(ts), F.lit(True)
    if first:
        keep = keep & (c >= F.lit(first).cast("timestamp_ntz"))
    if last:
        keep = keep & (c < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))
    return keep


# ---- numbers --------------------------------------------------------------

def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi))))


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(default))


def pop_std(v: Column) -> Column:
    """Population deviation, 0 below two values (also for an empty group)."""
    return F.coalesce(F.when(F.count(v) >= 2, F.stddev_pop(v)), F.lit(0.0))


def pop_var(v: Column) -> Column:
    return F.coalesce(F.when(F.count(v) >= 2, F.var_pop(v)), F.lit(0.0))


def count_true(*flags: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags])


def ladder(*steps: tuple[Column, object], otherwise: object) -> Column:
    """First matching rule wins."""
    out = None
    for condition, value in steps:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def messages(*rules: tuple[Column, str | Column]) -> Column:
    """Array of the texts whose condition holds, in rule order."""
    return F.array_compact(F.array(*[
        F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in rules
    ]))


def lookup(table: dict[str, str], key: Column) -> Column:
    items = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*items), key)


# ---- records --------------------------------------------------------------

def is_asleep(state: str | Column = "state") -> Column:
    return col(state).isin(S.ASLEEP_STATES)


def sleep_quality(state: str | Column = "state") -> Column:
    return lookup(S.SLEEP_QUALITY, col(state))


def intensity_per_hour(value="value", start="start_ts", end="end_ts") -> Column:
    hours = hours_between(start, end)
    return F.when(hours == 0, col(value)).otherwise(col(value) / hours)


def is_high_activity() -> Column:
    rate = intensity_per_hour() * 24
    kind = F.col("activity_type")
    return ((kind == "STEP_COUNT") & (rate > 15000)) | ((kind == "ACTIVE_ENERGY") & (rate > 500))


def is_low_activity() -> Column:
    rate = intensity_per_hour() * 24
    kind = F.col("activity_type")
    return ((kind == "STEP_COUNT") & (rate < 2000)) | ((kind == "ACTIVE_ENERGY") & (rate < 100))


def is_high_heart_rate() -> Column:
    return ((F.col("metric_type") == "HEART_RATE") & (F.col("motion_context") != "active")
            & (F.col("value") > 100))


def is_low_heart_rate() -> Column:
    return F.col("metric_type").isin("HEART_RATE", "RESTING_HEART_RATE") & (F.col("value") < 50)


def is_low_hrv() -> Column:
    return (F.col("metric_type") == "HRV_SDNN") & (F.col("value") < 20)


def is_significant_heart() -> Column:
    return is_high_heart_rate() | is_low_heart_rate() | is_low_hrv()


def record_id(*parts: str) -> Column:
    """Readable key of a record; ``:`` and ``/`` become ``-``."""
    return F.translate(F.concat_ws("_", *[F.col(p).cast("string") for p in parts]), ":/", "--")


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    """Half-open overlap of two periods."""
    return (col(a_end) > col(b_start)) & (col(b_end) > col(a_start))


# ---- episode vocabulary ---------------------------------------------------

# Diagnosis vocabulary and its two target vocabularies.
TO_DIAGNOSTIC = {
    "depressive_episode": "depressive", "manic_episode": "manic",
    "hypomanic_episode": "hypomanic", "mixed_episode": "mixed", "euthymic": "euthymic",
}
TO_TREATMENT = {
    "depressive_episode": "depressive", "manic_episode": "manic",
    "hypomanic_episode": "hypomanic", "mixed_episode": "mixed",
    "depressive_with_mixed_features": "depressive_mixed",
    "manic_with_mixed_features": "manic_mixed", "euthymic": "none",
}


def map_episode_type(diagnosis: str | Column, table: dict[str, str]) -> Column:
    """Case-insensitive mapping; unknown values pass through in lower case."""
    key = F.lower(F.coalesce(col(diagnosis), F.lit("")))
    return F.coalesce(lookup(table, key), key)


def from_diagnostic(kind: str | Column) -> Column:
    return map_episode_type(kind, {v: k for k, v in TO_DIAGNOSTIC.items()})


def is_known_episode_type(kind: str | Column) -> Column:
    return F.coalesce(F.lower(col(kind)).isin([*TO_DIAGNOSTIC, *TO_TREATMENT]), F.lit(False))


# ---- vectors --------------------------------------------------------------

def vector_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def standardize(a: Column) -> Column:
    """(v - mean) / population deviation; a flat vector is only centred."""
    def centred(mean: Column) -> Column:
        square = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(a)
        return let(F.sqrt(square), lambda std: F.transform(
            a, lambda x: F.when(std > 0, (x - mean) / std).otherwise(x - mean)))

    return let(vector_mean(a), centred)


def patches(a: Column, width: int) -> Column:
    """Consecutive slices of ``width`` values; an incomplete tail is cut."""
    n = F.floor(F.size(a) / width).cast("int")
    return F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.slice(a, i * width + 1, width),
    )


# Ranges of the normalised features.
FEATURE_RANGES = {
    "sleep_percentage": (0.0, 0.5), "sleep_amplitude": (0.0, 1.0),
    "long_num": (0.0, 5.0), "short_num": (0.0, 10.0),
    "circadian_amplitude": (0.0, 1.0), "circadian_phase": (0.0, 24.0),
}


def normalized(name: str, value: Column, ranges: dict = FEATURE_RANGES) -> Column:
    """Min-max scale by the range of the base name (the name without its last suffix)."""
    base = name.rsplit("_", 1)[0] if "_" in name else name
    if base not in ranges:
        return value
    lo, hi = ranges[base]
    return (clamp(value, lo, hi) - lo) / (hi - lo) if hi > lo else value * 0.0
