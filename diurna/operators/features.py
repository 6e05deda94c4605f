"""Lookback features and composite feature tables.

The three daily tables are joined once on (user, date); every lookback feature
is a window aggregate over the same 31-day calendar frame, so the whole set
costs one exchange on the user key. A user's rows are bounded by the calendar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diurna import wording
from diurna.functions import exprs as E
from diurna.operators import circadian as C
from diurna.operators import daily as D
from diurna.operators import intervals as I
from diurna.operators import rolling as R

KEY = ["user_id", "date"]
NORM_BED, NORM_WAKE, SHIFT_HOURS = 23.0, 7.0, 2.0

# Order of the 36 model inputs.
VECTOR_FIELDS = [
    "sleep_hours", "efficiency", "onset_hour", "wake_hour", "episode_fragmentation", "sleep_regularity",
    "short_sleep_pct", "long_sleep_pct", "onset_variance", "wake_variance",
    "interdaily_stability", "intradaily_variability", "relative_amplitude", "l5_value", "m10_value",
    "l5_onset", "m10_onset", "dlmo_hour",
    "steps", "value_variance", "sedentary_day_hours", "activity_fragmentation", "sedentary_mean_minutes", "intensity_ratio",
    "avg_resting_hr", "avg_hrv", "value_range", "lowest_hour",
    "phase_advance", "phase_delay", "dlmo_confidence", "pat_hour", "sleep_z", "activity_z", "hr_z", "hrv_z",
]


def daily_join(nights: DataFrame, acts: DataFrame, hearts: DataFrame) -> DataFrame:
    """One row per user and date any sensor has, with clock times as hours (seconds dropped)."""
    bed, wake = F.col("bedtime_minute"), F.col("wake_minute")
    main_start = F.col("mid_sleep_minute") - F.col("longest_hours") * 30
    nap = (F.floor(bed / 60).between(8, 18) & (F.col("longest_hours") > 0) & (F.abs(bed - main_start) > 240))
    clock = lambda m: F.floor(F.pmod(m, F.lit(1440.0)) + 1e-9) / 60
    n = nights.select(
        *KEY, "sleep_hours", "efficiency", "fragmentation", clock(bed).alias("bed_hour"), clock(wake).alias("wake_hour"),
        clock(F.col("mid_sleep_minute")).alias("mid_hour"), clock(F.when(nap, main_start).otherwise(bed)).alias("main_bed_hour"))
    a = acts.select(
        *KEY, "steps", "energy", "variance", "sedentary_hours", "active_hours", "peak_hour",
        clock(F.col("first_minute")).alias("first_hour"), clock(F.col("last_minute")).alias("last_hour"))
    h = hearts.select(*KEY, "avg_resting_hr", "avg_hrv", "hr_range")
    return n.join(a, KEY, "full").join(h, KEY, "full")


def _asleep_at(h: int) -> Column:
    """Clock hour h lies between bedtime and wake hour; null without a night."""
    a, b = F.floor("bed_hour"), F.floor("wake_hour")
    inside = F.when(a > b, (F.lit(h) >= a) | (F.lit(h) < b)).otherwise((F.lit(h) >= a) & (F.lit(h) < b))
    return F.when(a.isNotNull(), inside.cast("int"))


class Lookback:
    """Feature columns over one frame.

    ``over`` keeps each distinct aggregate once, as a named window column, and
    hands back a reference; features are then plain arithmetic over those names.
    """

    def __init__(self, frame: WindowSpec):
        self.w = frame
        self.framed: dict[str, Column] = {}
        self._names: dict[str, str] = {}
        self.nights, self.acts = self.over(F.count("sleep_hours")), self.over(F.count("steps"))

    def over(self, agg: Column) -> Column:
        name = self._names.setdefault(str(agg), f"_w{len(self._names)}")
        self.framed.setdefault(name, agg.over(self.w))
        return F.col(name)

    def avg(self, c: Column | str) -> Column:
        return self.over(F.avg(c))

    def std(self, c: Column | str) -> Column:
        return F.coalesce(self.over(F.stddev_pop(c)), F.lit(0.0))

    def var(self, c: Column | str) -> Column:
        return F.coalesce(self.over(F.var_pop(c)), F.lit(0.0))

    def _if(self, have: Column, value: Column, default: float = 0.0) -> Column:
        return F.when(have, value).otherwise(F.lit(default))

    # sleep
    def sleep(self) -> dict[str, Column]:
        some, n = self.nights > 0, self.nights
        night_bed, bed = E.evening_hour(F.col("main_bed_hour")), E.evening_hour(F.col("bed_hour"))
        # rounded, since a threshold at a whole number follows
        regular = F.round(E.clamp(100 - (self.std(night_bed) + self.std("wake_hour")) * 10, 0, 100), 9)
        masks = F.array(*[self.avg(_asleep_at(h)) for h in range(24)])
        stability = E.let(E.vector_mean(masks), lambda g: F.when(g * (1 - g) < 1e-13, 1.0).otherwise(E.clamp(
            F.aggregate(masks, F.lit(0.0), lambda s, m: s + (m - g) * (m - g)) / (24 * g * (1 - g)), 0, 1)))
        steady = (1 - self.std("sleep_hours") / (self.avg("sleep_hours") + 1e-6) + self.avg("efficiency")) / 2
        share = lambda f: self.avg(F.when(F.col("sleep_hours").isNotNull(), f.cast("int"))) * 100
        return {
            "sleep_regularity": E.ladder((n == 0, F.lit(0.0)), (n == 1, F.lit(100.0)), otherwise=regular),
            "interdaily_stability": self._if(n >= 3, stability),
            "intradaily_variability": self._if(some, self.avg((F.col("fragmentation") + 1 - F.col("efficiency")) / 2) * 2),
            "relative_amplitude": self._if(some, E.clamp(steady, 0, 1)),
            "short_sleep_pct": self._if(some, share(F.col("sleep_hours") < 6)),
            "long_sleep_pct": self._if(some, share(F.col("sleep_hours") > 10)),
            "onset_variance": self._if(n >= 2, self.var(bed)), "wake_variance": self._if(n >= 2, self.var("wake_hour")),
        }

    # clock
    def shift(self) -> Column:
        return (self.avg(E.evening_hour(F.col("bed_hour"))) - NORM_BED + self.avg("wake_hour") - NORM_WAKE) / 2

    def clock(self) -> dict[str, Column]:
        some = self.nights > 0
        shift = F.round(self.shift(), 9)
        l5 = self._if(self.acts > 0, self.avg((24 - F.col("sedentary_hours")) * 10))
        m10 = self._if(self.acts > 0, self.avg(F.col("active_hours") * 60 + F.col("energy") / 5))
        both = some & (self.acts > 0)
        contrast = F.when(m10 > 0, 1 - l5 / m10).otherwise(0.0)
        offset = F.pmod(self.avg("peak_hour") - self.avg("mid_hour"), F.lit(24.0)) - 9
        return {
            "l5_value": l5, "m10_value": m10, "l5_onset": F.lit(2), "m10_onset": F.lit(10),
            "phase_advance": self._if(some & (shift < -SHIFT_HOURS), -shift),
            "phase_delay": self._if(some & (shift > SHIFT_HOURS), shift),
            "phase_type": E.ladder((~some, "unknown"), (shift > SHIFT_HOURS, "delayed"), (shift < -SHIFT_HOURS, "advanced"),
                                   otherwise="normal"),
            "melatonin_onset": F.when(some, F.pmod(F.round(self.avg(E.evening_hour(F.col("bed_hour"))) - 2, 6), F.lit(24.0))),
            "temperature_nadir": F.when(some, F.pmod(F.round(self.avg("wake_hour") - 2, 6), F.lit(24.0))),
            "circadian_amplitude": self._if(both, E.clamp((contrast + self.avg("efficiency")) / 2, 0, 1)),
            "phase_angle": self._if(both & self.over(F.count("peak_hour")).cast("boolean"), E.ladder(
                (offset > 12, offset - 24), (offset < -12, offset + 24), otherwise=offset)),
        }

    # activity
    def activity(self) -> dict[str, Column]:
        n = self.acts
        has = F.col("steps").isNotNull()
        first = self.over(F.first(F.when(has, F.struct(F.col("change").alias("c"))), True))["c"]
        count = self.over(F.count("change")) - F.when(first.isNotNull(), 1).otherwise(0)
        change = (self.over(F.sum("change")) - F.coalesce(first, F.lit(0.0))) / F.nullif(count, F.lit(0))
        cv = lambda c: F.when(self.avg(c) > 0, E.clamp(self.std(c) / self.avg(c), 0, 1))
        parts = [F.when(count > 0, E.clamp(change * 2, 0, 1)), self.avg("variance"), cv("steps"), cv("energy")]
        used = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in parts])
        pieces = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
        high, low = self.over(F.count_if(F.col("steps") >= 10000)), self.over(F.count_if(F.col("steps") <= 5000))
        resting = self.over(F.collect_list(F.when(has, (F.col("sedentary_hours") >= 18).cast("int"))))
        streak = F.aggregate(
            resting, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
            lambda s, x: F.struct(((s.run + 1) * x).alias("run"), F.greatest(s.best, (s.run + 1) * x).alias("best")))["best"]
        ratio = F.col("active_hours") / F.nullif(F.col("active_hours") + F.col("sedentary_hours"), F.lit(0.0))
        strength = [
            F.when(self.over(F.count("peak_hour")) > 0, 1 / (1 + self.var("peak_hour") / 12)),
            F.when(self.over(F.count(ratio)) > 0, 1 - E.clamp(self.std(ratio) * 2, 0, 1)),
            F.when(n > 1, 1 / (1 + self.std("steps") / (self.avg("steps") + 1))),
        ]
        kept = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in strength])
        summed = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in strength])
        steady = lambda c: self._if(n > 1, 1 / (1 + self.var(c) / 6))
        return {
            "activity_fragmentation": self._if(n >= 2, pieces / F.nullif(used, F.lit(0))),
            "sedentary_mean_minutes": self._if(n > 0, self.avg("sedentary_hours") * 60),
            "sedentary_max_minutes": self._if(n > 0, self.over(F.max("sedentary_hours")) * 60),
            "sedentary_streak": streak,
            "high_days": high, "low_days": low, "moderate_days": n - high - low,
            "intensity_ratio": E.ladder((n == 0, F.lit(0.0)), (low > 0, high / low), (high > 0, high.cast("double")), otherwise=1.0),
            "rhythm_strength": self._if(n > 0, summed / F.nullif(kept, F.lit(0))),
            "onset_consistency": steady("first_hour"), "offset_consistency": steady("last_hour"),
        }

    # last seven readings
    def week(self) -> dict[str, Column]:
        def tail(c: str, name: str) -> dict[str, Column]:
            v = self.over(F.collect_list(c))
            seven = F.slice(v, F.greatest(F.size(v) - 6, F.lit(1)), 7)
            mean = F.when(F.size(v) > 0, E.vector_mean(seven)).otherwise(0.0)
            apart = F.when(F.size(v) > 0, F.sqrt(F.aggregate(
                seven, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(seven))).otherwise(0.0)
            return {f"{name}_7day_mean": mean, f"{name}_7day_std": apart}

        return {**tail("sleep_hours", "sleep"), **tail("steps", "activity"), **tail("avg_resting_hr", "hr")}


def _with_change(joined: DataFrame) -> DataFrame:
    before = F.last("steps", True).over(W.partitionBy("user_id").orderBy("date").rowsBetween(W.unboundedPreceding, -1))
    return joined.withColumn("change", F.when(before > 0, F.abs(F.col("steps") - before) / before))


def lookback_features(joined: DataFrame, *groups: str, days: int = 30, beside: dict[str, Column] | None = None) -> DataFrame:
    """Chosen feature groups (sleep, clock, activity, week) for every date of the joined table.

    ``beside`` adds columns of the joined table or other windows over the same
    user key, so they share its one exchange.
    """
    look = Lookback(R.days(-days))
    cols = {n: col for g in groups for n, col in getattr(look, g)().items()}
    beside = beside or {}
    framed = _with_change(joined).select(
        *KEY, *[col.alias(n) for n, col in look.framed.items()], *[col.alias(n) for n, col in beside.items()])
    return framed.select(*KEY, *[col.alias(n) for n, col in cols.items()], *beside)


def pattern_indicators(f: DataFrame) -> DataFrame:
    flags = {
        "is_hypersomnia": F.col("long_sleep_pct") > 50, "is_insomnia": F.col("short_sleep_pct") > 50,
        "is_advanced": F.col("phase_advance") > 2, "is_delayed": F.col("phase_delay") > 2,
        "is_irregular": F.col("sleep_regularity") < 70}
    weights = [0.2, 0.2, 0.15, 0.15, 0.3]
    f = f.withColumns(flags)
    return f.withColumn("mood_risk", reduce(lambda a, b: a + b, [
        F.when(F.col(n), w).otherwise(0.0) for n, w in zip(flags, weights)]))


def _running_columns() -> dict[str, Column]:
    w = R.rows(W.unboundedPreceding)

    def z(value: Column, kept: Column) -> Column:
        mean, std = F.avg(kept).over(w), F.stddev_pop(kept).over(w)
        return F.when(std > 0, (value - mean) / std).otherwise(0.0)

    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hr, hrv = F.col("avg_resting_hr"), F.col("avg_hrv")
    return {"sleep_z": z(zero("sleep_hours"), zero("sleep_hours")), "activity_z": z(zero("steps"), zero("steps")),
            "hr_z": z(zero(hr), F.when(hr != 70.0, hr)), "hrv_z": z(zero(hrv), F.when(hrv != 50.0, hrv))}


def running_scores(joined: DataFrame) -> DataFrame:
    """z of each sensor against its own running state; absent sleep and activity count as zero."""
    return joined.select(*KEY, *[v.alias(n) for n, v in _running_columns().items()])


def advanced_features(nights: DataFrame, acts: DataFrame, hearts: DataFrame) -> DataFrame:
    """The full lookback table: current values, all groups, running z-scores and pattern flags."""
    now = {c: F.coalesce(c, F.lit(0.0)) for c in ("sleep_hours", "efficiency", "steps", "avg_resting_hr", "avg_hrv")}
    return pattern_indicators(lookback_features(
        daily_join(nights, acts, hearts), "sleep", "clock", "activity", "week", beside={**now, **_running_columns()}))


def activity_anomalies(acts: DataFrame) -> DataFrame:
    """Days far outside the user's own range or the fixed limits."""
    mid = acts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.median("steps").alias("mid"))
    dev = acts.join(mid, "user_id").groupBy("user_id").agg(
        F.first("n").alias("n"), F.first("mid").alias("mid"), F.median(F.abs(F.col("steps") - F.col("mid"))).alias("mad"))
    steps, many = F.col("steps"), F.col("n") > 3
    high = (steps > 15000) | (F.col("energy") > 600) | ((F.col("active_hours") > 18) & (steps > 10000))
    low = (steps < 2000) | (F.col("energy") < 100) | (F.col("sedentary_hours") > 20)
    band = lambda k: F.round(F.col("mid") + k * F.col("mad"), 6)
    odd = (F.col("variance") > 0.7) | (many & ((F.round(steps, 6) > band(3)) | (F.round(steps, 6) < band(-3)))) | (steps < 0)
    return acts.join(dev, "user_id").select(
        *KEY, (high | (F.col("active_hours") > 16)).alias("is_hyperactive"), low.alias("is_hypoactive"), odd.alias("is_irregular")
    ).filter("is_hyperactive OR is_hypoactive OR is_irregular")


def alignment_score(onset: Column, wake: Column, peak: Column, spread: Column) -> Column:
    """Mean of full, half or no credit for onset, wake, peak hour and heart-rate range."""
    def credit(full: Column, half: Column, counted: Column) -> tuple[Column, Column]:
        return (E.ladder((full, 1.0), (half, 0.5), otherwise=0.0), (full | half | counted).cast("int"))

    parts = [
        credit(onset.between(22, 24) | onset.between(0, 1), onset.between(20, 26) | (onset <= 2), onset > 0),
        credit(wake.between(6, 8), wake.between(5, 9), wake > 0),
        credit(peak.between(10, 18), peak.between(8, 20), peak > 0),
        credit(spread.between(10, 30), spread.between(5, 40), spread > 0)]
    n = reduce(lambda a, b: a + b, [k for _, k in parts])
    return F.when(n > 0, reduce(lambda a, b: a + b, [s for s, _ in parts]) / n).otherwise(0.0)


def basic_features(nights: DataFrame, acts: DataFrame, hearts: DataFrame) -> DataFrame:
    """Thirteen daily values with significance notes for every date any sensor has."""
    n = nights.select(*KEY, "sleep_hours", "efficiency", "fragmentation", (F.floor(F.col("bedtime_minute") + 1e-9) / 60).alias("onset"),
                      (F.floor(F.col("wake_minute") + 1e-9) / 60).alias("wake"), F.lit(True).alias("has_sleep"))
    a = acts.select(*KEY, "steps", "variance", "sedentary_hours", "peak_hour", "energy", "active_hours", F.lit(True).alias("has_act"))
    h = hearts.select(*KEY, "avg_resting_hr", "avg_hrv", "min_hrv", "hr_range", "high_episodes", "low_episodes",
                      F.lit(True).alias("has_heart"))
    j = n.join(a, KEY, "full").join(h, KEY, "full")
    s, e, fr = F.col("sleep_hours"), F.col("efficiency"), F.col("fragmentation")
    st, en, sd = F.col("steps"), F.col("energy"), F.col("sedentary_hours")
    high = (st > 15000) | (en > 600) | ((F.col("active_hours") > 18) & (st > 10000))
    low = (st < 2000) | (en < 100) | (sd > 20)
    erratic = F.col("variance") > 0.5
    fast = F.col("avg_resting_hr") > 90
    weak = lambda c: (F.col(c) > 0) & (F.col(c) < 20)
    weak = weak("avg_hrv") | weak("min_hrv")
    flat = (F.col("hr_range") != 0) & ((F.col("hr_range") < 10) | (F.col("hr_range") > 30))
    sleep_odd = (s < 4) | (s > 10) | (e < 0.7) | (fr > 0.3)
    heart_odd = fast | weak | flat | (F.col("high_episodes") > 10) | (F.col("low_episodes") > 5)
    notes = E.messages(
        (s < 4, wording.SEVERE_SLEEP_DEPRIVATION), (s > 10, wording.HYPERSOMNIA_PATTERN), (e < 0.7, wording.POOR_SLEEP_EFFICIENCY),
        (high, wording.HYPERACTIVITY_PATTERN), (~high & low, wording.HYPOACTIVITY_PATTERN), (erratic, wording.ERRATIC_ACTIVITY_PATTERN),
        (fast, wording.ELEVATED_RESTING_HEART), (weak, wording.LOW_HRV_INDICATES),
        (flat, wording.ABNORMAL_HEART_RATE))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    peak = F.coalesce("peak_hour", F.lit(0))
    return j.select(
        *KEY, *[zero(c).alias(c) for c in ("sleep_hours", "efficiency", "fragmentation", "onset", "wake", "steps", "variance",
                                           "sedentary_hours", "avg_resting_hr", "avg_hrv", "hr_range")],
        peak.alias("peak_hour"),
        alignment_score(zero("onset"), zero("wake"), peak, zero("hr_range")).alias("alignment"),
        (F.coalesce(sleep_odd, F.lit(False)) | F.coalesce(high | low | erratic, F.lit(False))
         | F.coalesce(heart_odd, F.lit(False))).alias("is_significant"),
        notes.alias("notes"))


def pattern_notes(f: DataFrame) -> DataFrame:
    notes = E.messages(
        (F.col("is_insomnia"), wording.INSOMNIA_PATTERN_DETECTED),
        (F.col("is_hypersomnia"), wording.HYPERSOMNIA_PATTERN_DETECTED_CONSISTENTLY),
        (F.col("is_irregular"), wording.IRREGULAR_SLEEP_PATTERN),
        (F.col("interdaily_stability") < 0.3, wording.VERY_LOW_CIRCADIAN))
    return f.select(*KEY, (F.size(notes) > 0).alias("is_significant"), notes.alias("notes"))


def validation(f: DataFrame) -> DataFrame:
    """Missing domains, warnings and a quality score per feature row."""
    s, st = F.col("sleep_hours"), F.col("steps")
    missing = E.messages((s == 0, "sleep"), (st == 0, "activity"))
    warnings = E.messages(
        ((s > 0) & (s < 3), wording.UNUSUALLY_LOW_SLEEP), (s > 12, wording.UNUSUALLY_HIGH_SLEEP),
        ((st > 0) & (st < 100), wording.UNUSUALLY_LOW_ACTIVITY),
        ((F.col("sleep_7day_mean") == 0) & (F.col("activity_7day_mean") == 0),
         wording.INSUFFICIENT_HISTORICAL_DATA))
    return f.select(*KEY, (F.size(missing) == 0).alias("is_valid"), missing.alias("missing"), warnings.alias("warnings"),
                    E.clamp(1 - F.size(missing) / 3.0 - F.size(warnings) * 0.05, 0, 1).alias("quality"))


def feature_anomalies(f: DataFrame) -> DataFrame:
    """Distinct anomalous domains and the largest severity."""
    s, st = F.col("sleep_hours"), F.col("steps")
    rules = [
        (F.col("is_hypersomnia") | F.col("is_insomnia"), "sleep", 0.7), (s < 3, "sleep", 0.8), (s > 12, "sleep", 0.6),
        (F.col("efficiency") < 0.7, "sleep", 0.5), (F.col("sleep_regularity") < 50, "sleep_regularity", 0.6),
        (F.col("is_advanced") | F.col("is_delayed"), "circadian", 0.5), (F.col("activity_fragmentation") > 0.8, "activity", 0.6),
        (st < 1000, "activity", 0.5), (st > 20000, "activity", 0.6)]
    domains = F.array_distinct(E.messages(*[(r, d) for r, d, _ in rules]))
    severity = F.greatest(F.lit(0.0), *[F.when(r, w).otherwise(0.0) for r, _, w in rules])
    return f.select(*KEY, (F.size(domains) > 0).alias("has_anomalies"), domains.alias("domains"), severity.alias("severity"))


def unified(f: DataFrame, trends: DataFrame) -> DataFrame:
    """Features grouped in structs, as exchanged between services."""
    pick = lambda *names: F.struct(*names)
    return f.join(trends, KEY, "left").select(
        *KEY,
        pick("sleep_hours", "efficiency", "sleep_regularity", "interdaily_stability", "intradaily_variability",
             "relative_amplitude", "short_sleep_pct", "long_sleep_pct", "onset_variance", "wake_variance").alias("sleep"),
        pick("l5_value", "m10_value", "phase_advance", "phase_delay", "circadian_amplitude", "phase_angle").alias("clock"),
        pick("steps", "activity_fragmentation", "sedentary_mean_minutes", "sedentary_max_minutes", "intensity_ratio",
             "rhythm_strength").alias("activity"),
        pick("sleep_7day_mean", "sleep_7day_std", "activity_7day_mean", "activity_7day_std", "hr_7day_mean", "hr_7day_std",
             "trend_slope", "momentum").alias("temporal"),
        pick("is_hypersomnia", "is_insomnia", "is_advanced", "is_delayed", "is_irregular", "mood_risk").alias("patterns"))


def flattened(nested: DataFrame) -> DataFrame:
    return nested.select(*KEY, "sleep.*", "clock.*", "activity.*", "temporal.*", "patterns.*")


def for_dates(features: DataFrame, calendar: DataFrame) -> DataFrame:
    """A row for every requested date; dates without features hold nulls."""
    return calendar.select(*KEY).join(features, KEY, "left")


def pipeline_table(window_metrics: DataFrame, nights: DataFrame, step_metrics: DataFrame, wide_hours: DataFrame,
                   calendar: DataFrame, eligible: DataFrame, legacy_names: bool = False) -> DataFrame:
    """Daily feature row: window metrics with 30-row statistics, rhythm and activity.

    Rhythm statistics run over the ``eligible`` days (user, date) that have a
    rhythm, whether or not the day has sleep.
    """
    metrics = [c for c in window_metrics.columns if c not in KEY]
    stats = R.mean_std_z(window_metrics, metrics)
    both = C.lookback_rhythm(wide_hours, calendar).select(*KEY, F.col("relative_amplitude").alias("circadian_amplitude")).join(
        eligible, KEY)
    clock = R.mean_std_z(both, ["circadian_amplitude"], least=1)
    rows = stats.join(clock, KEY, "left").join(nights.select(*KEY, "sleep_hours"), KEY, "left").join(step_metrics, KEY, "left")
    out = _pipeline_row(rows, metrics)
    return out.withColumn("interdaily_stability", F.col("relative_amplitude")) if legacy_names else out


def day_facts(sleep: DataFrame, activity: DataFrame) -> DataFrame:
    """One row per user and day that has sleep or activity: all that the daily feature table is made of.

    Activity is read once, to hourly sums; sleep twice, as windows belong to start dates and
    hours slept to nights. Every later step works on these rows, so they are worth storing.
    """
    windows = I.daily_window_metrics(sleep, counted=True)
    nights = D.daily_sleep(sleep).select(*KEY, "sleep_hours")
    steps = D.step_metrics(D.hour_bins(activity), *[f"r{h}" for h in D.HOURS])
    return windows.join(steps, KEY, "full").join(nights, KEY, "full")


def pipeline_from_facts(facts: DataFrame, window: int = 14, least: int = 3) -> DataFrame:
    """`pipeline_table` from (stored) rows of `day_facts`.

    Days with ``least`` sleep records or more in their last ``window`` days are eligible for the
    rhythm statistics.
    """
    metrics = facts.columns[facts.columns.index("sleep_percentage"):facts.columns.index("short_wt") + 1]
    shown = ["sleep_hours", "daily_steps", "activity_variance", "sedentary_hours", "activity_fragmentation", "sedentary_bout_mean",
             "activity_intensity_ratio"]
    stats = R.mean_std_z(facts.filter("records IS NOT NULL").select(*KEY, *metrics, *shown), metrics)
    begun = facts.filter("records IS NOT NULL OR r0 IS NOT NULL")
    hours = begun.select(*KEY, "records", *[F.col(f"r{h}").alias(f"h{h}") for h in D.HOURS])
    recent = F.sum("records").over(R.rows(-(window - 1)))
    clock = C.lookback_rhythm(hours, C.user_calendar(begun), beside={"recent": recent}).filter(F.col("recent") >= least)
    clock = R.mean_std_z(clock.select(*KEY, F.col("relative_amplitude").alias("circadian_amplitude")), ["circadian_amplitude"], least=1)
    return _pipeline_row(stats.join(clock, KEY, "left"), metrics)


def _pipeline_row(rows: DataFrame, metrics: list[str]) -> DataFrame:
    zero = lambda c, d=0.0: F.coalesce(c, F.lit(d)).alias(c)
    shown = F.greatest(F.lit(1), F.col("long_num") + F.col("short_num"))
    return rows.select(
        *KEY, F.coalesce("sleep_hours", F.lit(0.0)).alias("sleep_duration_hours"),
        (F.col("short_num") / shown).alias("short_window_pct"), (F.col("long_num") / shown).alias("long_window_pct"),
        F.coalesce("circadian_amplitude", F.lit(0.0)).alias("relative_amplitude"),
        *[F.col(f"{m}_{k}") for m in metrics for k in ("mean", "std", "zscore")],
        *[zero(f"circadian_amplitude_{k}") for k in ("mean", "std", "zscore")],
        zero("daily_steps"), zero("activity_variance"), zero("sedentary_hours", 24.0), zero("activity_fragmentation"),
        zero("sedentary_bout_mean", 24.0), zero("activity_intensity_ratio"))


def model_vector(advanced: DataFrame, onset_wake: DataFrame, fragments: DataFrame, variance: DataFrame, heart: DataFrame,
                 principal: DataFrame) -> DataFrame:
    """The 36 ordered inputs as an array; absent pieces use their defaults."""
    f = advanced.withColumn("sedentary_day_hours", F.col("sedentary_mean_minutes") / 60)
    # the advanced table has no onset or wake clock of its own
    for part in (onset_wake, fragments, variance, heart, principal):
        f = f.join(part, KEY, "left")
    # no phase is estimated: its inputs take their defaults
    f = f.withColumn("dlmo_hour", F.lit(None).cast("double")).withColumn("dlmo_confidence", F.lit(None).cast("double"))
    defaults = {"onset_hour": 23.0, "wake_hour": 7.0, "dlmo_hour": 21.0, "lowest_hour": 4.0, "pat_hour": 14.0}
    return f.select(*KEY, F.array(*[
        F.coalesce(F.col(c).cast("double"), F.lit(defaults.get(c, 0.0))) for c in VECTOR_FIELDS]).alias("vector"))


def vector_confidence(vector: Column) -> Column:
    """Share of non-zero inputs and of every third input inside three deviations, averaged."""
    filled = F.size(F.filter(vector, lambda x: x != 0)) / 36.0
    calm = F.size(F.filter(vector, lambda x, i: (i % 3 == 2) & (F.abs(x) < 3))) / 12.0
    return E.clamp((filled + calm) / 2, 0, 1)


def normalized_table(features: DataFrame, columns: list[str]) -> DataFrame:
    return features.select(*KEY, *[E.normalized(c, F.col(c)).alias(c) for c in columns])
