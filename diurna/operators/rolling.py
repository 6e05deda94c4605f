"""Rolling and whole-history features over daily rows.

Every function takes a daily frame (one row per user and date, so a user has at
most as many rows as the calendar has days) and the metric as a Column.
``rows`` frames count days that have data; ``days`` frames count calendar days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diurna.functions import exprs as E

KEY = ["user_id", "date"]
START = W.unboundedPreceding


def in_order() -> WindowSpec:
    return W.partitionBy("user_id").orderBy("date")


def rows(first: int, last: int = 0) -> WindowSpec:
    return in_order().rowsBetween(first, last)


def days(first: int, last: int = 0) -> WindowSpec:
    return W.partitionBy("user_id").orderBy(F.unix_date("date")).rangeBetween(first, last)


def _series(daily: DataFrame, metric: str | Column) -> DataFrame:
    """The metric as ``y`` with its position in the user's history."""
    return daily.select(*KEY, E.col(metric).cast("double").alias("y")).withColumn(
        "pos", F.row_number().over(in_order())
    )


def _std(y: Column, w: WindowSpec) -> Column:
    return F.coalesce(F.when(F.count(y).over(w) >= 2, F.stddev_pop(y).over(w)), F.lit(0.0))


def _slope(w: WindowSpec) -> Column:
    return F.coalesce(F.regr_slope(F.col("y"), F.col("pos")).over(w), F.lit(0.0))


def mean_std_z(daily: DataFrame, metrics: list[str], size: int = 30, least: int = 3) -> DataFrame:
    """Mean, population deviation and z of the current row over the last ``size`` rows."""
    w = rows(-(size - 1))
    out = []
    for m in metrics:
        y = F.col(m).cast("double")
        mean, std = F.avg(y).over(w), F.stddev_pop(y).over(w)
        out += [mean.alias(f"{m}_mean"), std.alias(f"{m}_std"),
                F.when(std > 1e-12, (y - mean) / std).otherwise(0.0).alias(f"{m}_zscore")]
    counted = daily.select("*", F.count(F.lit(1)).over(w).alias("in_frame"), *out)
    return counted.filter(F.col("in_frame") >= least).drop("in_frame")


def statistics(daily: DataFrame, metric: str | Column, size: int) -> DataFrame:
    w, y = rows(-(size - 1)), F.col("y")
    return _series(daily, metric).select(
        *KEY, F.avg(y).over(w).alias("mean"), _std(y, w).alias("std"),
        F.min(y).over(w).alias("min"), F.max(y).over(w).alias("max"), _slope(w).alias("trend"),
    )


def trend(daily: DataFrame, metric: str | Column, size: int, stable_below: float = 0.1) -> DataFrame:
    """Slope, fit and mean second difference, which telescopes to two first differences."""
    w, y = rows(-(size - 1)), F.col("y")
    s = _series(daily, metric).withColumn("step", y - F.lag("y").over(in_order()))
    n, mean = F.count(y).over(w), F.avg(y).over(w)
    bend = (F.col("step") - F.nth_value("step", 2).over(w)) / (n - 2)
    flat = F.stddev_pop(y).over(w) < 1e-12
    return s.select(
        *KEY, _slope(w).alias("slope"),
        F.when((n >= 2) & ~flat, F.regr_r2(y, F.col("pos")).over(w)).otherwise(0.0).alias("r_squared"),
        F.when(n > 2, bend).otherwise(0.0).alias("acceleration"),
        (F.round(_slope(w), 9) > 0).alias("is_increasing"),
        ((n < 2) | (E.ratio(_std(y, w), mean) < stable_below)).alias("is_stable"),
    )


def _quantile(sorted_values: Column, p: float) -> Column:
    at = (F.size(sorted_values) - 1) * F.lit(float(p))
    lo = F.floor(at).cast("int")
    hi = F.ceil(at).cast("int")
    a, b = F.get(sorted_values, lo), F.get(sorted_values, hi)
    return a + (b - a) * (at - lo)


def variability(daily: DataFrame, metric: str | Column, size: int) -> DataFrame:
    """CV, range, interquartile range and median deviation over at most ``size`` values."""
    w, y = rows(-(size - 1)), F.col("y")
    framed = _series(daily, metric).select(
        *KEY, F.array_sort(F.collect_list(y).over(w)).alias("v"),
        E.ratio(_std(y, w), F.avg(y).over(w)).alias("cv"),
    )
    framed = framed.withColumn("mid", _quantile(F.col("v"), 0.5)).withColumn(
        "dev", F.array_sort(F.transform("v", lambda x: F.abs(x - F.col("mid"))))
    )
    v = F.col("v")
    return framed.select(
        *KEY, "cv", (F.array_max(v) - F.array_min(v)).alias("value_range"),
        (_quantile(v, 0.75) - _quantile(v, 0.25)).alias("iqr"),
        _quantile(F.col("dev"), 0.5).alias("mad"),
    )


def anomaly_scores(daily: DataFrame, metric: str | Column, size: int) -> DataFrame:
    """Distance from the mean of the rows before, in their deviations."""
    w, y = rows(-size, -1), F.col("y")
    std = _std(y, w)
    return _series(daily, metric).select(
        *KEY, F.when(std > 1e-12, F.abs(y - F.avg(y).over(w)) / std).otherwise(0.0).alias("score")
    )


def change_points(daily: DataFrame, metric: str | Column, segment: int = 5, effect: float = 0.8) -> DataFrame:
    before, after, y = rows(-segment, -1), rows(0, segment - 1), F.col("y")
    shift = F.avg(y).over(after) - F.avg(y).over(before)
    pooled = F.sqrt((F.var_pop(y).over(before) + F.var_pop(y).over(after)) / 2)
    total = F.count(F.lit(1)).over(W.partitionBy("user_id"))
    index = F.col("pos") - 1
    return (
        _series(daily, metric)
        .select(*KEY, index.alias("position"), total.alias("total"), shift.alias("magnitude"),
                pooled.alias("pooled"))
        .filter((F.col("position") >= segment) & (F.col("position") < F.col("total") - segment)
                & (F.col("pooled") > 0) & (F.abs("magnitude") / F.col("pooled") > effect))
        .select(*KEY, "position", "magnitude",
                F.when(F.col("magnitude") > 0, "increase").otherwise("decrease").alias("direction"))
    )


def momentum(daily: DataFrame, metric: str | Column, short: int = 3, long: int = 7) -> DataFrame:
    n = F.col("pos")
    quick = F.when(n >= short, _slope(rows(-(short - 1)))).otherwise(0.0)
    slow = F.when(n >= long, _slope(rows(-(long - 1)))).otherwise(quick)
    s = _series(daily, metric).select(*KEY, quick.alias("short_term"), slow.alias("long_term"))
    gap = F.col("short_term") - F.col("long_term")
    return s.select("*", gap.alias("divergence"),
                    ((F.round(gap, 9) > 0) & (F.round("short_term", 9) > 0)).alias("is_accelerating"))


def overall_slope(daily: DataFrame, metric: str | Column) -> DataFrame:
    """Slope of the whole series on its position; fewer than three rows give 0."""
    return _series(daily, metric).groupBy("user_id").agg(
        F.when(F.count(F.lit(1)) >= 3, F.coalesce(F.regr_slope("y", "pos"), F.lit(0.0)))
        .otherwise(0.0).alias("slope")
    )


def periodicity(daily: DataFrame, metric: str | Column, longest: int = 7) -> DataFrame:
    """Strongest autocorrelation among the lags and the residue class with the highest mean."""
    whole, y = W.partitionBy("user_id"), F.col("y")
    s = _series(daily, metric)
    s = s.select(
        "user_id", "date", "y", "pos",
        ((y - F.avg(y).over(whole)) / (F.stddev_pop(y).over(whole) + 1e-10)).alias("z"),
    )
    lags = range(2, longest + 1)
    s = s.select("*", *[(F.col("z") * F.lead("z", p).over(in_order())).alias(f"c{p}") for p in lags])
    n = F.count(F.lit(1))
    aggs = [F.when(F.floor(n / 2) > p, F.round(F.sum(f"c{p}") / (n - p), 9)).alias(f"r{p}")
            for p in lags]
    phases = [F.array(*[F.round(F.avg(F.when((F.col("pos") - 1) % p == k, y)), 9) for k in range(p)]).alias(f"m{p}")
              for p in lags]
    g = s.groupBy("user_id").agg(n.alias("n"), *aggs, *phases)
    best = F.greatest(*[F.abs(f"r{p}") for p in lags], F.lit(0.0))
    found = (F.col("n") >= 2 * longest) & (F.col("best") > 0)
    period = E.ladder(*[(F.abs(F.col(f"r{p}")) == F.col("best"), p) for p in lags], otherwise=0)
    g = g.withColumn("best", best).withColumn("period", F.when(found, period).otherwise(0))
    phase = E.ladder(
        *[(F.col("period") == p,
           F.array_position(f"m{p}", F.array_max(f"m{p}")).cast("double") - 1) for p in lags],
        otherwise=F.lit(0.0),
    )
    return g.select("user_id", F.col("period").alias("dominant_period_days"),
                    F.when(F.col("period") > 0, F.col("best")).otherwise(0.0).alias("period_strength"),
                    phase.alias("phase_shift"))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided Student t probability for whole degrees of freedom (finite trigonometric series)."""
    theta = F.atan(t / F.sqrt(df))
    s, c2 = F.sin(theta), F.cos(theta) * F.cos(theta)

    def series(first: Column, top: Column, term) -> Column:
        """first * (1 + term(1) + term(1)term(2) + ...) up to ``top`` factors."""
        steps = F.when(top >= 1, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>"))
        state = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("s"))
        folded = F.aggregate(
            steps, state,
            lambda a, k: F.struct((a.p * term(k)).alias("p"), (a.s + a.p * term(k)).alias("s")),
        )
        return first * folded.s

    even = series(s, (df / 2 - 1).cast("int"), lambda k: c2 * (2 * k - 1) / (2 * k))
    odd_sum = series(s * F.cos(theta), ((df - 3) / 2).cast("int"), lambda k: c2 * (2 * k) / (2 * k + 1))
    odd = (theta + F.when(df > 1, odd_sum).otherwise(0.0)) * (2 / 3.141592653589793)
    return F.greatest(F.lit(0.0), 1 - F.when(df % 2 == 0, even).otherwise(odd))


def _corr(a: str, b: str) -> Column:
    """Pearson over rows that have both; null where one side is constant, as ``F.corr`` divides by zero there."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))  # exact, also if merged means differ by noise
    return F.when(~constant, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def correlation(a: DataFrame, b: DataFrame, x: str | Column, y: str | Column, lag: int = 0,
                level: float = 0.05) -> DataFrame:
    """Pearson and Spearman over common dates; a positive lag pairs x with y ``lag`` rows later."""
    # rounding lets values that differ by summation noise share a rank
    both = a.select(*KEY, F.round(E.col(x).cast("double"), 9).alias("x")).join(
        b.select(*KEY, F.round(E.col(y).cast("double"), 9).alias("y")), KEY)
    total = F.count(F.lit(1)).over(W.partitionBy("user_id"))
    w = in_order()
    shifted = F.lead("y", lag).over(w) if lag >= 0 else F.lag("y", -lag).over(w)
    pairs = both.select("user_id", "x", F.when(total > abs(lag), shifted).otherwise(F.col("y")).alias("y"))
    pairs = pairs.filter(F.col("y").isNotNull())

    def rank(c: str) -> Column:
        tie = W.partitionBy("user_id", c)
        return F.rank().over(W.partitionBy("user_id").orderBy(c)) + (F.count(F.lit(1)).over(tie) - 1) / 2

    g = pairs.select("*", rank("x").alias("rx"), rank("y").alias("ry")).groupBy("user_id").agg(
        F.count(F.lit(1)).cast("int").alias("n"), _corr("x", "y").alias("r"), _corr("rx", "ry").alias("rho"))
    enough = F.col("n") >= 3
    weakest = F.least(F.abs("r"), F.abs("rho"))
    df = F.col("n") - 2
    t = F.sqrt(df / (1 - weakest * weakest)) * weakest
    p = E.ladder((~enough | weakest.isNull(), F.lit(1.0)), (weakest >= 1 - 1e-12, F.lit(0.0)),
                 otherwise=t_two_sided(t, df))
    zero = lambda c: F.when(enough, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return g.select("user_id", "n", zero("r").alias("pearson_r"), zero("rho").alias("spearman_rho"),
                    p.alias("p_value"), (p < level).alias("is_significant"))


def day_over_day(daily: DataFrame, metric: str | Column) -> DataFrame:
    """Mean relative change from the row before, where that row is positive."""
    before = F.lag("y").over(in_order())
    change = F.when(before > 0, F.abs(F.col("y") - before) / before)
    return _series(daily, metric).select("user_id", change.alias("change")).groupBy("user_id").agg(
        F.coalesce(F.avg("change"), F.lit(0.0)).alias("mean_change"))


def latest_per_user(records: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Most recent ``n`` per user; the rank limit is applied before the shuffle as well."""
    w = W.partitionBy("user_id").orderBy(*order)
    return records.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


# ---- baselines that grow with history -----------------------------------------

def incremental_baseline(daily: DataFrame, metric: str | Column,
                         seed: tuple[float, float, int] | DataFrame | None = None) -> DataFrame:
    """Running mean and deviation, from count, mean and squared deviations.

    A stored (mean, std, points) seeds the state as at least seven observations:
    one triple for everybody, or a row (user_id, mean, std, n) per user. The seed
    and the running state are merged by the pairwise formula, so nothing cancels.
    """
    w, y = rows(START), F.col("y")
    s = daily.select(*KEY, E.col(metric).cast("double").alias("y"))
    if isinstance(seed, DataFrame):
        stored = seed.select("user_id", *[F.col(c).alias(f"{c}0") for c in ("mean", "std", "n")])
        s = s.join(stored, "user_id", "left")
    else:
        mean0, std0, n0 = seed or (0.0, 0.0, 0)
        s = s.withColumns({"mean0": F.lit(mean0).cast("double"), "std0": F.lit(std0).cast("double"), "n0": F.lit(n0)})
    before = F.when(F.coalesce("mean0", F.lit(0.0)) != 0, F.greatest(F.coalesce("n0", F.lit(0)), F.lit(7))).otherwise(0)
    s = s.select(
        *KEY, "y", before.cast("long").alias("n0"), F.coalesce("mean0", F.lit(0.0)).alias("mean0"),
        F.coalesce("std0", F.lit(0.0)).alias("std0"), F.count(y).over(w).alias("n1"),
        F.coalesce(F.avg(y).over(w), F.lit(0.0)).alias("mean1"), F.coalesce(F.stddev_pop(y).over(w), F.lit(0.0)).alias("std1"))
    c = F.col
    n, apart = c("n0") + c("n1"), c("mean1") - c("mean0")
    mean = F.when(c("n0") == 0, c("mean1")).otherwise(c("mean0") + apart * c("n1") / n)
    spread = (c("n0") * c("std0") * c("std0") + c("n1") * c("std1") * c("std1") + apart * apart * c("n0") * c("n1") / n) / n
    some = lambda x: F.when(n > 0, x)
    return s.select(*KEY, "y", n.alias("n"), some(mean).alias("mean"),
                    F.when(n > 1, F.when(c("n0") == 0, c("std1")).otherwise(F.sqrt(spread))).otherwise(0.0).alias("std"))


def individual_z(daily: DataFrame, metric: str | Column, ignored: float | None = None) -> DataFrame:
    """z of each day against the state that already includes it; default values stay out of the state."""
    kept = metric if ignored is None else F.when(E.col(metric) != ignored, E.col(metric))
    state = incremental_baseline(daily, kept)
    raw = daily.select(*KEY, E.col(metric).cast("double").alias("value"))
    std = F.col("std")
    return state.join(raw, KEY).select(
        *KEY, F.when(std > 0, (F.col("value") - F.col("mean")) / std).otherwise(0.0).alias("zscore"))


def risk_trajectory(daily: DataFrame, score: str | Column) -> DataFrame:
    """Direction of the score over the whole history up to each date."""
    w = rows(START)
    s = _series(daily, score).select(*KEY, "pos", F.round(_slope(w), 9).alias("slope"))
    velocity = F.when(F.col("pos") >= 3, F.col("slope")).otherwise(0.0)
    return s.select(
        *KEY, velocity.alias("velocity"),
        E.ladder((velocity > 0.1, "worsening"), (velocity < -0.1, "improving"), otherwise="stable").alias("trend"),
        E.ladder((F.col("pos") < 3, "unknown"), (velocity > 0.1, "continued_worsening"),
                 (velocity < -0.1, "continued_improvement"), otherwise="stable").alias("predicted"),
    )


def longitudinal_pattern(daily: DataFrame, score: str | Column) -> DataFrame:
    """Last step against +-3 points, and whether the whole history is monotone."""
    w, step = rows(START), F.col("step")
    s = _series(daily, score).withColumn("step", F.col("y") - F.lag("y").over(in_order()))
    first = F.col("pos") == 1
    trajectory = E.ladder((first, "unknown"), (step > 3, "worsening"), (step < -3, "improving"), otherwise="stable")
    pattern = E.ladder((first, "insufficient_data"), (F.min(step).over(w) >= 0, "escalating_depression"),
                       (F.max(step).over(w) <= 0, "improving_depression"), otherwise="fluctuating")
    s = s.select(*KEY, trajectory.alias("trajectory"), pattern.alias("pattern"),
                 F.least(0.5 + (F.col("pos") - 1) * 0.1, F.lit(0.9)).alias("confidence"))
    rising = (F.col("trajectory") == "worsening") & (F.col("pattern") == "escalating_depression")
    return s.withColumn("projection", E.ladder(
        (rising, "high_risk_for_episode"), (F.col("trajectory") == "improving", "decreasing_risk"),
        otherwise="stable_risk"))
