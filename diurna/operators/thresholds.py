"""Cut-offs of the rules as data: a typed parameter table, one row per scope and name.

A row holds for one user, for a cohort, or for everyone (neither named); the narrowest scope
that has a value wins, and what no row sets has the default. `attach` gives each row of a table
its own `limits`, which the rules read in place of constants. The parameter table is reduced to
one row per scope before it is joined, so the join adds no rows and follows the size of the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diurna import schemas as S
from diurna.functions import exprs as E

PARAMETERS = "user_id long, cohort string, name string, value double"

#: Every name that a parameter table may set, with its default.
DEFAULTS: dict[str, float] = {
    **{f"phq_{k}_max": v for k, v in S.PHQ_MAX.items()}, **{f"phq_{k}_min": v for k, v in S.PHQ_MIN.items()},
    **{f"asrm_{k}_max": v for k, v in S.ASRM_MAX.items()}, **{f"asrm_{k}_min": v for k, v in S.ASRM_MIN.items()},
    "hypersomnia_hours": S.HYPERSOMNIA_HOURS, "normal_sleep_min": S.NORMAL_SLEEP_MIN, "critical_sleep": S.CRITICAL_SLEEP,
    "reduced_sleep": S.REDUCED_SLEEP, "severe_low_steps": S.SEVERE_LOW_STEPS, "elevated_steps": S.ELEVATED_STEPS,
    "extreme_steps": S.EXTREME_STEPS, **{f"{k}_days": v for k, v in S.REQUIRED_DAYS.items()}, **S.BIOMARKERS, **S.EARLY_WARNING,
    "sleep_sensitivity": 1.0, "activity_sensitivity": 1.0,
}
#: Names whose values must rise from left to right.
RISING = [
    [f"phq_{k}_max" for k in S.PHQ_MAX], [f"phq_{k}_min" for k in S.PHQ_MIN], [f"asrm_{k}_max" for k in S.ASRM_MAX],
    [f"asrm_{k}_min" for k in S.ASRM_MIN], ["critical_sleep", "reduced_sleep", "normal_sleep_min", "hypersomnia_hours"],
    ["severe_low_steps", "elevated_steps", "extreme_steps"],
]
SENSITIVITIES = ["sleep_sensitivity", "activity_sensitivity"]


def checked(parameters: DataFrame) -> DataFrame:
    """The parameter rows with a ``reason`` that is null where a row may be used."""
    times = F.count(F.lit(1)).over(W.partitionBy("user_id", "cohort", "name"))
    reason = E.ladder(
        (F.col("name").isNull() | ~F.col("name").isin(list(DEFAULTS)), "unknown name"),
        (F.col("value").isNull() | F.isnan("value"), "no value"), (F.col("value") < 0, "negative value"),
        (F.col("user_id").isNotNull() & F.col("cohort").isNotNull(), "two scopes"), (times > 1, "set twice"), otherwise=F.lit(None))
    return parameters.select("user_id", "cohort", "name", "value", reason.alias("reason"))


def _wide(rows: DataFrame, scope: str) -> DataFrame:
    return rows.groupBy(scope).agg(F.struct(*[
        F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in DEFAULTS]).alias(f"_{scope}_limits"))


def attach(df: DataFrame, parameters: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """df with ``limits`` (a value per name), ``personal`` and ``limits_rise``.

    members: (user_id, cohort), one row per user. personal: the user has an own sensitivity.
    limits_rise: false where the combined values of a row break an order of `RISING`. Rows
    that `checked` rejects are not used.
    """
    rows = checked(parameters).filter("reason IS NULL").drop("reason")
    # as many scalars as there are names
    general = dict(rows.filter("user_id IS NULL AND cohort IS NULL").select("name", "value").collect())
    out = df.join(_wide(rows.filter("user_id IS NOT NULL"), "user_id"), "user_id", "left")
    sources = ["_user_id_limits"]
    if members is not None:
        cohorts = members.select("user_id", "cohort").join(_wide(rows.filter("cohort IS NOT NULL"), "cohort"), "cohort")
        out = out.join(cohorts.select("user_id", "_cohort_limits"), "user_id", "left")
        sources.append("_cohort_limits")
    limits = F.struct(*[
        F.coalesce(*[F.col(f"{s}.{n}") for s in sources], F.lit(float(general.get(n, d)))).alias(n) for n, d in DEFAULTS.items()])
    personal = F.lit(False)
    for n in SENSITIVITIES:
        personal = personal | F.col(f"_user_id_limits.{n}").isNotNull()
    rise = F.lit(True)
    for names in RISING:
        for a, b in zip(names, names[1:]):
            rise = rise & (F.col(f"limits.{a}") < F.col(f"limits.{b}"))
    return out.withColumn("limits", limits).select(*df.columns, "limits", personal.alias("personal"), rise.alias("limits_rise"))


def limit_of(df: DataFrame) -> Callable[[str], Column]:
    """Reads a name from the rows' own limits, or gives the default where df has none."""
    if "limits" in df.columns:
        return lambda name: F.col("limits")[name]
    return lambda name: F.lit(DEFAULTS[name])
