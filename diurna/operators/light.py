"""Light profiles by hour, and the days with enough sleep records for a rhythm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diurna.functions import exprs as E
from diurna.operators import intervals as I

KEY = ["user_id", "date"]

# Light levels.
AWAKE_LUX, ASLEEP_LUX = 250.0, 0.0
ACTIVITY_STEPS = [(0.7, 500.0), (0.4, 300.0), (0.25, 150.0), (0.1, 50.0), (0.0, 0.0)]


# ---- profiles ------------------------------------------------------------------

def sleep_masks(sleep: DataFrame) -> DataFrame:
    """Bit h of the mask is set when clock hour h overlaps any sleep of that date."""
    bit = F.pow(F.lit(2.0), F.col("hour")).cast("int")
    return I.sleep_hours_of_day(sleep).groupBy(*KEY).agg(F.bit_or(bit).alias("mask"))


def mask_lux(mask: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(23)),
        lambda h: F.when(F.floor(mask / F.pow(F.lit(2.0), h)) % 2 == 1, ASLEEP_LUX).otherwise(AWAKE_LUX))


def sleep_light(sleep: DataFrame) -> DataFrame:
    """Hourly lux of every date with sleep: bright when awake, dark when asleep."""
    return sleep_masks(sleep).select(*KEY, mask_lux(F.col("mask")).alias("lux"))


def activity_light(activity: DataFrame) -> DataFrame:
    """Hourly lux by where the hour's activity lies against half the user's largest value."""
    top = activity.filter(F.col("value") > 0).groupBy("user_id").agg(F.max("value").alias("top"))
    hours = activity.groupBy(
        "user_id", F.to_date("start_ts").alias("date"), F.hour("start_ts").alias("hour")
    ).agg(F.sum("value").alias("amount"))
    half = F.coalesce("top", F.lit(1000.0)) / 2
    level = E.ladder(*[(F.col("amount") >= k * half, lux) for k, lux in ACTIVITY_STEPS], otherwise=0.0)
    by_hour = hours.join(top, "user_id", "left").select(*KEY, "hour", level.alias("lux"))
    return by_hour.groupBy(*KEY).agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("hour") == h, F.col("lux"))), F.lit(0.0)) for h in range(24)
    ]).alias("lux"))


def seasonal(lux: Column, day_length_hours: Column) -> Column:
    """Short days double the light."""
    return F.when(day_length_hours < 12, F.transform(lux, lambda x: x * 2)).otherwise(lux)


# ---- eligibility ---------------------------------------------------------------

def eligible_days(sleep: DataFrame, calendar: DataFrame, window: int = 14, least: int = 3) -> DataFrame:
    """Calendar dates with ``least`` records or more starting in their last ``window`` days."""
    starts = sleep.groupBy("user_id", F.to_date("start_ts").alias("date")).agg(F.count(F.lit(1)).alias("records"))
    order = W.partitionBy("user_id").orderBy("date").rowsBetween(-(window - 1), 0)
    rows = calendar.join(starts, KEY, "left").select(*KEY, F.sum("records").over(order).alias("records"))
    return rows.filter(F.col("records") >= least).select(*KEY)
