"""JSON exports: nested metric documents and flat record lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diurna.functions import exprs as E
from diurna.sources.health_xml import accepted, user_of

_S = T.StringType()
TEXTS = ["date", "source", "sleepStart", "sleepEnd", "start", "finish"]
# entries as maps: the average appears as Avg or avg, which one struct could not hold
ENTRY = T.MapType(_S, _S)
NESTED = T.StructType([T.StructField("data", T.StructType([T.StructField("metrics", T.ArrayType(T.StructType([
    T.StructField("name", _S), T.StructField("data", T.ArrayType(ENTRY))])))]))])
FLAT = T.StructType([T.StructField("data", T.ArrayType(T.StructType(
    [T.StructField(n, _S) for n in ("startDate", "endDate", "value", "unit", "sourceName")])))])

# File patterns by metric.
FILE_PATTERNS = {"sleep": "*[Ss]leep*.json", "steps": "*[Ss]tep*.json", "heart": "*[Hh]eart*.json", "any": "*.json"}


def _read(spark: SparkSession, path: str | list[str], schema: T.StructType, pattern: str) -> DataFrame:
    return (
        spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True).json(path)
        .select("data", F.col("_metadata.file_path").alias("file"))
    )


def _at(name: str) -> Column:
    return F.try_element_at("e", F.lit(name))


def nested_entries(spark: SparkSession, path: str | list[str], pattern: str = FILE_PATTERNS["any"]) -> DataFrame:
    """One row per metric entry; flat documents give none."""
    m = _read(spark, path, NESTED, pattern).select("file", F.explode("data.metrics").alias("m"))
    return m.select("file", user_of(F.col("file")).alias("user_id"), F.coalesce("m.name", F.lit("")).alias("metric"),
                    F.explode("m.data").alias("e")).select(
        "file", "user_id", "metric", *[_at(n).alias(n) for n in TEXTS],
        F.coalesce(_at("Avg"), _at("avg")).alias("average"), _at("qty").alias("qty"), _at("value").alias("value"))


def flat_entries(spark: SparkSession, path: str | list[str], pattern: str = FILE_PATTERNS["any"]) -> DataFrame:
    """One row per entry of a flat document; nested documents give none."""
    return _read(spark, path, FLAT, pattern).select(
        "file", user_of(F.col("file")).alias("user_id"), F.explode("data").alias("e")).select("file", "user_id", "e.*")


def _id(*cols: str) -> Column:
    return F.xxhash64("user_id", *cols).alias("rec_id")


def _source(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("Unknown"))


def _interval_reason(end_may_be_start: bool = False) -> Column:
    gone = F.col("start_ts").isNull() | F.col("end_ts").isNull()
    if end_may_be_start:
        return E.ladder((gone, "bad date"), (F.col("end_ts") < F.col("start_ts"), "end before start"), otherwise=F.lit(None))
    return E.ladder((gone, "bad date"), (F.col("end_ts") <= F.col("start_ts"), "end not after start"), otherwise=F.lit(None))


def _value_reason() -> Column:
    return E.ladder((F.col("value").isNull(), "bad value"), (F.col("value") < 0, "negative value"), otherwise=F.lit(None))


def _quantity(text: Column) -> Column:
    """A number; an absent quantity is 0, a text that is none is null and so rejected."""
    return F.coalesce(text, F.lit("0")).try_cast("double")


def nested_sleep(entries: DataFrame) -> DataFrame:
    """Sleep rows with a ``reason`` that is null when the row is valid; so in all readers here."""
    e = entries.filter(F.col("metric") == "sleep_analysis").select(
        "file", "user_id", _source("source").alias("source_name"),
        E.local_timestamp(F.coalesce("sleepStart", "start")).alias("start_ts"),
        E.local_timestamp(F.coalesce("sleepEnd", "finish")).alias("end_ts"), F.lit("ASLEEP").alias("state"))
    return e.select("*", _id("source_name", "start_ts", "end_ts"), _interval_reason().alias("reason"))


def flat_sleep(entries: DataFrame) -> DataFrame:
    asleep = F.contains(F.upper(F.coalesce("value", F.lit(""))), F.lit("ASLEEP"))
    e = entries.select(
        "file", "user_id", _source("sourceName").alias("source_name"), E.local_timestamp("startDate").alias("start_ts"),
        E.local_timestamp("endDate").alias("end_ts"), F.when(asleep, "ASLEEP").otherwise("IN_BED").alias("state"))
    return e.select("*", _id("source_name", "start_ts", "end_ts"), _interval_reason().alias("reason"))


# Heart metrics by export name (metric, unit, motion).
HEART_NAMES = {"heart_rate": ("HEART_RATE", "count/min", "unknown"),
               "resting_heart_rate": ("HEART_RATE", "count/min", "sedentary"),
               "heart_rate_variability": ("HRV_SDNN", "ms", "unknown")}


def nested_heart(entries: DataFrame) -> DataFrame:
    """Averages of the plain metric, quantities (0 if absent) of the resting and variability ones."""
    def pick(i: int) -> Column:
        return E.lookup({k: v[i] for k, v in HEART_NAMES.items()}, F.col("metric"))

    value = F.when(F.col("metric") == "heart_rate", F.col("average").try_cast("double")).otherwise(
        _quantity(F.coalesce("qty", "value")))
    e = entries.filter(F.col("metric").isin(list(HEART_NAMES))).select(
        "file", "user_id", _source("source").alias("source_name"), E.local_timestamp("date").alias("ts"),
        pick(0).alias("metric_type"), value.alias("value"), pick(1).alias("unit"), pick(2).alias("motion_context"))
    reason = F.when(F.col("ts").isNull(), "bad date").otherwise(_value_reason())
    return e.select("*", _id("source_name", "ts", "metric_type"), reason.alias("reason"))


def nested_activity(entries: DataFrame) -> DataFrame:
    """Step and distance totals spanning their whole day."""
    name = F.lower("metric")
    far = F.contains(name, F.lit("distance"))
    steps = ~far & (F.contains(name, F.lit("step")) | (F.col("metric") == ""))
    day = E.local_timestamp(F.substring("date", 1, 10))
    e = entries.filter(far | steps).select(
        "file", "user_id", F.get(F.split(_source("source"), r"\|"), F.lit(0)).alias("source_name"), day.alias("start_ts"),
        far.alias("far"), _quantity(F.col("qty")).alias("value"))
    e = e.select("file", "user_id", "source_name", "start_ts",
                 F.expr("start_ts + interval '23:59:59' hour to second").alias("end_ts"),
                 F.when(F.col("far"), "DISTANCE_WALKING").otherwise("STEP_COUNT").alias("activity_type"), "value",
                 F.when(F.col("far"), "km").otherwise("count").alias("unit"))
    reason = F.when(F.col("start_ts").isNull(), "bad date").otherwise(_value_reason())
    return e.select("*", _id("source_name", "start_ts", "activity_type"), reason.alias("reason"))


def flat_activity(entries: DataFrame) -> DataFrame:
    unit = F.coalesce("unit", F.lit("count"))
    low = F.lower(unit)
    far = ~F.contains(low, F.lit("count")) & (F.contains(low, F.lit("km")) | F.contains(low, F.lit("meter")))
    e = entries.select(
        "file", "user_id", _source("sourceName").alias("source_name"), E.local_timestamp("startDate").alias("start_ts"),
        E.local_timestamp("endDate").alias("end_ts"), F.when(far, "DISTANCE_WALKING").otherwise("STEP_COUNT").alias("activity_type"),
        _quantity(F.col("value")).alias("value"), unit.alias("unit"))
    return e.select("*", _id("source_name", "start_ts", "end_ts", "activity_type"),
                    F.coalesce(_interval_reason(end_may_be_start=True), _value_reason()).alias("reason"))


def sleep_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Both layouts of every sleep file below the folder, rejects included."""
    pattern = FILE_PATTERNS["sleep"]
    return nested_sleep(nested_entries(spark, path, pattern)).unionByName(flat_sleep(flat_entries(spark, path, pattern)))


def activity_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    pattern = FILE_PATTERNS["steps"]
    return nested_activity(nested_entries(spark, path, pattern)).unionByName(
        flat_activity(flat_entries(spark, path, pattern)))


def heart_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return nested_heart(nested_entries(spark, path, FILE_PATTERNS["heart"]))


def read_sleep_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The valid rows; ``rejected(sleep_json(...))`` has the others with their reasons."""
    return accepted(sleep_json(spark, path))


def read_activity_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return accepted(activity_json(spark, path))


def read_heart_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return accepted(heart_json(spark, path))
