"""Record scans of the XML health export.

A file is read as text rows that end at the opening ``<Record`` of the next one, so Spark cuts
a large export into byte ranges: each range owns the records that begin in it, and the reader
carries a record and its metadata children over the edge. One export of any size is thus read
by many tasks. A row is one record; what stands between two records (the header, workouts)
travels with the row before it and is cut off there.

The start tag is found by a pattern that knows quotes, so ``>`` inside an attribute's value does
not end it; the record alone is then given to the XML parser, once: the parsed row comes out of
a generator, below which no later filter is pushed. Text that is no whole start tag of a record
gives no row. Comments are not recognised: a record inside one is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diurna import schemas as S
from diurna.functions import exprs as E

OPENING = "<Record"
#: White space, then anything up to the closing mark that no quotes hide.
START_TAG = r"""^(\s(?:[^"'<>]|"[^"<]*+"|'[^'<]*+')*+)>"""
ATTRIBUTES = ("type", "sourceName", "unit", "startDate", "endDate", "value")
RECORD = T.StructType([
    *[T.StructField(f"_{n}", T.StringType()) for n in ATTRIBUTES],
    T.StructField("MetadataEntry", T.ArrayType(T.StructType([
        T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]))),
])


def user_of(path: Column, pattern: str = r"user[_=](\d+)") -> Column:
    """Person a file belongs to, from its path.

    Files that name no person belong to their folder: a negative id from its
    hash, so that unnamed people are neither merged nor taken for a named one.
    """
    named = F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).cast("long")
    folder = F.shiftrightunsigned(F.xxhash64(F.regexp_replace(path, "/[^/]*$", "")), 1)
    return F.coalesce(named, -folder - 1)


def read_health_xml(spark: SparkSession, path: str | list[str], types: list[str] | None = None,
                    start: str | None = None, end: str | None = None) -> DataFrame:
    """All records with their attributes; ``start`` and ``end`` are inclusive start dates."""
    raw = spark.read.option("lineSep", OPENING).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("rest"))
    if types:  # records that do not even name a wanted type are not parsed
        named = F.col("rest").rlike("type\\s*=\\s*[\"'][^\"']*&")  # spelt with an entity
        for t in types:
            named = named | F.contains(F.col("rest"), F.lit(t))
        raw = raw.filter(named)
    tagged = raw.select("file", "rest", F.regexp_extract("rest", START_TAG, 1).alias("tag"))
    whole = F.when(F.endswith(F.col("tag"), F.lit("/")), F.concat(F.lit(OPENING), "tag", F.lit(">"))).otherwise(
        F.concat(F.lit(OPENING), F.substring_index("rest", "</Record", 1), F.lit("</Record>")))
    parsed = F.inline(F.array(F.when(F.col("tag") != "", F.from_xml(whole, RECORD))))
    motion = F.get(F.filter("MetadataEntry", lambda m: m["_key"] == S.MOTION_METADATA_KEY), F.lit(0))["_value"]
    r = tagged.select("file", parsed).filter("_type IS NOT NULL OR _startDate IS NOT NULL").select(
        "file", user_of(F.col("file")).alias("user_id"), F.col("_type").alias("type"), F.col("_sourceName").alias("source_name"),
        F.col("_unit").alias("unit"), F.col("_value").alias("value"), motion.alias("motion"),
        E.local_timestamp("_startDate").alias("start_ts"), E.local_timestamp("_endDate").alias("end_ts"))
    if types:
        r = r.filter(F.col("type").isin(types))
    return r.filter(E.starts_within("start_ts", start, end))


def _id() -> Column:
    """Stable tie-break: a hash of the record, the same on every re-read."""
    return F.xxhash64("user_id", "type", "source_name", "start_ts", "end_ts", "value").alias("rec_id")


def sleep_from_xml(records: DataFrame) -> DataFrame:
    """Sleep rows with a ``reason`` that is null when the row is valid."""
    r = records.filter(F.col("type") == "HKCategoryTypeIdentifierSleepAnalysis")
    state = E.lookup(S.SLEEP_STATES, F.col("value"))
    reason = E.ladder(
        (state.isNull(), "unknown state"), (F.col("start_ts").isNull() | F.col("end_ts").isNull(), "bad date"),
        (F.col("end_ts") <= F.col("start_ts"), "end not after start"),
        (F.coalesce(F.length("source_name"), F.lit(0)) == 0, "no source"), otherwise=F.lit(None))
    return r.select("file", "user_id", "source_name", "start_ts", "end_ts", state.alias("state"), _id(), reason.alias("reason"))


def activity_from_xml(records: DataFrame) -> DataFrame:
    kind = E.lookup(S.ACTIVITY_TYPES, F.col("type"))
    value = F.col("value").try_cast("double")
    reason = E.ladder(
        (F.col("start_ts").isNull() | F.col("end_ts").isNull(), "bad date"), (F.col("end_ts") < F.col("start_ts"), "end before start"),
        (value.isNull(), "bad value"), (value < 0, "negative value"),
        (F.coalesce(F.length("source_name"), F.lit(0)) == 0, "no source"),
        (F.coalesce(F.length("unit"), F.lit(0)) == 0, "no unit"), otherwise=F.lit(None))
    return records.withColumn("kind", kind).filter("kind IS NOT NULL").select(
        "file", "user_id", "source_name", "start_ts", "end_ts", F.col("kind").alias("activity_type"), value.alias("value"),
        "unit", _id(), reason.alias("reason"))


def motion_context(word: Column, numeric: bool = False) -> Column:
    """Words are matched without case; numeric codes only when asked for."""
    w = F.lower(word)
    named = F.when(w.isin(S.MOTION_CONTEXTS), w)
    if numeric:
        named = F.coalesce(named, E.lookup({"1": "sedentary", "2": "active"}, w))
    return F.coalesce(named, F.lit("unknown"))


def heart_from_xml(records: DataFrame, numeric_motion: bool = False) -> DataFrame:
    kind = E.lookup(S.HEART_METRICS, F.col("type"))
    value = F.col("value").try_cast("double")
    reason = E.ladder(
        (F.col("start_ts").isNull(), "bad date"), (value.isNull(), "bad value"), (value < 0, "negative value"),
        (F.coalesce(F.length("source_name"), F.lit(0)) == 0, "no source"), otherwise=F.lit(None))
    return records.withColumn("kind", kind).filter("kind IS NOT NULL").select(
        "file", "user_id", "source_name", F.col("start_ts").alias("ts"), F.col("kind").alias("metric_type"), value.alias("value"),
        "unit", motion_context(F.col("motion"), numeric_motion).alias("motion_context"), _id(), reason.alias("reason"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter("reason IS NULL").drop("reason", "file")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter("reason IS NOT NULL")


def file_outcomes(rows: DataFrame) -> DataFrame:
    """Per file: rows kept and rejected, and whether anything could be used."""
    g = rows.groupBy("file").agg(F.count_if(F.col("reason").isNull()).alias("accepted"),
                                 F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.max("reason").alias("a_reason"))
    return g.withColumn("status", F.when(F.col("accepted") > 0, "success").otherwise("failed"))
