"""Tabular sources with explicit schemas: labels, cohort tables, predictions, canonical Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diurna import schemas as S

LABEL_COLUMNS = ["date", "start_date", "end_date", "mood", "episode_type", "severity", "notes", "rater_id"]
PREDICTIONS = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("date", T.DateType()),
    *[T.StructField(n, T.DoubleType()) for n in ("depression", "hypomanic", "manic", "confidence")]])
CANONICAL = {"sleep": S.SLEEP, "activity": S.ACTIVITY, "heart": S.HEART, "episodes": S.EPISODES, "baselines": S.BASELINES,
             "actigraphy": S.ACTIGRAPHY, "survey": S.SURVEY}


def read_labels_csv(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted labels and skipped rows. A single ``date`` stands for both ends.

    Headers differ between files, so the columns come by name from the header;
    absent ones are null.
    """
    raw = spark.read.option("header", True).csv(path)
    raw = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in LABEL_COLUMNS])
    day = lambda c: F.col(c).try_cast("date")
    start, end = F.coalesce(day("date"), day("start_date")), F.coalesce(day("date"), day("end_date"))
    rows = raw.select(
        start.alias("start_date"), end.alias("end_date"),
        F.coalesce("mood", "episode_type", F.lit("depressive")).alias("episode_type"),
        F.coalesce(F.col("severity").try_cast("int"), F.lit(3)).alias("severity"), F.coalesce("notes", F.lit("")).alias("notes"),
        F.coalesce("rater_id", F.lit("default")).alias("rater_id"))
    ok = F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    return rows.filter(ok), rows.filter(~ok)


def read_canonical(spark: SparkSession, name: str, path: str | list[str]) -> DataFrame:
    return spark.read.schema(CANONICAL[name]).parquet(path)


def read_cohort_csv(spark: SparkSession, name: str, path: str | list[str]) -> DataFrame:
    return spark.read.schema(CANONICAL[name]).option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(PREDICTIONS).option("multiLine", True).json(path)
