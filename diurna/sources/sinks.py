"""Writers. All are plain Spark write jobs: retried tasks leave one committed copy."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from diurna.operators import cohort, modelling


def write_features(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Feature table partitioned by date, in few files: rows of a date are gathered, and a date
    too large for one task is split over several (a rebalance, sized at run time)."""
    writer = df.hint("rebalance", "date").write.mode(mode).partitionBy("date")
    writer.parquet(path) if fmt == "parquet" else writer.option("header", True).csv(path)


def write_sorted_csv(df: DataFrame, path: str, *order: str) -> None:
    """CSV in date order over its part files (a range shuffle, not one task)."""
    df.orderBy(*(order or ("date",))).write.mode("overwrite").option("header", True).csv(path)


def write_predictions(scores: DataFrame, path: str, warned: Column | None = None) -> None:
    """Rows per day as CSV and one summary row per user as JSON."""
    write_sorted_csv(scores, f"{path}/daily", "date", "user_id")
    flag = F.lit(False) if warned is None else warned
    modelling.risk_summary(scores, flag).write.mode("overwrite").json(f"{path}/summary")


def write_cohort(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_labels(labels: DataFrame, path: str, fmt: str = "csv") -> None:
    ordered = labels.orderBy("date")
    if fmt == "csv":
        ordered.write.mode("overwrite").option("header", True).csv(path)
    else:
        ordered.write.mode("overwrite").json(path)


def upsert_to(stored_path: str, incoming: DataFrame, keys: list[str], newest: list[str], out_path: str) -> None:
    """Merged copy under a new path, so a failed run leaves the stored table whole."""
    stored = incoming.sparkSession.read.parquet(stored_path)
    cohort.upsert(stored, incoming, keys, [F.col(c) for c in newest]).write.mode("overwrite").parquet(out_path)


def append_snapshot(wide: DataFrame, metrics: list[str], path: str, effective_ts: dt.datetime) -> None:
    """Bitemporal append: one row per metric with the time it became known.

    A job that is run again with its effective_ts replaces its own partitions only.
    """
    rows = cohort.long_snapshot(wide, metrics).withColumn("effective_ts", F.lit(effective_ts))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("effective_ts", "as_of").parquet(path)


def delete_period(df: DataFrame, start: str, end: str, out_path: str, ts: str = "start_ts") -> int:
    """Write what lies outside [start, end] and return how many rows were dropped."""
    inside = F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    seen = Observation()
    counted = df.observe(seen, F.count_if(inside).alias("dropped"))
    counted.filter(~F.coalesce(inside, F.lit(False))).write.mode("overwrite").parquet(out_path)
    return seen.get["dropped"]
