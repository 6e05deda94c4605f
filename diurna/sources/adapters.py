"""Canonical tables derived from the generated test tables (see FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.functions import exprs as E
from diurna.operators import ordering
from diurna.session import prepare


def _plus_minutes(ts: str, minutes: str):
    return F.expr(f"{ts} + make_dt_interval(0, 0, {minutes}, 0)")


class TestTables:
    """Lazy views over one folder of parquet tables; nothing is read before an action."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def sleep(self) -> DataFrame:
        return (
            self.raw("events").filter(F.col("event_type").isin("view", "signup"))
            .select(
                "user_id",
                F.expr("CASE WHEN event_id % 2 = 0 THEN 'watch' ELSE 'phone' END").alias("source_name"),
                F.col("ts").alias("start_ts"),
                _plus_minutes("ts", "cast(20 + (event_id * 37) % 460 AS int)").alias("end_ts"),
                F.expr("""CASE event_id % 10 WHEN 0 THEN 'IN_BED' WHEN 1 THEN 'AWAKE' WHEN 2 THEN 'REM'
                          WHEN 3 THEN 'DEEP' WHEN 4 THEN 'CORE' ELSE 'ASLEEP' END""").alias("state"),
                F.col("event_id").alias("rec_id"),
            )
        )

    @cached_property
    def activity(self) -> DataFrame:
        kind = """CASE WHEN event_type = 'click' THEN 'STEP_COUNT' WHEN event_id % 3 = 0 THEN 'ACTIVE_ENERGY'
                  WHEN event_id % 3 = 1 THEN 'DISTANCE_WALKING' ELSE 'FLIGHTS_CLIMBED' END"""
        return (
            self.raw("events").filter(F.col("event_type").isin("click", "purchase"))
            .select(
                "user_id",
                F.expr("CASE WHEN event_id % 2 = 0 THEN 'watch' ELSE 'phone' END").alias("source_name"),
                F.col("ts").alias("start_ts"),
                _plus_minutes("ts", "cast(event_id % 90 AS int)").alias("end_ts"),
                F.expr(kind).alias("activity_type"),
                F.expr("""CASE WHEN event_type = 'click' THEN value * 100 WHEN event_id % 3 = 0 THEN value
                          WHEN event_id % 3 = 1 THEN value / 10 ELSE floor(value / 10) END""")
                .cast("double").alias("value"),
                F.expr("""CASE WHEN event_type = 'click' THEN 'count' WHEN event_id % 3 = 0 THEN 'kcal'
                          WHEN event_id % 3 = 1 THEN 'km' ELSE 'count' END""").alias("unit"),
                F.col("event_id").alias("rec_id"),
            )
        )

    @cached_property
    def heart(self) -> DataFrame:
        return (
            self.raw("events").filter(F.col("event_type") == "error")
            .select(
                "user_id",
                F.expr("CASE WHEN event_id % 2 = 0 THEN 'watch' ELSE 'phone' END").alias("source_name"),
                "ts",
                F.expr("CASE WHEN event_id % 5 = 0 THEN 'HRV_SDNN' ELSE 'HEART_RATE' END").alias("metric_type"),
                F.expr("CASE WHEN event_id % 5 = 0 THEN 5 + value % 60 ELSE 40 + value % 90 END").alias("value"),
                F.expr("CASE WHEN event_id % 5 = 0 THEN 'ms' ELSE 'count/min' END").alias("unit"),
                F.expr("""CASE event_id % 3 WHEN 0 THEN 'sedentary' WHEN 1 THEN 'active'
                          ELSE 'unknown' END""").alias("motion_context"),
                F.col("event_id").alias("rec_id"),
            )
        )

    @cached_property
    def episodes(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_custkey").alias("user_id"),
            F.to_date("o_orderdate").alias("start_date"),
            F.expr("date_add(to_date(o_orderdate), cast(o_orderkey % 21 AS int))").alias("end_date"),
            F.expr("""CASE o_orderkey % 4 WHEN 0 THEN 'depressive' WHEN 1 THEN 'manic'
                      WHEN 2 THEN 'hypomanic' ELSE 'mixed' END""").alias("episode_type"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("severity"),
            F.col("o_orderstatus").alias("notes"),
            F.expr("concat('r', cast(o_custkey % 5 AS string))").alias("rater_id"),
            _plus_minutes("o_orderdate", "cast(o_orderkey % 1440 AS int)").alias("labeled_at"),
            F.col("o_orderkey").alias("rec_id"),
        )

    @cached_property
    def actigraphy(self) -> DataFrame:
        events = self.raw("events").select(
            "user_id", "ts", "event_id", E.micros("ts").alias("us"),
            (E.day_number(F.to_date("ts")) - 19723).alias("day"),
            (F.col("value") * 10).alias("intensity"),
        )
        return ordering.ordered_scan(
            events, ["user_id", "day"], E.hour_bucket("us"), ["ts", "event_id"],
            minute_no=ordering.running_sum(F.lit(1)),
        ).select("user_id", "day", F.col("minute_no").cast("int").alias("minute_no"), "intensity")

    @cached_property
    def survey(self) -> DataFrame:
        items = [
            F.expr(f"cast((c_custkey * ({i} + 3) + {i}) % 4 AS int)").alias(f"q{i}")
            for i in range(1, 10)
        ]
        return self.raw("customer").select(F.col("c_custkey").alias("user_id"), *items)

    @cached_property
    def rx(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("drug_key")
        )

    @cached_property
    def drugs(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("drug_key"), F.concat(F.lower("p_name"), F.expr(
                "CASE p_partkey % 400 WHEN 7 THEN ' sertraline' WHEN 13 THEN ' d00149' ELSE '' END")).alias("drug_id")
        )
