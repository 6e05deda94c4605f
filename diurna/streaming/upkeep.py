"""Stored tables kept up to date by arriving records, and rows that come too late.

`Upkeep` is the batch handler of a stream of record files. From a batch it takes the touched
(user, date) pairs, also those that a changed record leaves. Daily rows of these pairs are made
anew from the stored records of just these days; look-back features are made anew for the dates
whose look-back reaches a touched day. Other rows, and the parts they lie in, are not rewritten.

A batch may be played again at any point: records are merged by key, the touched pairs of a
batch are written before anything else and only ever grow, and replacing rows by the same rows
changes nothing. So any order of arrival ends in the table that the batch job makes of all records.

`admit` sorts a stream's rows into those on time and those behind the watermark; `repair`
makes the days of late rows anew. Streaming results of rows on time plus repaired days equal
the batch result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from diurna.sources.stored import StoredTable

PAIR = ["user_id", "date"]


def within_reach(daily: DataFrame, touched: DataFrame, reach: int) -> DataFrame:
    """(user_id, date) of the daily rows whose last ``reach`` rows hold a touched day, or held one that is gone."""
    order = W.partitionBy("user_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    both = daily.select(*PAIR, F.lit(1).alias("_row")).join(touched.select(*PAIR, F.lit(True).alias("_touched")), PAIR, "full")
    placed = both.withColumn("_n", F.sum("_row").over(order))
    nearest = F.last(F.when(F.col("_touched"), F.coalesce("_n", F.lit(0))), True).over(order)
    return placed.withColumn("_at", nearest).filter((F.col("_row") == 1) & (F.col("_n") - F.col("_at") < reach)).select(*PAIR)


@dataclass(frozen=True)
class Upkeep:
    """summarise: records to daily rows, each from the records of its date alone;
    look_back: daily rows to features, each from at most ``reach`` daily rows up to its own."""

    records: StoredTable
    daily: StoredTable
    features: StoredTable
    summarise: Callable[[DataFrame], DataFrame]
    look_back: Callable[[DataFrame], DataFrame]
    reach: int
    date: Column
    newest: list[Column]
    work: str

    def _touched(self, batch: DataFrame, epoch: int) -> DataFrame:
        """Pairs of the batch and of the stored rows that it replaces, written once more at every attempt."""
        known = self.records.read(self.records.met(batch)).join(batch.select(*self.records.keys), list(self.records.keys), "left_semi")
        pairs = batch.select("user_id", self.date.alias("date")).unionByName(known.select("user_id", self.date.alias("date")))
        folder = f"{self.work}/touched/epoch={epoch}"
        pairs.filter("user_id IS NOT NULL AND date IS NOT NULL").distinct().write.parquet(f"{folder}/try={uuid.uuid4().hex}")
        return self.records.spark.read.schema("user_id long, date date").parquet(f"{folder}/*").distinct()

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        touched = self._touched(batch, epoch)
        self.records.upsert(batch, self.newest)
        users = touched.select("user_id").distinct()
        buckets = {b for b, _ in self.daily.met(touched)}
        rows = self.records.read(buckets={b for b, _ in self.records.met(batch)}).withColumn("_date", self.date)
        t = touched.select(F.col("user_id").alias("_user"), F.col("date").alias("_day"))
        days = rows.join(t, (F.col("user_id") == F.col("_user")) & (F.col("_date") == F.col("_day")), "left_semi").drop("_date")
        self.daily.replace(touched, self.summarise(days))
        history = self.daily.read(buckets=buckets).join(users, "user_id", "left_semi")
        near = within_reach(history, touched, self.reach)
        self.features.replace(near.unionByName(touched), self.look_back(history).join(near, PAIR, "left_semi"))


def maintain(stream: DataFrame, upkeep: Upkeep, checkpoint: str) -> StreamingQuery:
    """Run the upkeep on what arrives and stop when nothing is left."""
    return stream.writeStream.foreachBatch(upkeep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- late rows ----

def _mark(spark: SparkSession, folder: str, epoch: int, delay: str):
    """The latest time of the batches before, less the delay; none before the first."""
    if epoch == 0:
        return None
    seen = spark.read.schema("epoch long, latest timestamp_ntz").parquet(f"{folder}/marks/*")
    return seen.filter(F.col("epoch") < epoch).agg((F.max("latest") - F.expr(f"interval {delay}")).alias("m")).first().m


def admit(stream: DataFrame, folder: str, checkpoint: str, ts: str = "start_ts", delay: str = "1 day") -> StreamingQuery:
    """Write each batch to ``folder/rows/epoch=N``, its rows at or behind the watermark below ``late=true``.

    The watermark of a batch is that of the batches before it, so a query over the rows on time
    (`on_time`), with the same delay, drops none of them. Rows without a time are on time. A batch
    that is played again writes its own folders anew and meets the same watermark.
    """
    spark = stream.sparkSession

    def run(batch: DataFrame, epoch: int) -> None:
        mark = _mark(spark, folder, epoch, delay)
        late = F.lit(False) if mark is None else F.coalesce(F.col(ts) <= F.lit(mark), F.lit(False))
        seen = Observation()
        counted = batch.withColumn("late", late).observe(
            seen, F.max(ts).alias("latest"), F.count_if("late").alias("late"), F.count(F.lit(1)).alias("rows"))
        counted.write.mode("overwrite").partitionBy("late").parquet(f"{folder}/rows/epoch={epoch}")
        got = seen.get
        spark.createDataFrame([(epoch, got["latest"], got["rows"], got["late"])], "epoch long, latest timestamp_ntz, rows long, late long") \
            .coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/epoch={epoch}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admitted(spark: SparkSession, folder: str, schema, late: bool) -> DataFrame:
    """All rows so far that were on time, or late."""
    return spark.read.schema(schema).parquet(f"{folder}/rows/*/late={str(late).lower()}")


def on_time(spark: SparkSession, folder: str, schema, per_trigger: int = 1000) -> DataFrame:
    """The rows on time as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/rows/*/late=false")


def admission(spark: SparkSession, folder: str) -> DataFrame:
    """Per batch: latest time, rows and how many of them were late."""
    return spark.read.schema("epoch long, latest timestamp_ntz, rows long, late long").parquet(f"{folder}/marks/*")


def repair(table: StoredTable, late: DataFrame, records: DataFrame, summarise: Callable[[DataFrame], DataFrame], date: Column) -> int:
    """Daily rows of the days of late rows, made anew from all records of just these days; the new version."""
    days = late.select("user_id", date.alias("date")).filter("user_id IS NOT NULL AND date IS NOT NULL").distinct()
    d = days.select(F.col("user_id").alias("_user"), F.col("date").alias("_day"))
    rows = records.withColumn("_date", date).join(d, (F.col("user_id") == F.col("_user")) & (F.col("_date") == F.col("_day")), "left_semi")
    return table.replace(days, summarise(rows.drop("_date")))
