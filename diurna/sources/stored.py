"""Keyed Parquet tables that a small batch changes without rewriting the rest.

Rows lie in parts: a bucket (a hash of some key columns) and, if asked for, a month of a key
date. A batch reads and rewrites only the parts it meets, as new files beside the old ones. A
version of the table is a list of part folders; it counts once Spark has committed the list
(its _SUCCESS mark), so readers switch from the old to the new version in one step and a killed
run leaves the old one readable. A retried task leaves one copy, as in any Spark write.

One writer at a time per table. The lists hold one row per part (buckets times months), which
is what the driver sees; rows never pass through it. `tidy` deletes what no kept version names.

Within a part rows are sorted by key, with min/max statistics and Bloom filters per row group,
so a lookup by key opens few buckets and few of their row groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diurna.operators import cohort

PART = ["_bucket", "_span"]
#: Span of tables that are not cut by month.
WHOLE = "all"


@dataclass(frozen=True)
class StoredTable:
    """keys: columns that name a row; bucket_by: the keys hashed to a bucket (all if empty); month_of: a key date."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int = 64
    bucket_by: tuple[str, ...] = ()
    month_of: str | None = None
    bloom: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not set(self.bucket_by) <= set(self.keys) or (self.month_of and self.month_of not in self.keys):
            raise ValueError("a row's part must follow from its keys")

    # ---- versions ----

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        out = []
        for name in self._names(f"{self.folder}/versions"):
            fs, mark = self._fs(f"{self.folder}/versions/{name}/_SUCCESS")
            if fs.exists(mark):
                out.append(int(name))
        return out

    def parts(self, version: int | None = None) -> dict[tuple[int, str], str]:
        """(bucket, span) -> folder of a version, the newest one by default."""
        known = self.versions()
        if not known:
            return {}
        rows = self.spark.read.schema("bucket int, span string, path string").json(
            f"{self.folder}/versions/{known[-1] if version is None else version:08d}").collect()
        return {(r.bucket, r.span): r.path for r in rows}

    def _commit(self, parts: dict[tuple[int, str], str]) -> int:
        taken = self._names(f"{self.folder}/versions")  # also unfinished ones
        version = int(taken[-1]) + 1 if taken else 1
        rows = [(b, s, p) for (b, s), p in sorted(parts.items())]
        self.spark.createDataFrame(rows, "bucket int, span string, path string").coalesce(1).write.json(
            f"{self.folder}/versions/{version:08d}")
        return version

    # ---- reading ----

    def _located(self, df: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*(self.bucket_by or self.keys)), F.lit(self.buckets)).cast("int")
        span = F.coalesce(F.date_format(self.month_of, "yyyy-MM"), F.lit("none")) if self.month_of else F.lit(WHOLE)
        return df.withColumns({"_bucket": bucket, "_span": span})

    def met(self, df: DataFrame) -> set[tuple[int, str]]:
        """The parts that rows of df lie in; at most as many as the table can have."""
        return {(r._bucket, r._span) for r in self._located(df).select(*PART).distinct().collect()}

    def read(self, only: set[tuple[int, str]] | None = None, buckets: set[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, or of some of its parts or buckets."""
        paths = [p for at, p in sorted(self.parts(version).items())
                 if (only is None or at in only) and (buckets is None or at[0] in buckets)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def lookup(self, ids: DataFrame) -> DataFrame:
        """Rows whose keys are listed in ids (a column per key, so few that the driver may hold them).

        Only buckets that some id hashes to are opened; on a single key the ids are pushed down, where
        statistics and Bloom filters skip row groups. Absent ids give no row.
        """
        wanted = ids.select(*self.keys).distinct()
        buckets = {b for b, _ in self.met(wanted)}
        rows = self.read(buckets=buckets)
        if len(self.keys) == 1:
            (key,) = self.keys
            return rows.filter(F.col(key).isin([r[0] for r in wanted.collect()]))
        return rows.join(wanted, list(self.keys), "left_semi")

    # ---- writing ----

    def _rewrite(self, touched: set[tuple[int, str]], rows: DataFrame) -> int:
        """A new version: rows in place of the touched parts."""
        now = self.parts()
        new = f"{self.folder}/data/{uuid.uuid4().hex}"
        writer = self._located(rows.select(*self.schema.names)).hint("rebalance", *PART).sortWithinPartitions(*PART, *self.keys).write
        for name in self.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer.partitionBy(*PART).parquet(new)
        kept = {at: path for at, path in now.items() if at not in touched}
        for bucket in self._names(new):
            if bucket.startswith("_bucket="):
                for span in self._names(f"{new}/{bucket}"):
                    if span.startswith("_span="):
                        kept[int(bucket.split("=")[1]), span.split("=")[1]] = f"{new}/{bucket}/{span}"
        return self._commit(kept)

    def upsert(self, incoming: DataFrame, newest: list[Column]) -> int:
        """Newest row per key of stored and incoming rows; returns the version."""
        touched = self.met(incoming)
        if not touched:
            return (self.versions() or [0])[-1]
        return self._rewrite(touched, cohort.upsert(self.read(touched), incoming.select(*self.schema.names), list(self.keys), newest))

    def replace(self, scope: DataFrame, rows: DataFrame) -> int:
        """Rows of the keys in scope go; rows (of such keys only) come in their place."""
        keys = list(self.keys)
        scope = scope.select(*keys).distinct()
        touched = self.met(scope)
        if not touched:
            return (self.versions() or [0])[-1]
        match = F.lit(True)
        for k in keys:
            match = match & F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}"))
        stay = self.read(touched).alias("t").join(scope.alias("s"), match, "left_anti")
        return self._rewrite(touched, stay.unionByName(rows.select(*self.schema.names)))

    def tidy(self, keep: int = 2) -> int:
        """Delete versions but the last few, and data folders that no kept version names; returns how many went."""
        known = self.versions()
        kept = known[-keep:]
        used = {p.split("/data/")[1].split("/")[0] for v in kept for p in self.parts(v).values()}
        gone = [f"{self.folder}/versions/{v:08d}" for v in known if v not in kept]
        gone += [f"{self.folder}/data/{n}" for n in self._names(f"{self.folder}/data") if n not in used]
        for path in gone:
            fs, p = self._fs(path)
            fs.delete(p, True)
        return len(gone)
