"""Ordered scans that do not put a whole user into one task.

A plain ``lag`` or running total over ``partitionBy(user)`` sorts all records of
a user in one task, which fails when one user holds a large share of the rows.
``ordered_scan`` gives the same answers in two levels: rows are windowed inside
(keys, time bucket), each bucket is summarised by a map-side combined aggregate,
and only the bucket summaries, at most one per hour of calendar time, are
windowed per key. The summaries come back by an equi-join on the partitioning
the local windows already have.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BUCKET = "_bucket"
_START, _BEFORE, _HERE = W.unboundedPreceding, -1, 0


@dataclass(frozen=True)
class Scan:
    local: Callable[[WindowSpec], Column]
    summary: Callable[[Column], Column]
    carry: Callable[[Column, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]


def running_sum(value: Column) -> Scan:
    """Sum up to and including the row."""
    return Scan(
        lambda w: F.sum(value).over(w.rowsBetween(_START, _HERE)),
        lambda rank: F.sum(value),
        lambda s, w: F.sum(s).over(w.rowsBetween(_START, _BEFORE)),
        lambda here, carried: F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0)),
    )


def max_before(value: Column) -> Scan:
    """Largest value among the rows before."""
    return Scan(
        lambda w: F.max(value).over(w.rowsBetween(_START, _BEFORE)),
        lambda rank: F.max(value),
        lambda s, w: F.max(s).over(w.rowsBetween(_START, _BEFORE)),
        lambda here, carried: F.greatest(here, carried),
    )


def ordered_scan(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str], **scans: Scan
) -> DataFrame:
    """Add one column per scan; ``bucket`` must not decrease along ``order``."""
    rows = df.withColumn(_BUCKET, bucket)
    part = [*keys, _BUCKET]
    local = W.partitionBy(*part).orderBy(*order)
    across = W.partitionBy(*keys).orderBy(_BUCKET)
    rank = F.struct(*[F.col(o) for o in order])

    carried = (
        rows.groupBy(*part)
        .agg(*[s.summary(rank).alias(f"_s_{n}") for n, s in scans.items()])
        .select(*part, *[s.carry(F.col(f"_s_{n}"), across).alias(f"_c_{n}")
                         for n, s in scans.items()])
    )
    here = rows.select("*", *[s.local(local).alias(f"_l_{n}") for n, s in scans.items()])
    return here.join(carried, part, "left").select(
        *[F.col(c) for c in df.columns],
        *[s.merge(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, s in scans.items()],
    )
