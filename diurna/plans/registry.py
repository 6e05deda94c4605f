"""Registry of named queries with their independent SQL statement."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.sources.adapters import TestTables


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    build: Callable[[TestTables], DataFrame]
    sql: str | None
    home: str


NUDGE = 1e-9
ENTRIES: dict[str, Entry] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """Shared common table expression of the SQL statements."""
    VIEWS[name] = sql


def query(name: str, ids: str, sql: str | None = None):
    home = sys._getframe(1).f_globals["__name__"].rsplit(".", 1)[-1]

    def register(build: Callable[[TestTables], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, tuple(ids.split()), build, sql, home)
        return build

    return register


@lru_cache(maxsize=None)
def _needs(sql: str) -> frozenset[str]:
    words = set(re.findall(r"[a-z_][a-z_0-9]*", sql))
    found = {v for v in VIEWS if v in words}
    for v in list(found):
        found |= _needs(VIEWS[v])
    return frozenset(found)


def full_sql(entry: Entry) -> str:
    used = _needs(entry.sql)
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in used]
    body = entry.sql.strip()
    if ctes:
        own = body.startswith("WITH ")
        body = f"WITH {', '.join(ctes)}" + (", " + body[5:] if own else " " + body)
    return body.replace(", 6)", f" + {NUDGE}, 6)")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, as both engines sum in their own order.

    The nudge, added on both sides, keeps exact decimal halves from rounding apart.
    """
    return df.select(*[
        F.round(F.col(f"`{n}`").cast("double") + NUDGE, 6).alias(n) if t in ("double", "float") else F.col(f"`{n}`")
        for n, t in df.dtypes
    ])


def callable_for(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: rounded(entry.build(TestTables(spark, folder)))
