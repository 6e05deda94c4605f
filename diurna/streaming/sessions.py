"""Sleep windows of a stream, equal to those of the batch merge, whatever the order of arrival.

Two neighbours in start order are parted if the later one starts more than the threshold after
the end of the one before, so an episode that arrives in between can join two windows or part
one, and one inside a longer episode counts by its own end. State therefore keeps the start
instants (end, number of episodes) of the windows that are still open, nothing of closed ones.

A window is closed when the watermark has passed its last start and the threshold after its
last end: no row that still may arrive can touch it. A timer is set for that moment. Rows
behind the watermark are not seen here; `upkeep.admit` sets them aside for a repair.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from diurna import schemas as S
from diurna.functions import exprs as E

WINDOWS = ("user_id long, window_start timestamp_ntz, window_end timestamp_ntz, episodes long, hours double, span_hours double, "
           "gaps long, gap_hours double, gap_sq double, fragmentation double, is_fragmented boolean")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def window_row(instants: list[tuple[int, int, int]]) -> tuple:
    """Measures of one window from its (start, end, episodes) in start order, times in microseconds."""
    hour = E.HOUR_US
    start, reach, slept, gap_us, gap_sq, gaps, episodes, last = instants[0][0], None, 0, 0, 0.0, 0, 0, None
    for s, e, n in instants:
        if last is not None and s > last:
            gaps, gap_us, gap_sq = gaps + 1, gap_us + s - last, gap_sq + ((s - last) / hour) ** 2
        slept += max(0, e - (s if reach is None else max(s, reach)))
        reach, last, episodes = e if reach is None else max(reach, e), e, episodes + n
    span = (reach - start) / hour
    return (pd.Timestamp(start, unit="us"), pd.Timestamp(reach, unit="us"), episodes, slept / hour, span, gaps, gap_us / hour,
            gap_sq, gap_us / hour / span if span else 0.0, episodes > 1)


def split(instants: list[tuple[int, int, int]], limit: int) -> list[list[tuple[int, int, int]]]:
    """Windows of the instants in start order."""
    out: list[list[tuple[int, int, int]]] = []
    for x in sorted(instants):
        if out and x[0] - out[-1][-1][1] <= limit:
            out[-1].append(x)
        else:
            out.append([x])
    return out


class OpenWindows(StatefulProcessor):
    """Per user: start instants of open windows; closed ones are put out once."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.instants = handle.getMapState("instants", "start long", "end long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            found = frame.groupby("start_us")["end_us"].agg(["max", "count"])
            for start, end, n in zip(found.index, found["max"], found["count"]):
                at = (int(start),)
                old = self.instants.getValue(at) if self.instants.containsKey(at) else (int(end), 0)
                self.instants.updateValue(at, (max(old[0], int(end)), old[1] + int(n)))
        yield from self._close(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._close(key, timerValues)

    def _close(self, key, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = [(int(s[0]), int(v[0]), int(v[1])) for s, v in self.instants.iterator()]
        done, due = [], None
        for window in split(held, self.limit):
            start, end, _ = window[-1]
            until = max(start, end + self.limit)
            if until > mark:
                due = until if due is None else min(due, until)
                continue
            done.append((key[0], *window_row(window)))
            for s, _, _ in window:
                self.instants.removeKey((s,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))
        if done:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in WINDOWS.split(", ")])

    def close(self) -> None:
        pass


def prepare_state(spark: SparkSession) -> None:
    """The state store that keyed maps and timers need; a cluster may set it for all sessions."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def merged_windows(stream: DataFrame, threshold_hours: float = S.MERGE_THRESHOLD_HOURS, delay: str = "1 day") -> DataFrame:
    """Append-only: each window once, when nothing on time can change it any more.

    Rows without user, start or end take no part. The columns are those of `merge_sleep_windows`.
    """
    prepare_state(stream.sparkSession)
    rows = stream.filter("user_id IS NOT NULL AND start_ts IS NOT NULL AND end_ts IS NOT NULL").select(
        "user_id", F.col("start_ts").cast("timestamp").alias("at"), E.micros("start_ts").alias("start_us"), E.micros("end_ts").alias("end_us"))
    return rows.withWatermark("at", delay).groupBy("user_id").transformWithStateInPandas(
        OpenWindows(round(threshold_hours * E.HOUR_US)), WINDOWS, "append", "EventTime")
