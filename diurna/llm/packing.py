"""Mixture-controlled packing: deficit round-robin over source queues into fixed windows.

Every source is a queue of its documents' tokens, with a weight (its target share). All
queues earn credit in proportion to their weights, a queue serves a token as soon as its
deficit counter covers one, and what is left of the counter is carried on; a window closes
when its tokens are served. Served this way, the number of tokens c_s(w) that queue s has
given before window w depends on w, the weights and the queue lengths alone: a queue's i-th
token falls due at credit i / weight, ties go by source. So the deficits that a window, or a
task, takes over from those before it are computed in closed form (`Schedule.served`), and
every task places its own documents without hearing from any other. An empty queue stops
earning; the others share its part. In a window the queues stand one after another.

With the default weights, the sources' own token totals, every window has the corpus's
mixture and all queues end together. Only the last window is padded, and it is cut to a
power of two where that holds it.

Stages: encode once and write (part, source, start in the part's queue, ids); total per part
and source, running sums over the parts; join the small table of bases; cut by the schedule.
A hot source is only a longer queue: rows are dealt by part, never by source.

Defined results: a null or empty text is its end id; a null source is a queue of its own
(named ''); repeated rows are separate documents. Columns besides doc_id, text and source
are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diurna.llm.common import column, small_or_not, staged
from diurna.llm.encoding import REMEMBERED, encoder

WINDOW_TOKENS = 2048


class Schedule:
    """Exact integer arithmetic of the round-robin: totals and weights by source."""

    def __init__(self, totals: dict[str, int], weights: dict[str, int] | None = None, window: int = WINDOW_TOKENS):
        self.window = window
        self.names = sorted(s for s, n in totals.items() if n > 0)
        self.totals = [totals[s] for s in self.names]
        self.weights = [int((weights or totals)[s]) for s in self.names]
        if any(w <= 0 for w in self.weights):
            raise ValueError("weights are positive whole numbers")
        self.all = sum(self.totals)
        self.windows = -(-self.all // window)
        self.scale = 1 << (2 * max([1, *self.weights]).bit_length() + 1)  # tells any two due times apart
        # queues by the credit at which they run dry, with the tokens served and the weight active by then
        self.dry = sorted(range(len(self.names)), key=lambda i: (self._due(i, self.totals[i]), i))
        self.phase_start = [0]
        for k, i in enumerate(self.dry):
            ended = sum(self.totals[j] for j in self.dry[:k + 1])
            active = sum(self.totals[i] * self.weights[j] // self.weights[i] for j in self.dry[k + 1:])
            self.phase_start.append(ended + active)
        self.memo: dict[int, list[int]] = {}

    def _due(self, queue: int, token: int) -> int:
        """Scaled credit at which the token-th token of a queue (from 1) is covered."""
        return token * self.scale // self.weights[queue]

    def served(self, window: int) -> list[int]:
        """Tokens that each queue has given before a window."""
        if window in self.memo:
            return self.memo[window]
        goal = min(window * self.window, self.all)
        # a lower bound from the phase's active queues, then token by token in order of due credit
        k = max(0, bisect_right(self.phase_start, goal) - 1)
        out = self._floor(goal, k)
        left = goal - sum(out)
        due = [(self._due(i, c + 1), i) for i, c in enumerate(out) if c < self.totals[i]]
        heapq.heapify(due)
        while left > 0:
            _, i = heapq.heappop(due)
            out[i] += 1
            left -= 1
            if out[i] < self.totals[i]:
                heapq.heappush(due, (self._due(i, out[i] + 1), i))
        if len(self.memo) > 50_000:
            self.memo.clear()
        self.memo[window] = out
        return out

    def _floor(self, goal: int, k: int) -> list[int]:
        while k >= 0:
            ended, active = self.dry[:k], self.dry[k:]
            rest, weight = goal - sum(self.totals[i] for i in ended), sum(self.weights[i] for i in active)
            out = [0] * len(self.names)
            for i in ended:
                out[i] = self.totals[i]
            for i in active:
                out[i] = min(self.totals[i], max(0, rest) * self.weights[i] // weight)
            # the ended queues must indeed be dry at this credit
            if rest >= 0 and all(self.totals[i] * weight <= rest * self.weights[i] for i in ended):
                return out
            k -= 1
        return [0] * len(self.names)

    def pieces(self, source: str, start: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(offset in the range, length, window, offset in the window) of a range of a queue."""
        queue = self.names.index(source)
        low, high = 0, self.windows  # the window of the first token
        while high - low > 1:
            mid = (low + high) // 2
            if self.served(mid)[queue] <= start:
                low = mid
            else:
                high = mid
        at = start
        while at < start + length:
            here, after = self.served(low), self.served(low + 1)
            end = min(start + length, after[queue])
            if end > at:
                before = sum(after[i] - here[i] for i in range(queue))
                yield at - start, end - at, low, before + at - here[queue]
                at = end
            low += 1


def encoded(docs: DataFrame, vocabulary: str, end_id: int = 1, remembered: int = REMEMBERED) -> DataFrame:
    """(part, source, start, doc_id, ids): every document's place in its part's queue of its source.

    remembered: words whose ids a worker keeps, memory against time; the ids are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, part, queues = encoder(vocabulary, remembered), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            n = batch.num_rows
            for at in range(0, n, 512):
                some = batch.slice(at, 512)
                sources = [s or "" for s in column(some, "source").to_pylist()]
                bodies = [b + end for b in lib.encode_many(t.as_py() or "" for t in column(some, "text"))]
                starts = []
                for source, body in zip(sources, bodies):
                    starts.append(queues.get(source, 0))
                    queues[source] = starts[-1] + len(body) // 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(bodies), pa.int32()), pa.array(sources), pa.array(starts, pa.int64()),
                     column(some, "doc_id"), pa.array(bodies, pa.binary())],
                    names=["part", "source", "start", "doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"))
    return staged(rows.mapInArrow(run, "part int, source string, start bigint, doc_id bigint, ids binary"), "ids")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW_TOKENS,
         weights: dict[str, int] | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces: doc_id, start, length, ids, doc_tokens, sequence_id, offset, sequence_tokens (with padding)."""
    tokens = encoded(docs, vocabulary, end_id, remembered)
    sizes = tokens.groupBy("part", "source").agg(F.sum(F.octet_length("ids") / 4).cast("long").alias("n"))
    sizes = staged(sizes, "queues")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row a source: the round-robin needs every queue's length
    totals = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    if weights is not None:
        weights = {s: weights.get(s, 1) for s in totals}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(totals, weights, window)
        last = plan.all - (plan.windows - 1) * window
        padded = min(window, 1 << (last - 1).bit_length()) if last > 0 else window
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[list] = [[] for _ in range(8)]
                for row in batch.slice(at, 256).to_pylist():
                    body, n = row["ids"], len(row["ids"]) // 4
                    for first, length, seq, offset in plan.pieces(row["source"], row["base"] + row["start"], n):
                        values = (row["doc_id"], first, length, body[4 * first:4 * (first + length)], n, seq, offset,
                                  padded if seq == plan.windows - 1 else window)
                        for column_values, v in zip(out, values):
                            column_values.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=NAMES)

    placed = tokens.join(small_or_not(bases), ["part", "source"])
    return placed.mapInArrow(run, ", ".join(f"`{n}` {'binary' if n == 'ids' else 'bigint'}" for n in NAMES))


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole windows from pieces: sequence_id, ids (a window's worth of pieces, so bounded)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.array_join(F.transform(ordered, lambda x: F.hex(x["ids"])), "").alias("h")).select(
        "sequence_id", F.unhex("h").alias("ids"))
