"""Repeated byte strings of a corpus by prefix-free parsing.

A text is parsed by a rolling hash: an eight-byte string whose hash falls under a limit is a
trigger, and a phrase runs from one trigger to the end of the next. The parse of a string
depends on the string alone, so equal strings of `length` bytes hold equal phrases. What is
asked is not the whole order of the suffixes but which of them share their first `length`
bytes with another, so the suffixes of dictionary and parse are named by hashes of their first
`length` bytes (equal names, neighbours in the order) and no sort of the corpus is needed:

1. Dictionary. Every window of `length` bytes picks the longest phrase in it. Only picked
   phrases are counted over all distinct texts; a window whose phrase was picked once is
   unique. (A window with under two triggers is counted itself.)
2. Parse. Windows with the same whole phrases form a run, two runs a phrase at most. A run is
   named by its whole phrases (inner name) and by all bytes that it touches (outer name). Two
   runs with one outer name repeat each other window by window.
3. Edges. Where an inner name has several outer names, the parse agrees but the phrases around
   it differ: the edge of a copied passage. One run of each outer name compares its windows
   one by one.

Exact copies are one text from the start: if it has `length` bytes, all of them go. All counts
are aggregates that combine before the shuffle, so a passage in a third of all texts is one
row per task; texts are sent only if they hold a repeated phrase. Names are 64-bit hashes.

Defined results: a null text is empty; a text under `length` bytes keeps all; matches do not
cross texts; repeated rows are copies. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diurna.llm.common import column, small_or_not, staged, unstage
from diurna.llm.hashing import Rolling, mixed

GRAM = 8
#: Mean number of triggers in a window.
TRIGGERS = 8
_BARE = np.uint64(0xA24BAED4963EE407)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class Parse:
    """Triggers, phrases and runs of windows of one text."""

    def __init__(self, data: bytes, length: int):
        self.n, self.length = len(data), length
        self.roll = Rolling(np.frombuffer(data, np.uint8))
        limit = np.uint64((1 << 64) // max(2, length // TRIGGERS))
        self.at = np.flatnonzero(self.roll.windows(GRAM) < limit)
        self.phrases = self.roll.hashes(self.at[:-1], self.at[1:] + GRAM) if len(self.at) > 1 else np.zeros(0, np.uint64)
        last = self.n - length  # start of the last window
        cuts = np.concatenate([[0], self.at + 1, self.at - (length - GRAM), [last + 1]])
        cuts = np.unique(cuts[(cuts >= 0) & (cuts <= last + 1)])
        self.starts, self.sizes = cuts[:-1], np.diff(cuts)
        self.first = np.searchsorted(self.at, self.starts, "left")
        self.past = np.searchsorted(self.at, self.starts + length - GRAM, "right") - 1  # its last trigger
        self.whole = self.past > self.first
        self.picks = self._longest(self.first[self.whole], self.past[self.whole])

    def _longest(self, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        """Index of the longest phrase in each range, by smaller hash among equals, then the leftmost."""
        if not len(first):
            return np.zeros(0, np.int64)
        order = np.lexsort((np.arange(len(self.phrases)), self.phrases, -np.diff(self.at)))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        levels = [rank]
        while 2 << (len(levels) - 1) <= int((past - first).max()):
            step = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        level = np.frexp((past - first).astype(float))[1] - 1
        out = np.empty(len(first), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(levels[k][first[own]], levels[k][past[own] - (1 << int(k))])
        return order[out]

    def bare(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and names of the windows with under two triggers."""
        starts, sizes = self.starts[~self.whole], self.sizes[~self.whole]
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.concatenate([np.arange(s, s + k) for s, k in zip(starts, sizes)])
        return at, mixed(self.roll.hashes(at, at + self.length) ^ _BARE)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Names that windows of this text depend on, and how often each stands in it."""
        both = np.concatenate([self.phrases[np.unique(self.picks)], self.bare()[1]])
        names, counts = np.unique(both, return_counts=True)
        return names.view(np.int64), counts

    def runs(self, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inner name, outer name, start and size of the runs that depend on one of these names."""
        live = np.isin(self.phrases[self.picks].view(np.int64), alive)
        start, size = self.starts[self.whole][live], self.sizes[self.whole][live]
        first, past = self.at[self.first[self.whole][live]], self.at[self.past[self.whole][live]]
        inner = self.roll.hashes(first, past + GRAM)
        outer = self.roll.hashes(start, start + size - 1 + self.length)
        outer = mixed(outer + (first - start).astype(np.uint64) * np.uint64(3) + size.astype(np.uint64) * np.uint64(0x10001))
        return inner.view(np.int64), outer.view(np.int64), start, size

    def bare_alive(self, alive: np.ndarray) -> np.ndarray:
        at, names = self.bare()
        return at[np.isin(names.view(np.int64), alive)]


def _digest(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _short(digest: str = "sha") -> Column:
    return F.unhex(F.substring(digest, 1, 32))


def _names(rows: DataFrame, length: int) -> DataFrame:
    """Per text (id, n): the names it depends on with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts = [], []
            for text in column(batch, "text"):
                data = _bytes(text.as_py())
                own = Parse(data, length).keys() if len(data) >= length else (np.zeros(0, np.int64),) * 2
                names.append(own[0])
                counts.append(own[1].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "sha"), column(batch, "n"),
                 pa.array(names, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "sha", "n", "names", "counts"])

    return rows.mapInArrow(run, "doc_id bigint, sha string, n bigint, names array<bigint>, counts array<int>")


def _runs(texts: DataFrame, length: int) -> DataFrame:
    """(inner, outer, id, at, size); inner is null for windows already known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                parse, alive = Parse(_bytes(row["text"]), length), np.array(row["alive"], np.int64)
                inner, outer, at, size = parse.runs(alive)
                bare = parse.bare_alive(alive)
                starts, sizes = _spans(bare, np.ones(len(bare), np.int64))
                n = len(inner) + len(starts)
                none = np.concatenate([np.zeros(len(inner), bool), np.ones(len(starts), bool)])
                join = lambda a, b: np.concatenate([a, b]).astype(np.int64)
                zero = np.zeros(len(starts), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(join(inner, zero), mask=none), pa.array(join(outer, zero), mask=none),
                     pa.array([row["id"]] * n, pa.binary()), pa.array(join(at, starts)), pa.array(join(size, sizes))],
                    names=["inner", "outer", "id", "at", "size"])

    return texts.mapInArrow(run, "inner bigint, outer bigint, id binary, at bigint, size bigint")


def _spans(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of the union of [at, at + size)."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(at, kind="stable")
    at, end = at[order], np.maximum.accumulate((at + size)[order])
    new = np.concatenate([[True], at[1:] > end[:-1]])
    starts = at[new]
    ends = end[np.concatenate([new[1:], [True]])]
    return starts, ends - starts


def _windows(edges: DataFrame, length: int) -> DataFrame:
    """(name, id, at, alone) of every window of the runs that are compared one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                roll = Rolling(np.frombuffer(_bytes(row["text"]), np.uint8))
                at = np.concatenate([np.arange(r["at"], r["at"] + r["size"]) for r in row["runs"]])
                alone = np.repeat([r["alone"] for r in row["runs"]], [r["size"] for r in row["runs"]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(roll.hashes(at, at + length).view(np.int64)), pa.array([row["id"]] * len(at), pa.binary()),
                     pa.array(at), pa.array(alone)], names=["name", "id", "at", "alone"])

    return edges.mapInArrow(run, "name bigint, id binary, at bigint, alone boolean")


def repeated(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, sha, n) of every row; (id, copies) of distinct texts; (id, text, spans) of those with repeats.

    spans holds maximal (at, size) of repeated bytes, of texts that are not whole copies too.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .withColumns({"sha": _digest(), "n": F.octet_length(F.coalesce("text", F.lit(""))).cast("long")})
    base = staged(_names(rows, length), "names")
    distinct = staged(base.groupBy("sha").agg(
        F.count("*").alias("copies"), F.first("names").alias("names"), F.first("counts").alias("counts"))
        .withColumn("id", _short()).drop("sha"), "distinct")
    each = distinct.select("id", F.explode(F.arrays_zip("names", "counts")).alias("x")).select(
        "id", F.col("x.names").alias("name"), F.col("x.counts").alias("k"))
    alive = each.groupBy("name").agg(F.sum("k").alias("k")).filter("k >= 2").select("name")
    held = alive_names = staged(each.join(alive, "name").groupBy("id").agg(F.collect_list("name").alias("alive")), "alive")
    texts = docs.select("text").withColumn("id", _short_of_text()).join(small_or_not(held.select("id")), "id", "left_semi") \
        .dropDuplicates(["id"])
    texts = staged(texts.join(held, "id"), "texts")

    runs = staged(_runs(texts, length), "runs")
    named = runs.filter("inner is not null").groupBy("inner", "outer").agg(
        F.count("*").alias("k"), F.min(F.struct("id", "at", "size")).alias("one"))
    named = staged(named, "named")
    known = runs.join(named.filter("k >= 2").select("inner", "outer"), ["inner", "outer"], "left_semi").select("id", "at", "size")
    known = known.unionByName(runs.filter("inner is null").select("id", "at", "size"))
    several = named.groupBy("inner").agg(F.count("*").alias("outers")).filter("outers >= 2").select("inner")
    edges = named.join(several, "inner", "left_semi").select("one.*", (F.col("k") == 1).alias("alone"))
    edges = staged(edges, "edges")
    runs_of = edges.groupBy("id").agg(F.collect_list(F.struct("at", "size", "alone")).alias("runs"))
    windows = staged(_windows(texts.select("id", "text").join(small_or_not(runs_of, edges), "id"), length), "windows")
    again = windows.groupBy("name").agg(F.count("*").alias("k")).filter("k >= 2").select("name")
    found = windows.filter("alone").join(again, "name", "left_semi").select("id", "at", F.lit(1).cast("long").alias("size"))

    spans = staged(known.unionByName(found).groupBy("id").agg(F.collect_list(F.struct("at", "size")).alias("windows")), "spans")
    held = texts.select("id", "text").join(small_or_not(spans, spans.select(F.explode("windows"))), "id")
    unstage(runs, named, edges, windows, alive_names)
    held._below = (base, distinct, texts, spans)
    return base.select("doc_id", "sha", "n"), distinct.select("id", "copies"), held


def _short_of_text() -> Column:
    return F.unhex(F.substring(_digest(), 1, 32))


def _removed(windows: list[dict], length: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array([w["at"] for w in windows], np.int64)
    size = np.array([w["size"] for w in windows], np.int64)
    return _spans(at, size + length - 1)


def digests(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    base, distinct, held = repeated(docs, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data = _bytes(row["text"])
                starts, sizes = _removed(row["windows"], length)
                kept, at = hashlib.sha256(), 0
                for s, k in zip(starts.tolist(), sizes.tolist()):
                    kept.update(data[at:s])
                    at = s + k
                kept.update(data[at:])
                for values, v in zip(out, (int(sizes.sum()), len(starts), kept.hexdigest())):
                    values.append(v)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                names=["id", "n_removed", "n_spans", "kept"])

    changed = held.mapInArrow(run, "id binary, n_removed bigint, n_spans bigint, kept string")
    per_text = distinct.join(changed, "id", "left")
    rows = base.withColumn("id", _short()).join(per_text, "id", "left")
    whole = (F.col("copies") > 1) & (F.col("n") >= length)
    return rows.select(
        "doc_id", F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def cut(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs with repeated strings cut from `text`; a character is cut if all its bytes are repeated."""
    _, distinct, held = repeated(docs, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data = np.frombuffer(_bytes(row["text"]), np.uint8)
                starts, sizes = _removed(row["windows"], length)
                keep = np.ones(len(data), np.int64)
                for s, k in zip(starts, sizes):
                    keep[s:s + k] = 0
                heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                full = np.add.reduceat(keep, heads[:-1]) > 0 if len(data) else np.zeros(0, bool)
                kept.append(data[np.repeat(full, np.diff(heads))].tobytes().decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(kept, pa.string())], names=["id", "kept"])

    changed = held.mapInArrow(run, "id binary, kept string")
    per_text = distinct.join(changed, "id", "left").filter("copies > 1 or kept is not null").withColumnsRenamed(
        {"id": "_id", "kept": "_kept", "copies": "_copies"})
    per_text = staged(per_text, "cut")
    unstage(*held._below)
    ids = small_or_not(per_text.select("_id"))
    same = _short_of_text() == F.col("_id")
    # only texts that change are sent to where their rest is
    changing = docs.join(ids, same, "left_semi").join(per_text, same)
    whole = (F.col("_copies") > 1) & (F.octet_length("text") >= length)
    text = F.when(whole, F.lit("")).otherwise(F.coalesce("_kept", "text"))
    changing = changing.withColumn("text", text).drop("_id", "_kept", "_copies")
    return docs.join(ids, same, "left_anti").unionByName(changing)
