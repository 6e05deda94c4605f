r"""Line deduplication: keys of lines in one global order, streamed once, answered with bitmaps.

A line's key is the line without white space (20, 09-0D) at both ends and with A-Z lower-cased.

1. Every document sends one record per distinct key: its 128-bit hash and the positions of its
   lines. Records go to ranges of (key, document), so a key that stands in a third of all
   documents is spread over several ranges, and are sorted there by key, then document.
2. Each range is streamed once. A key with `min_docs` documents inside a range is decided there;
   at most `min_docs` - 1 records of a key wait. Only the first and the last key of a range can
   go on in another one: their few waiting records and their counts, a few rows per range, are
   settled afterwards by a sum over ranges.
3. What loses lines comes back as positions and is folded per document to a compressed bitmap
   of the lines that stay. No text is shuffled up to here; texts meet their bitmaps by id.

With `keep_first`, the first occurrence in order of document and position stays; else a key
that is common loses all its lines.

Defined results: a null or empty text is one empty line, which has no key and stays. A document
is a distinct pair of id and text: a repeated row counts once and is treated like its copy,
different texts under one id (or without id) are documents of their own. Columns other than
doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diurna.llm.common import column, document_columns, staged, unstage

WHITE = b" \t\n\x0b\x0c\r"
MIN_DOCS, MIN_CHARS = 10, 1
#: Kinds of streamed records: lines to drop, a waiting record of a border key, the count of a border key.
DROP, WAIT, COUNT = 0, 1, 2
RECORD = "h1 bigint, h2 bigint, doc_id bigint, t bigint, n_lines int, at binary"


def key_of(line: bytes) -> bytes:
    return line.strip(WHITE).lower()  # of bytes, so only A-Z change


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text, which tells texts under one id apart) and text."""
    d = document_columns(docs, "doc_id", "text").withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce("text", F.lit(""))})
    return d.select("doc_id", F.xxhash64("text").alias("t"), "text")


def _records(min_chars: int):
    """One record per document and distinct key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = column(batch, "doc_id"), column(batch, "t")
            rows, digests, counts, places = [], [], [], []
            for row, text in enumerate(column(batch, "text").to_pylist()):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                found: dict[bytes, list[int]] = {}
                for i, line in enumerate(lines):
                    key = key_of(line)
                    if key and (min_chars == 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                        found.setdefault(key, []).append(i)
                rows.extend([row] * len(found))
                counts.extend([len(lines)] * len(found))
                digests.extend(hashlib.md5(key, usedforsecurity=False).digest() for key in found)
                places.extend(np.array(own, "<u4").tobytes() for own in found.values())
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), ids.take(take), hashes.take(take),
                 pa.array(counts, pa.int32()), pa.array(places, pa.binary())],
                names=["h1", "h2", "doc_id", "t", "n_lines", "at"])

    return run


class _Stream:
    """Records of one range in order of key and document, batch by batch.

    `held` are the waiting records of the newest key, `docs` its documents so far; only a key
    that opens or closes the range is put out as waiting.
    """

    def __init__(self, min_docs: int, keep_first: bool):
        self.min_docs, self.keep_first = min_docs, keep_first
        self.key, self.docs, self.last, self.opening = None, 0, None, True
        self.held: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, key: tuple, doc: tuple, n_lines: int, at: bytes) -> None:
        if key != self.key:
            if self.key is not None:
                self.close(border=self.opening)
                self.opening = False
            self.key, self.docs, self.last, self.held = key, 0, None, []
        if doc == self.last:
            return  # a repeated row
        self.last = doc
        self.docs += 1
        row = (*key, *doc, n_lines, at)
        if self.docs < self.min_docs or (self.keep_first and self.docs == 1):
            self.held.append(row)
            return
        if self.docs == self.min_docs:
            # the first record of a border key stays held: an earlier range may have had the key
            keep = 1 if self.keep_first else 0
            self.out += [(DROP, 0, *r) for r in self.held[keep:]]
            self.held = self.held[:keep]
        self.out.append((DROP, 0, *row))

    def close(self, border: bool) -> None:
        if border:
            self.out.append((COUNT, self.docs, *self.key, None, 0, 0, b""))
            self.out += [(WAIT, int(i == 0), *r) for i, r in enumerate(self.held)]
        elif self.docs >= self.min_docs and self.held:  # only with keep_first: all but the first place go
            *head, at = self.held[0]
            if len(at) > 4:
                self.out.append((DROP, 0, *head, at[4:]))

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


_STREAMED = pa.schema([("kind", pa.int32()), ("docs", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()),
                       ("t", pa.int64()), ("n_lines", pa.int32()), ("at", pa.binary())])


def _streamed(min_docs: int, keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(min_docs, keep_first)
        for batch in batches:
            h1, h2, ids, t = (column(batch, n) for n in ("h1", "h2", "doc_id", "t"))
            a, b = h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)
            # most keys stand in one document: look only at records beside a record of the same key, and at both ends
            same = np.zeros(len(a) + 1, bool)
            same[0] = same[-1] = True
            same[1:-1] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            near = np.flatnonzero(same[1:] | same[:-1])
            if stream.min_docs <= 1:
                near = np.arange(len(a))
            part = batch.take(pa.array(near))
            rows = [column(part, n).to_pylist() for n in ("h1", "h2", "doc_id", "t", "n_lines", "at")]
            for x, y, doc, text, n, at in zip(*rows):
                stream.add((x, y), (doc, text), n, at)
            done = stream.taken()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _STREAMED)], schema=_STREAMED)
        if stream.key is not None:
            stream.close(border=True)
            done = stream.taken()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _STREAMED)], schema=_STREAMED)

    return run


def _settled(streamed: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """Positions to drop: those decided in a range, and those of border keys after a sum over ranges."""
    total = streamed.filter(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("docs").alias("docs")).filter(
        F.col("docs") >= min_docs)
    waiting = streamed.filter(F.col("kind") == WAIT).withColumnRenamed("docs", "leads").join(total, ["h1", "h2"])
    if keep_first:
        leader = waiting.filter("leads = 1").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "t")).alias("first"))
        is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
        waiting = waiting.join(leader, ["h1", "h2"]).withColumn(
            "at", F.when(is_first, F.expr("substr(at, 5)")).otherwise(F.col("at")))
    parts = ["doc_id", "t", "n_lines", "at"]
    return streamed.filter(F.col("kind") == DROP).select(*parts).unionByName(waiting.select(*parts)).filter("length(at) > 0")


_BITMAPS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("t", T.LongType()), T.StructField("n_lines", T.LongType()),
    T.StructField("n_dropped", T.LongType()), T.StructField("keep", T.BinaryType())])


def pack_bits(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_bits(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n).astype(bool)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dropped, bitmaps = [], []
        for n, lists in zip(column(batch, "n_lines").to_pylist(), column(batch, "parts").to_pylist()):
            keep = np.ones(n, bool)
            keep[np.frombuffer(b"".join(lists), "<u4")] = False
            dropped.append(int(n - keep.sum()))
            bitmaps.append(pack_bits(keep))
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), column(batch, "t"), column(batch, "n_lines"), pa.array(dropped, pa.int64()), pa.array(bitmaps, pa.binary())],
            names=_BITMAPS.names)


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """doc_id, t (xxHash of the text), n_lines, n_dropped, keep: one row per document that loses lines.

    keep: a bit per line, most significant first, compressed with zlib (`unpack_bits`). min_chars
    counts code points of a key. The positions are staged: their order is made once.
    """
    if min_docs < 1 or min_chars < 1:
        raise ValueError("min_docs and min_chars must be 1 or more")
    records = staged(_documents(docs).mapInArrow(_records(min_chars), RECORD), "line-keys")
    order = ["h1", "h2", "doc_id", "t"]
    streamed = staged(
        records.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_streamed(min_docs, keep_first), "kind int, docs bigint, " + RECORD), "line-drops")
    unstage(records)
    per_doc = _settled(streamed, min_docs, keep_first).groupBy("doc_id", "t").agg(
        F.max("n_lines").cast("long").alias("n_lines"), F.collect_list("at").alias("parts"))
    return per_doc.mapInArrow(_folded, _BITMAPS)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, dropped, texts = [], [], []
        lost = column(batch, "n_dropped").to_pylist()
        for text, gone, bits in zip(column(batch, "text").to_pylist(), lost, column(batch, "keep").to_pylist()):
            n = text.count("\n") + 1
            counts.append(n)
            dropped.append(gone or 0)
            if gone:
                keep = unpack_bits(bits, n)
                text = "\n".join(line for line, k in zip(text.split("\n"), keep) if k)
            texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "text"])


def cleaned(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left, one row per row of docs.

    Texts are only streamed past the bitmaps of their partition, not sorted.
    """
    left, right = _documents(docs).alias("l"), bitmaps.select("doc_id", "t", "n_dropped", "keep").alias("r")
    joined = left.join(right.hint("shuffle_hash"), F.expr("l.doc_id <=> r.doc_id AND l.t = r.t"), "left").select(
        "l.doc_id", "l.text", "r.n_dropped", "r.keep")
    return joined.mapInArrow(_kept, "doc_id bigint, n_lines bigint, n_dropped bigint, text string")


def digests(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """n_lines, n_dropped and the SHA-256 of what is left of each document."""
    return cleaned(docs, keep_bitmaps(docs, min_docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
