"""Token ids in directly addressable codes: any token is read without decoding others.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id, level
k + 1 the next chunk of those ids of level k that go on, marked in the level's bitmap. A rank
directory counts the marks before each block of 512 bits, so following an id down the levels
costs one popcount of at most one block per level.

A shard is one such code for consecutive documents with a directory of their lengths. Shards
are rows of a Parquet table, as Spark commits those whole on any store; `payload` is the
binary format. Documents are in ascending doc_id order over the shards (part, seq).

Defined results: a null or empty text is its end id alone; null doc_ids come first; rows with
one doc_id are stored each, in order of their text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diurna.llm.common import column, small_or_not, staged
from diurna.llm.encoding import encoder

BITS, RANK_BLOCK = 8, 512
MAGIC = b"DAC1"
#: Tokens after which a shard is closed; a longer document is a shard of its own.
SHARD_TOKENS = 1 << 19
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_levels(ids: np.ndarray) -> bytes:
    """The binary format: magic, levels, then per level its length, chunks, bitmap and ranks."""
    parts, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(more)
        blocks = np.add.reduceat(_ONES[bitmap], np.arange(0, len(bitmap), RANK_BLOCK // 8), dtype=np.int64) \
            if len(bitmap) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u4")
        parts.append(struct.pack("<QI", len(rest), len(ranks)) + (rest & 0xFF).astype(np.uint8).tobytes()
                     + bitmap.tobytes() + ranks.tobytes())
        if not more.any():
            break
        rest = rest[more] >> BITS
    return MAGIC + struct.pack("<I", len(parts)) + b"".join(parts)


class Levels:
    """Reads the format in place."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.levels = []
        at = 8
        for _ in range(struct.unpack_from("<I", payload, 4)[0]):
            n, blocks = struct.unpack_from("<QI", payload, at)
            at += 12
            chunks = np.frombuffer(payload, np.uint8, n, at)
            at += n
            bitmap = np.frombuffer(payload, np.uint8, (n + 7) // 8, at)
            at += len(bitmap)
            self.levels.append((chunks, bitmap, np.frombuffer(payload, "<u4", blocks, at)))
            at += 4 * blocks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def rank(self, level: int, i: int) -> int:
        """Marks before position i."""
        _, bitmap, ranks = self.levels[level]
        block = i // RANK_BLOCK
        first = block * RANK_BLOCK // 8
        count = int(ranks[block]) + int(_ONES[bitmap[first:i // 8]].sum())
        return count + (bin(bitmap[i // 8] >> (8 - i % 8)).count("1") if i % 8 else 0)

    def token(self, i: int) -> int:
        """The id at position i."""
        value, shift = 0, 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bitmap[i // 8] >> (7 - i % 8) & 1:
                break
            i, shift = self.rank(level, i), shift + BITS
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids of a range: a range of one level is a range of the next."""
        out = where = None
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            part = chunks[start:end].astype(np.uint32) << (BITS * level)
            if out is None:
                out, where = part, np.arange(end - start)
            else:
                out[where] |= part
            base = start // 8
            marks = np.unpackbits(bitmap[base:(end + 7) // 8])[start - 8 * base:end - 8 * base].astype(bool)
            where = where[marks]
            if not len(where):
                break
            first = self.rank(level, start)
            start, end = first, first + len(where)
        return out


def write(docs: DataFrame, vocabulary: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The shard table (part, seq, doc_ids, lengths, n_tokens, payload), written to the shared folder."""

    def pack(ids: list, bodies: list[bytes], part: int, seq: int) -> pa.RecordBatch:
        all_ids = np.frombuffer(b"".join(bodies), "<u4")
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
             pa.array([[len(b) // 4 for b in bodies]], pa.list_(pa.int64())), pa.array([len(all_ids)], pa.int64()),
             pa.array([encode_levels(all_ids)], pa.binary())],
            names=["part", "seq", "doc_ids", "lengths", "n_tokens", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, part, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        ids, bodies, size = [], [], 0
        for batch in batches:
            texts = (t.as_py() or "" for t in column(batch, "text"))
            for doc_id, body in zip(column(batch, "doc_id").to_pylist(), lib.encode_many(texts)):
                body += end
                if ids and size + len(body) // 4 > shard_tokens:
                    yield pack(ids, bodies, part, seq)
                    ids, bodies, size, seq = [], [], 0, seq + 1
                ids.append(doc_id)
                bodies.append(body)
                size += len(body) // 4
        if ids:
            yield pack(ids, bodies, part, seq)

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id") \
        .sortWithinPartitions("doc_id", "text")
    schema = "part int, seq int, doc_ids array<bigint>, lengths array<bigint>, n_tokens bigint, payload binary"
    return staged(ordered.mapInArrow(run, schema), "tokens")


def read(shards: DataFrame, each: Callable[[Levels, int, int], object], field: str) -> DataFrame:
    """Per document: doc_id, start (ids before it), n_tokens and each(levels, first, past) as `field`.

    The running totals go over one row a shard and one row a partition; both tables are of a
    bounded share of the data's size.
    """
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn(
        "part_base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.join(parts, "part").select(
        "part", "seq", (F.coalesce("part_base", F.lit(0)) + F.coalesce(inside, F.lit(0))).alias("base"))
    name, kind = field.split(" ", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels, at, starts, values = Levels(row["payload"]), 0, [], []
                for n in row["lengths"]:
                    starts.append(row["base"] + at)
                    values.append(each(levels, at, at + n))
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(row["lengths"], pa.int64()), pa.array(values)], names=["doc_id", "start", "n_tokens", name])

    placed = shards.drop("n_tokens").join(small_or_not(bases), ["part", "seq"])
    return placed.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {name} {kind}")


def checksum(levels: Levels, first: int, past: int) -> int:
    """Unsigned CRC-32 of a range's ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(levels.tokens(first, past).astype("<u4").tobytes())
