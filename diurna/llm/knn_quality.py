"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are pairs of neighbouring character classes (lower and upper case, digit,
space, line end, each ASCII mark, other bytes) and repetition terms (words equal to the one
before, words seen before, words in lines seen before), counted over the whole text as shares.
A bounded sample of labelled texts gives the weights of the terms and, by singular value
decomposition, the latent directions; its vectors and labels are sent to every task (their
size is fixed by SAMPLE and LATENT). Every document's cosine with every labelled vector is
computed exactly, in blocks; the NEIGHBOURS most similar vote with a power of the similarity.

The sample takes the SAMPLE // 2 labelled documents of each class with the smallest hash of
their id; a vote is weighted back by how many labelled documents a sampled one stands for.

Defined results: a null or empty text has no terms and gets the share of label 1; without any
labels every score is 0.5; a document labelled twice counts as two; rows that repeat are
scored alike; labels without a document are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.llm.common import column
from diurna.llm.hashing import Rolling

SAMPLE, LATENT, NEIGHBOURS, POWER = 4096, 48, 9, 16.0
BLOCK_ROWS = 512

_CLASS = np.zeros(256, np.int64)  # 0: bytes of other scripts
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 13]] = 1, 2, 3, 4, 5
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_MARKS] = np.arange(6, 6 + len(_MARKS))
CLASSES = 6 + len(_MARKS)
TERMS = CLASSES * CLASSES + 3
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def terms(text: str | None) -> np.ndarray:
    """Square roots of the shares of a text's terms."""
    out = np.zeros(TERMS, np.float32)
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) < 2:
        return out
    kind = _CLASS[data]
    out[:-3] = np.bincount(kind[:-1] * CLASSES + kind[1:], minlength=TERMS - 3) / (len(data) - 1)
    inside = np.concatenate([[False], ~_WHITE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if len(edges):
        roll = Rolling(data)
        words = roll.hashes(edges[::2], edges[1::2])
        n = len(words)
        breaks = np.flatnonzero(data == 10)
        starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])
        lines = roll.hashes(starts, ends)[ends > starts]
        sizes = (ends - starts)[ends > starts]
        first = np.unique(lines, return_index=True)[1]
        out[-3:] = (words[1:] == words[:-1]).sum() / n, 1 - len(np.unique(words)) / n, 1 - sizes[first].sum() / sizes.sum()
    return np.sqrt(out)


@dataclass
class Model:
    """Term weights, latent directions, labelled vectors with label and weight, share of label 1."""

    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    counts: np.ndarray
    prior: float

    def latent(self, rows: np.ndarray) -> np.ndarray:
        z = (rows * self.weights) @ self.directions
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        near = self.latent(rows) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
        votes = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** POWER * self.counts[top]
        total = votes.sum(axis=1)
        return np.where(total > 1e-9, (votes * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-9), self.prior)


def fit(rows: np.ndarray, labels: np.ndarray, counts: np.ndarray, prior: float) -> Model:
    """rows: terms of the sample; counts: labelled documents that each stands for."""
    if not len(rows):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32),
                     labels, counts, prior)
    weights = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1).astype(np.float32)
    x = rows * weights
    values, directions = np.linalg.eigh(x.T.astype(np.float64) @ x)
    model = Model(weights, directions[:, ::-1][:, :LATENT].astype(np.float32), np.zeros((0, LATENT), np.float32),
                  labels, counts, prior)
    model.vectors = model.latent(rows)
    return model


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Terms, labels and weights of the bounded sample, and the share of label 1 among all labels given."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")) \
        .filter("doc_id is not null and label in (0, 1)")
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    picked = None
    for label in sorted(sizes):
        some = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        return np.zeros((0, TERMS), np.float32), np.zeros(0), np.zeros(0), prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(t.as_py()).tobytes() for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "label"), pa.array(rows, pa.binary())], names=["doc_id", "label", "terms"])

    # the sample is bounded, so the broadcast and what comes to the driver are
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    found = sorted((r.doc_id, r.label, bytes(r.terms)) for r in texts.mapInArrow(run, "doc_id bigint, label int, terms binary").collect())
    rows = np.array([np.frombuffer(t, np.float32) for _, _, t in found]).reshape(-1, TERMS)
    own = np.array([label for _, label, _ in found], float)
    counts = np.array([sizes[label] / max(1, (own == label).sum()) for _, label, _ in found])
    return rows, own, counts / max(1.0, counts.min(initial=1.0)), prior


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                rows = np.array([terms(t.as_py()) for t in column(some, "text")])
                yield pa.RecordBatch.from_arrays(
                    [column(some, "doc_id"), pa.array(np.clip(shared.value.scores(rows), 0, 1))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
