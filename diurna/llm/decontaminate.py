"""Benchmark decontamination by Wu-Manber search over words.

Texts are lower-cased in A-Z and cut into words of letters, digits and non-ASCII bytes. The
test strings are windows of ten item words; an item of fewer words is one window. Windows of
one length form a class with its own tables: a shift table from blocks of two words says how
far the scan may jump, and a block that ends a window leads to a bucket of windows, which are
compared word by word. Word alignment comes for free, as the symbols are words.

The benchmark is the query set: it is brought to the driver in blocks of bounded size, and
each block's tables pass over all documents in one map. Documents are never shuffled.

Defined results: a null or empty text has no words and no hits; an item without words has no
window; an item without an id marks words but is not listed; rows with one item_id count as
one item. Repeated documents are judged alike.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from diurna.llm.common import column, document_columns

WINDOW = 10
#: Benchmark bytes whose tables are sent to the executors at a time.
BLOCK_BYTES = 4_000_000

_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))
_FOLD = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class LengthClass:
    """Windows of one number of words."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list[int]]):
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for w, items in windows.items():
            for end in range(self.block, length + 1):
                key = w[end - 1] if self.block == 1 else w[end - 2:end]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.buckets[key].append((list(w), items))

    def scan(self, words: list[bytes], hit: np.ndarray, found: set[int]) -> None:
        length, jump, shift, n = self.length, self.jump, self.shift, len(words)
        at = length - 1
        single = self.block == 1
        while at < n:
            key = words[at] if single else (words[at - 1], words[at])
            step = shift.get(key, jump)
            if step:
                at += step
                continue
            seen = words[at - length + 1:at + 1]
            for window, items in self.buckets[key]:
                if window == seen:
                    hit[at - length + 1:at + 1] = True
                    found.update(items)
            at += 1


def tables(items: list[tuple[int, list[bytes]]], window: int = WINDOW) -> list[LengthClass]:
    """Search tables of (number, words) items."""
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
    for number, words in items:
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            by_length[k][tuple(words[i:i + k])].append(number)
    return [LengthClass(k, w) for k, w in by_length.items()]


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    block, size = [], 0
    for item, text in document_columns(benchmark, "item_id", "text").toLocalIterator():
        block.append((None if item is None else str(item), text))
        size += len(text or "")
        if size >= limit:
            yield block
            block, size = [], 0
    yield block


def hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """keep columns, n_words, n_hit, hit (a bit per word), items (sorted ids whose windows occur)."""
    spark = docs.sparkSession
    fields = [f.simpleString().replace(":", " ", 1) for f in docs.select(*keep).schema]
    kept = ", ".join(f"`{f.split(' ', 1)[0]}` {f.split(' ', 1)[1]}" for f in fields)
    out = document_columns(docs, *dict.fromkeys([*keep, "text"]))
    for number, block in enumerate(_blocks(benchmark, block_bytes)):
        names = [x for x, _ in block]
        shared = spark.sparkContext.broadcast((names, tables([(i, words_of(t)) for i, (_, t) in enumerate(block)], window)))
        last = "text" in keep
        schema = kept + ("" if last else ", text string") + ", n_words bigint, n_hit bigint, hit binary, items array<string>"
        out = out.mapInArrow(_pass(shared, [*keep, *([] if last else ["text"])], number > 0), schema)
    return out if "text" in keep else out.drop("text")


def _pass(shared, keep: list[str], more: bool):
    """One block's tables over the batches; later blocks add to what earlier ones found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, classes = shared.value
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            before = column(batch, "hit").to_pylist() if more else [None] * len(texts)
            listed = column(batch, "items").to_pylist() if more else [[]] * len(texts)
            counts, marked, bits, items = [], [], [], []
            for text, old, had in zip(texts, before, listed):
                words = words_of(text)
                hit, found = np.zeros(len(words), bool), set()
                if old is not None:
                    hit |= np.unpackbits(np.frombuffer(old, np.uint8), count=len(words)).astype(bool)
                for c in classes:
                    c.scan(words, hit, found)
                counts.append(len(words))
                marked.append(int(hit.sum()))
                bits.append(np.packbits(hit).tobytes())
                items.append(sorted({*had, *(names[i] for i in found if names[i] is not None)}))
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, k) for k in keep), pa.array(counts, pa.int64()), pa.array(marked, pa.int64()),
                 pa.array(bits, pa.binary()),
                 pa.array(items, pa.list_(pa.string()))],
                names=[*keep, "n_words", "n_hit", "hit", "items"])

    return run
