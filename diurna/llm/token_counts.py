"""Exact token counts at every prefix of a text, by dynamic programming.

For byte-pair encoding the last token at each prefix is unique: among the tokens that end
there it is the one whose joint with the last token before it is itself a valid encoding of
their bytes. So one pass over a word's bytes gives last token and count at every prefix. The
counts of a text are stored as one signed byte per character, the step from the prefix before
it; a running sum gives the count at any prefix, and truncation to a budget is a search in it.

Words are solved once a worker; a text's steps are its words' steps joined together.

Defined results: a null or empty text has no prefixes and no tokens. Special strings inside a
text count as the library's default has them: one token from their last character on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from diurna.llm.common import column
from diurna.llm.encoding import _Table

#: Fixed value: the split pattern of byte-level vocabularies, white space as Unicode has it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""" \
    .replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 as it is, others from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Counter:
    """Steps of the exact token count along a text."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("prefix counts need a byte-level vocabulary without normalizer")
        letters = byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        model = spec["model"]
        self.special = [a["content"] for a in spec.get("added_tokens", [])]
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        # rank of a merge by its pair; the pair that makes a token
        self.ranks: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.ranks[self.ids[a], self.ids[b]] = rank
            self.parts.setdefault(self.ids[a + b], (self.ids[a], self.ids[b]))
        self.left, self.right = _Table(self._left), _Table(self._right)
        self.fits = _Table(lambda pair: self._stands(*pair) and pair not in self.ranks)
        self.root: tuple[dict, int | None] = ({}, None)
        for token, i in self.ids.items():
            if self._own(i):
                node = self.root[0]
                for byte in token[:-1]:
                    node = node.setdefault(byte, ({}, None))[0]
                node[token[-1]] = (node.get(token[-1], ({}, None))[0], i)
        self.pieces = regex.compile(PATTERN)
        self.table = _Table(self._after_space)
        self.units = _Table(self.unit)
        # a run of white space belongs to what follows it, as its split depends on that
        self.cut = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+")
        self.lead = regex.compile(r"\p{White_Space}+(?=\P{White_Space})")
        # a run that mixes such white space with spaces is one piece, so it must not be cut at its spaces
        self.odd = regex.compile(r"[^\P{White_Space} \n]")

    def _left(self, token: int) -> list[tuple[int, float]]:
        """Nodes on the left edge of a token's merge tree, each with the rank at which it is merged further."""
        if token not in self.parts:
            return [(token, float("inf"))]
        first, second = self.parts[token]
        return [*self.left[first][:-1], (first, self.ranks[first, second]), (token, float("inf"))]

    def _right(self, token: int) -> list[tuple[int, float]]:
        if token not in self.parts:
            return [(token, float("inf"))]
        first, second = self.parts[token]
        return [*self.right[second][:-1], (second, self.ranks[first, second]), (token, float("inf"))]

    def _stands(self, a: int, b: int) -> bool:
        """While the merges build a and b side by side, does none of them cross the joint?

        Merges go by rank, leftmost first; so a crossing merge must come before the next one
        inside a, and not after the next one inside b.
        """
        edge, other = self.right[a], self.left[b]
        i = j = 0
        while i < len(edge) - 1 or j < len(other) - 1:
            (x, up), (y, on) = edge[i], other[j]
            across = self.ranks.get((x, y))
            if across is not None and across < up and across <= on:
                return False
            if up <= on:
                i += 1
            else:
                j += 1
        return True

    def _own(self, token: int) -> bool:
        """Do the merges make this token of its own bytes?"""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return self._own(a) and self._own(b) and self._stands(a, b)

    def counts(self, piece: bytes) -> list[int]:
        """Token count at each byte prefix of one piece of the split."""
        size, fits = len(piece), self.fits
        last: list[int | None] = [None] * (size + 1)
        count = [0] * (size + 1)
        for start in range(size):
            before, more, node = last[start], count[start] + 1, self.root
            for end in range(start + 1, size + 1):
                node = node[0].get(piece[end - 1])
                if node is None:
                    break
                token = node[1]
                if token is not None and last[end] is None and (start == 0 or fits[before, token]):
                    last[end], count[end] = token, more
        return count

    def unit(self, text: str) -> bytes:
        """Steps per character of a run of white space and what follows up to the next one."""
        base, counts = 0, []
        run = self.lead.match(text)
        if run and run.end() > 1:  # while the text ends inside the run, the run is one piece
            counts = self._at_characters(run.group(), self.counts(run.group().encode()))
        done = 0
        for piece in self.pieces.findall(text):
            own = self._at_characters(piece, self.counts(piece.encode("utf-8", "surrogatepass")))
            if len(piece) > 1 and piece[0] == "'" and piece[1].isalpha():  # a contraction cut short is two pieces
                own = [1, *[1 + c for c in self._at_characters(piece[1:-1], self.counts(piece[1:-1].encode()))], own[-1]]
            skip = max(0, len(counts) - done)
            counts += [base + c for c in own[skip:]] if base else own[skip:]
            done += len(piece)
            base += own[-1]
        return bytes([(c - b) & 255 for b, c in zip([0, *counts], counts)])

    @staticmethod
    def _at_characters(text: str, at_bytes: list[int]) -> list[int]:
        if text.isascii():
            return at_bytes[1:]
        out, at = [], 0
        for c in text:
            at += len(c.encode("utf-8", "surrogatepass"))
            out.append(at_bytes[at])
        return out

    def _after_space(self, part: str):
        if part in ("", "\n"):
            return None
        if part[-1] in ".," and "\n" not in part and len(part) > 1 and part[-2].isalpha():
            return self.table[part[:-1]] + b"\1"  # a full stop or comma after letters is a piece of its own
        return self.unit(part if part[0] == "\n" else " " + part)

    def _plain(self, text: str) -> bytes:
        """Steps of a text in which no special string is looked for."""
        if text and not self.odd.search(text):
            try:
                first, *rest = text.replace("\n", " \n").split(" ")
                return (self.units[first] if first else b"") + b"".join(map(self.table.__getitem__, rest))
            except TypeError:  # runs of white space
                pass
        return b"".join(map(self.units.__getitem__, self.cut.findall(text)))

    def steps(self, text: str) -> bytes:
        out, before = b"", ""
        while True:
            at, word = min(((text.find(w), w) for w in self.special if w in text), default=(-1, ""))
            if at < 0:
                return out + self._plain(text)
            # up to its last character the special string is ordinary text
            piece = text[:at + len(word)]
            own = np.frombuffer(self._plain(piece), np.int8).astype(int)
            own[-1] = own[:at].sum() + 1 - own[:-1].sum()
            out, text = out + own.astype(np.int8).tobytes(), text[len(piece):]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def prefix_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_tokens, steps (one signed byte per character)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(vocabulary)
        for batch in batches:
            sizes, totals, steps = [], [], []
            for text in column(batch, "text"):
                text = text.as_py() or ""
                own = tool.steps(text)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                totals.append(int(np.frombuffer(own, np.int8).sum(dtype=np.int64)))
                steps.append(own)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(steps, pa.binary())],
                names=["doc_id", "n_bytes", "n_tokens", "steps"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, steps binary")


def count_at(steps: bytes, characters: int) -> int:
    """Tokens of the prefix of that many characters."""
    return int(np.frombuffer(steps, np.int8)[:characters].sum(dtype=np.int64))


def longest_prefix(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most `budget` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0
