"""Ids of whole texts as the tokenizers library gives them, each distinct chunk encoded once a worker.

A text is cut only where the library's own split always falls, so joining the chunks' ids
equals encoding the whole text. A text whose cut is not certain goes to the library whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks that a worker remembers, half of them in a table of older ones.
REMEMBERED = 1_200_000


#: A word that the split of a byte-level vocabulary leaves whole: letters of Latin scripts, after a space or a line's start.
_LETTERS = re.compile("[ \n]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: Byte-level vocabularies write each byte as a character: itself if it prints, else one from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARACTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Table(dict):
    """chunk -> little-endian unsigned 32-bit ids, or False for a chunk that cannot stand alone."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, chunk):
        if len(self) >= self.most:
            self.clear()
        value = self[chunk] = self.make(chunk)
        return value


class Encoder:
    """spaced: the vocabulary marks a word by the space before it; else white space is dropped."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.lib = Tokenizer.from_file(path)
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.spaced = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") \
            and not spec.get("normalizer")
        dropped = '"behavior": "Removed", "invert": true' in json.dumps(pre) and \
            {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}
        self.special = [a["content"] for a in spec.get("added_tokens", [])]
        self.lowers = "Lowercase" in {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])} \
            and not any(a != a.lower() for a in self.special)
        self.whole_only = not (self.spaced or dropped) or any(re.search(r"\s", a) for a in self.special)
        self.by_model = self.spaced and not any(_LETTERS.fullmatch(a) for a in self.special)
        self.pieces = self.lib.model.tokenize
        self.heads = _Table(self._ids, remembered)
        self.table = _Table(self._after_space if self.spaced else self._word, remembered)
        self.tails = _Table(self._ids, remembered)
        self.old: dict = {}
        self.separator = "\n" if self.spaced else "|"
        self.separator_id = self.lib.encode(self.separator, add_special_tokens=False).ids[0]
        self.line_end = _packed([self.separator_id])
        self.cut = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
        self.odd = re.compile(r"[^\S \n]|[\x1c-\x1f]")
        self.chunks = _Table(self._safe, remembered)

    def whole(self, text: str) -> bytes:
        return _packed(self.lib.encode(text, add_special_tokens=False).ids)

    def _ids(self, chunk: str) -> bytes:
        """Ids of a chunk that stands alone; a word that is one piece goes to the library's model past its split."""
        if not (self.by_model and _LETTERS.fullmatch(chunk)):
            return self.whole(chunk)
        if chunk[0] == "\n":
            return self.line_end + self._ids(chunk[1:])
        shown = chunk.replace(" ", _CHARACTERS[32]) if chunk.isascii() else chunk.encode().decode("latin-1").translate(_CHARACTERS)
        return _packed([t.id for t in self.pieces(shown)])

    def _odd(self, text: str) -> bool:
        return bool(self.odd.search(text)) or any(a in text for a in self.special)

    def _safe(self, chunk: str):
        return False if self._odd(chunk) else self._ids(chunk)

    def _apart(self, part: str) -> bool:
        """Does it end in a full stop or comma after a letter, which is then a piece of its own?"""
        return len(part) > 1 and part[-1] in ".," and part[-2].isalpha() and part[-2] < "\u0250"

    def _word(self, part: str) -> bytes:
        return self.table[part[:-1]] + self.tails[part[-1]] if self._apart(part) else self.whole(part) if part else b""

    def _after_space(self, part: str):
        if part == "" or part == "\n":  # a run of white space: its split depends on what follows
            return False
        if self._apart(part):
            before = self.table[part[:-1]]
            return before and before + self.tails[part[-1]]
        return self._safe(part if part[0] == "\n" else " " + part)

    def _lower(self, text: str) -> str:
        """A-Z lower-cased beforehand where the library does so anyway: fewer distinct words."""
        return text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass") if self.lowers else text

    def _prepared(self, text: str) -> str:
        """Its parts between spaces are what the table is asked for; of a spaced vocabulary the first stands apart."""
        return text.replace("\n", " \n") if self.spaced else self._lower(text).replace("\n", " ")

    def _head(self, part: str):
        return b"" if part == "" else False if self._odd(part) else self.heads[part]

    def _learn(self, parts: set[str]) -> None:
        """Fill the table for new parts: plain words one by one, others as one text, told apart by a separator.

        The separator is a piece of its own wherever it stands, and parts that hold it, or a
        special string or odd white space, are encoded alone.
        """
        table, old = self.table, self.old
        for p in parts & old.keys() if len(old) < len(parts) else [p for p in parts if p in old]:
            table[p] = old[p]
        cores = {p[:-1] if self._apart(p) else p for p in parts if p not in table}
        cores = [c for c in cores if c and c not in table]
        if self.by_model:
            others = []
            for c in cores:
                chunk = c if c[0] == "\n" else " " + c
                if _LETTERS.fullmatch(chunk):
                    table[c] = self._ids(chunk)
                else:
                    others.append(c)
            cores = others
        plain = [c for c in cores if self.separator not in c]
        if self._odd(" ".join(plain)):
            plain = [c for c in plain if not self._odd(c)]
        between = f"{self.separator} " if self.spaced else f" {self.separator} "
        for at in range(0, len(plain), 20_000):
            some = plain[at:at + 20_000]
            ids = np.array(self.lib.encode_batch_fast([" " + between.join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.separator_id), len(ids))
            if len(ends) != len(some):
                continue  # then each is encoded when it is asked for
            raw, start = ids.tobytes(), 0
            for core, end in zip(some, (4 * ends).tolist()):
                table[core] = raw[start:end]
                start = end + 4

    def _by_chunks(self, text: str) -> bytes:
        """A text with a part that cannot stand alone."""
        try:
            return b"".join(map(self.chunks.__getitem__, self.cut.findall(text)))
        except TypeError:
            return self.whole(text)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        if not text:
            return b""
        return next(self._group([text]))

    def encode_many(self, texts: Iterable[str], characters: int = 4_000_000) -> Iterator[bytes]:
        """encode() of each; each distinct word of a group of texts is looked up once."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= characters:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        if self.whole_only:
            yield from (self.whole(t) if t else b"" for t in texts)
            return
        if len(self.table) >= self.remembered // 2:  # words asked for again move on to the new table
            self.old, self.table = self.table, _Table(self.table.make, self.remembered)
        lists = pc.split_pattern(pa.array(map(self._prepared, texts), pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        parts, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        bounds = lists.offsets.to_numpy()
        found = list(map(self.table.get, parts))
        gap = [i for i, x in enumerate(found) if x is None] if None in found else ()
        self._learn({parts[i] for i in gap})
        for i in gap:
            found[i] = self.table[parts[i]]
        if self.spaced:  # the first part of a text has no space before it
            firsts = index[bounds[:-1]].tolist()
            index[bounds[:-1]] = np.arange(len(found), len(found) + len(firsts))
            found += [self._head(parts[i]) for i in firsts]
        odd = np.zeros(len(texts), bool)
        try:
            joined = b"".join(found)
        except TypeError:  # a part that cannot stand alone
            odd = np.logical_or.reduceat(np.array([x is False for x in found])[index], bounds[:-1])
            found = [x or b"" for x in found]
            joined = b"".join(found)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, taken = np.cumsum(sizes) - sizes, sizes[index]
        ends = np.cumsum(taken)
        ids = np.frombuffer(joined, "<u4")[np.arange(ends[-1]) + np.repeat(starts[index] - (ends - taken), taken)]
        at = 0
        for text, apart, end in zip(texts, odd.tolist(), ends[bounds[1:] - 1].tolist()):
            yield self._by_chunks(text) if apart else ids[at:end].tobytes()
            at = end


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder a worker process, vocabulary and number of words to remember."""
    if (path, remembered) not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path, remembered] = Encoder(path, remembered)
    return _ENCODERS[path, remembered]
