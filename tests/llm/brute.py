"""Plain versions of the text operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(rows, k, percent):
    """{doc_id: (n_shingles, component)} of (doc_id, text) rows with distinct ids."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^ \t-\r]+", lower(t))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeated_bytes(texts, length):
    """For each text its bytes and a mark for each byte that a repeated string covers."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k:k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                mark[k:k + length] = b"\1" * length
        out.append((b, mark))
    return out


def dedup_row(b, mark):
    spans = sum(1 for k in range(len(b)) if mark[k] and (k == 0 or not mark[k - 1]))
    return len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest()


def cut(b, mark):
    """Characters that are not wholly repeated."""
    out, at = "", 0
    for c in b.decode():
        n = len(c.encode())
        if not all(mark[at:at + n]):
            out += c
        at += n
    return out


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def decontaminated(texts, items, window=10):
    """(n_words, n_hit, n_items, sha, contaminated) of each text; items: (id, text)."""
    pieces = {}
    for i, t in items:
        w = item_words(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            pieces.setdefault(tuple(w[j:j + k]), set()).add(i)
    out = []
    for t in texts:
        w, hit, ids = item_words(t), set(), set()
        for p, own in pieces.items():
            for j in range(len(w) - len(p) + 1):
                if tuple(w[j:j + len(p)]) == p:
                    hit.update(range(j, j + len(p)))
                    ids |= own
        named = sorted(str(i) for i in ids if i is not None)
        out.append((len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return out


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text or ""
    w = re.findall(r"[^ \t-\r]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
    seen = Counter(tuple(w[j:j + 3]) for j in range(len(w) - 2))
    repeat = {j + d for j in range(len(w) - 2) if seen[tuple(w[j:j + 3])] > 1 for d in range(3)}
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat),
            n < 50 or 100 * len(repeat) > 50 * n)


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def windows_of(totals, weights, window):
    """{(source, token): window} by serving whole tokens as credit falls due."""
    order = sorted((Fraction(j + 1, weights[s]), s, j) for s in totals for j in range(totals[s]))
    return {(s, j): r // window for r, (_, s, j) in enumerate(order)}


def url_scores(train, asked, order=4, alphabet=256):
    """Mean log ratio of the two interpolated models for each asked string; train: (string, verdict)."""
    from math import log

    counts = {v: Counter() for v in ("allow", "block")}
    for s, v in train:
        p = "\x02" * order + s + "\x03"
        for i in range(len(s) + 1):
            for k in range(order + 1):
                counts[v][p[i + order - k:i + order + 1]] += 1
    after = {v: {} for v in counts}
    for v, own in counts.items():
        for g, n in own.items():
            t = after[v].setdefault((len(g), g[:-1]), [0, 0])
            t[0] += n
            t[1] += 1

    def chance(v, g):
        shorter = chance(v, g[1:]) if len(g) > 1 else 1 / alphabet
        total, kinds = after[v].get((len(g), g[:-1]), (0, 0))
        return (counts[v][g] + (kinds + 1) * shorter) / (total + kinds + 1)

    out = {}
    for s in asked:
        p = "\x02" * order + s + "\x03"
        grams = [p[i:i + order + 1] for i in range(len(s) + 1)]
        out[s] = sum(log(chance("allow", g)) - log(chance("block", g)) for g in grams) / len(grams)
    return out
