"""Line deduplication, the Merkle manifest and fill-in-middle against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from diurna.llm import fill_middle, line_dedup, merkle

ODD = [None, "", " ", "\n\n", "a", "É!", "  Two  spaces \n\n END ", "end", "x" * 3000, "tab\there\x0b\nand\x85there\n", "日本語\n日本語 テキスト 😀",
       "one\r\ntwo\r\n", "\n".join(["again"] * 50), "<P>marked<S>", "no end <", "P>\nM>", "$1\\n\n\\$2 {x}\n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def made(seed, n=120):
    chance = random.Random(seed)
    common = ["Share this page", "  share THIS page\t", "Cookies: accept", "", "É common", "rare"] + [f"line {i}" for i in range(400)]
    return ["\n".join(chance.choice(common[:6] if chance.random() < 0.4 else common) for _ in range(chance.randint(0, 14))) for _ in range(n)]


def table(spark, texts, ids=None):
    return spark.createDataFrame(
        [(i if ids is None else ids[i], t, [None, "en", "de", "fr"][i % 4], f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)],
        SCHEMA)


@pytest.fixture
def ranges(spark):
    """Many small ranges, so that frequent keys cross borders."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


# ---- lines ----

def plain_lines(rows, min_docs, min_chars=1, keep_first=False):
    """{(id, text): (n_lines, n_dropped, sha of the rest)} of (id, text) rows."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    where = defaultdict(list)
    keys = {}
    for d in docs:
        keys[d] = [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in d[1].split("\n")]
        for at, k in enumerate(keys[d]):
            if len(k) >= min_chars:
                where[k].append((d, at))
    gone = set()
    for places in where.values():
        if len({d for d, _ in places}) >= min_docs:
            gone.update(places[1:] if keep_first else places)
    out = {}
    for d in docs:
        lines = d[1].split("\n")
        left = [x for at, x in enumerate(lines) if (d, at) not in gone]
        out[d] = (len(lines), len(lines) - len(left), sha("\n".join(left)))
    return out


def kept_rows(docs, **how):
    out = line_dedup.cleaned(docs, line_dedup.keep_bitmaps(docs, **how)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("min_docs, min_chars, keep_first", [(10, 1, False), (2, 4, False), (3, 1, True), (1, 1, True), (1, 1, False)])
def test_lines(spark, ranges, min_docs, min_chars, keep_first):
    texts = ODD + made(1) + ["Share this page"] * 60
    ids = list(range(len(texts)))
    texts += [texts[20], "other text under one id", None, None]
    ids += [20, 21, None, 5]
    # extra columns whose names clash with the operator's own
    docs = table(spark, texts, ids).withColumns({c: F.lit("x") for c in ("t", "h1", "at", "n_lines", "keep", "kind")})
    want = plain_lines(zip(ids, texts), min_docs, min_chars, keep_first)
    got = kept_rows(docs.repartition(5), min_docs=min_docs, min_chars=min_chars, keep_first=keep_first)
    assert got == sorted(((i, *want[i, t or ""]) for i, t in zip(ids, texts)), key=str)


def test_lines_of_a_key_in_every_document(spark, ranges):
    texts = [f"own line {i}\nSubscribe now\nsubscribe NOW  " for i in range(1500)]
    docs = table(spark, texts)
    assert {r[2] for r in kept_rows(docs)} == {2}
    first = kept_rows(docs, keep_first=True)
    assert [r[0] for r in first if r[2] == 1] == [0] and sum(r[2] for r in first) == 2999


def test_one_very_long_text(spark):
    text = "\n".join(f"line {i % 5000}" for i in range(200_000))
    docs = table(spark, [text] + ["line 7"] * 9)
    got = {r[0]: r[1:3] for r in kept_rows(docs)}
    assert got[0] == (200_000, 40) and got[1] == (1, 1)


def test_bitmaps_hold_the_lines_that_stay(spark):
    docs = table(spark, ["a\nb\nc", "b", "x\nb"])
    got = {r.doc_id: line_dedup.unpack_bits(bytes(r.keep), r.n_lines).tolist() for r in line_dedup.keep_bitmaps(docs, 3).collect()}
    assert got == {0: [True, False, True], 1: [False], 2: [True, False]}


def test_nothing(spark):
    none = table(spark, ["x"]).limit(0)
    assert line_dedup.digests(none).collect() == []
    assert merkle.documents_manifest(none).collect() == []
    assert fill_middle.digests(none).collect() == []


# ---- manifest ----

def field(v):
    s = None if v is None else str(v)
    return "-" if s is None else f"{len(s.encode())}:{s}"


def plain_manifest(rows, fanout):
    """Sorted output rows of (doc_id, text, lang, source, n_chars) rows."""
    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def climb(nodes, i, h):
        """Top, the h folded up, and the siblings of the i-th node."""
        beside = ""
        while len(nodes) > 1:
            first = i - i % fanout
            run = nodes[first:first + fanout]
            beside += "".join(run[:i - first] + run[i - first + 1:])
            h = sha("".join([*run[:i - first], h, *run[i - first + 1:]]))
            nodes = [sha("".join(nodes[k:k + fanout])) for k in range(0, len(nodes), fanout)]
            i //= fanout
        return nodes[0], h, beside

    def lower(t):
        return None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)

    trees = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        trees[r[2]].append((r[0], leaf(r, r[1]), leaf(r, lower(r[1]) if hit else r[1])))
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    for own in trees.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    tops = [climb([h for _, h, _ in trees[g]], 0, "")[0] for g in names]
    out = []
    for k, g in enumerate(names):
        nodes = [h for _, h, _ in trees[g]]
        for i, (ident, h, changed) in enumerate(trees[g]):
            top, now, inner = climb(nodes, i, changed)
            root, now, outer = climb(tops, k, now)
            out.append((ident, h, top, root, sha(inner + outer), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout, depth, langs", [(8, 4, 4), (2, 1, 4), (2, 2, 1), (3, 2, 30)])
def test_manifest(spark, ranges, fanout, depth, langs):
    chance = random.Random(9)
    rows = [(i, t, f"l{i % langs}" if i % langs else None, f"s{i % 3}" if i % 7 else None, len(t or "") if i % 11 else None)
            for i, t in enumerate(ODD + made(2, 70))]
    rows += [(None, "Text", "l0", None, 4), (None, "text", "l0", None, 4), (2**60 + 1, "Big Id", "é", "s", 6), (2**60, "Big Id", "é", "s", 6),
             rows[5], rows[5], (7, "One More", rows[7][2], "s", 8)]
    chance.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("grp", "hash", "idx", "tree", "tie", "size", "leaf", "proof")})
    got = sorted(map(tuple, merkle.documents_manifest(docs.repartition(4), fanout, depth).collect()), key=str)
    # rows that are copies take each other's places
    assert got == plain_manifest(rows, fanout)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_manifest_proofs_lead_to_the_root(spark):
    docs = table(spark, made(3, 40))
    for r in merkle.manifest(docs, "lang", "doc_id", ["doc_id", "text"], fanout=3, depth=1).collect():
        assert merkle.folded(r.leaf, r.proof) == r.root == r.folded_root and r.verified
        assert merkle.siblings_digest(r.proof) == r.proof_sha256


def test_manifest_of_one_row(spark):
    (r,) = merkle.documents_manifest(table(spark, ["Only"], [1])).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("") and r.doc_id == 1


# ---- fill in the middle ----

def plain_middle(ident, text):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    d = sha(f"7:{'' if ident is None else ident}")
    h = [int(d[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")):
        return (ident, n, "plain", None, None, sha(t), sha(t))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 50
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return (ident, n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(t))


def test_middle(spark):
    chance = random.Random(4)
    parts = ["line\n", "\n", "word ", "😀", "<", "P>", "<S", "$1", "\\", "é\n", "\r\n", " ", "{2}+"]
    texts = ODD + made(5, 60) + ["".join(chance.choice(parts) for _ in range(chance.randint(0, 20))) for _ in range(200)]
    ids = [*range(len(texts)), None, 3, 3]
    texts += ["no id\nat all\n", texts[3], "again\nanother"]
    docs = table(spark, texts, ids).withColumns({c: F.lit("x") for c in ("n", "form", "output", "_text", "_a", "_b")})
    got = sorted(map(tuple, fill_middle.digests(docs).collect()), key=str)
    assert got == sorted((plain_middle(i, t) for i, t in zip(ids, texts)), key=str)


def test_middle_of_very_many_lines(spark):
    texts = ["".join(f"line {i}\n" for i in range(100_000)), "\n" * 50_000, "x" * 1_000_000, "y " * 300_000 + "\nend"]
    got = sorted(map(tuple, fill_middle.digests(table(spark, texts, [11, 12, 13, 14])).collect()))
    assert got == [plain_middle(i, t) for i, t in zip([11, 12, 13, 14], texts)]


def test_middle_shares(spark):
    docs = table(spark, [f"a{i}\nb\nc\n" for i in range(400)])
    forms = [r.form for r in fill_middle.transformed(docs, percent=50, spm_percent=0).collect()]
    assert set(forms) == {"plain", "psm"} and 140 < forms.count("plain") < 260
    back = fill_middle.transformed(docs).select("text", fill_middle.restored().alias("again")).collect()
    assert all(r.text == r.again for r in back)
