"""Each text operator against its plain version, with the odd rows of every contract."""

import math
import random
import re

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from diurna.llm import (
    connected, decontaminate, encoding, jaccard_join, knn_quality, license_scan, packing, quality_rules, queries,
    suffix_dedup, token_counts, token_store, url_model,
)

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "a", "É!", "one two", "  two  spaces \n\n end ", "x" * 3000, "tab\there\x0b and\x85there",
       "it's we'll 'quoted' 'r", "<|endoftext|> inside <|endoftext|>", "日本語 テキスト 😀", "a\x1cb \x1c", "the " * 400]


def made(seed, n=60):
    chance = random.Random(seed)
    words = ["the", "of", "Alpha", "beta,", "gamma.", "délta", "99", "$$", "x|y", "eta", "theta", "iota!!"]
    texts = []
    for _ in range(n):
        texts.append("".join(chance.choice(words) + chance.choice([" ", " ", " ", "\n", "  "]) for _ in range(chance.randint(0, 120))))
    return texts + [texts[3], texts[3], texts[5]]


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def texts():
    return ODD + made(1)


@pytest.fixture(scope="module")
def docs(spark, texts):
    # extra columns whose names clash with the operators' own
    return table(spark, texts).withColumns({c: F.lit("x") for c in ("n", "id", "t", "n_words", "hit", "_words", "rep", "score")}).repartition(4).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, ["x"]).limit(0)


def test_quality_measures(docs, texts):
    got = {r.doc_id: tuple(r)[1:] for r in quality_rules.judged(docs.drop("n_words")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: brute.measures(t) for i, t in enumerate(texts)}


def test_quality_rules_keep_clean_and_reject_junk(spark):
    clean = " ".join(f"The cat{i} sat on mat{i} of the house{i} and looked at bird{i}." for i in range(6))
    junk = ["WORD!! THING!! OTHER!! " * 30, "a | b | c | d | e | " * 20, "same line here\n" * 40, "few words"]
    kept = {r.doc_id: r.kept for r in quality_rules.judged(table(spark, [clean, *junk])).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False, 4: False}


def test_decontamination(spark, docs, texts):
    benchmark = [(1, " ".join(texts[20].split()[:14])), (2, "one two"), (2, "a"), (10, "The of"), (None, "delta 99"), (4, ""), (5, None),
                 (6, " ".join(texts[30].split()[3:25])), (7, "no such words in any of the texts at all really none")]
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    for block in (10**6, 40):
        got = {r.doc_id: r for r in decontaminate.hits(docs, items, ["doc_id"], block_bytes=block).collect()}
        want = brute.decontaminated(texts, benchmark)
        for i, w in enumerate(want):
            r = got[i]
            assert (r.n_words, r.n_hit, len(r["items"])) == w[:3]
            assert sum(bin(b).count("1") for b in r.hit) == w[1]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoding_equals_the_library(path, texts):
    lib = encoding.Encoder(path)
    chance = random.Random(2)
    parts = [" ", "  ", "\n", "\n\n", "a", "foo.", "É,", "'s", "'", "!", "12", "日", "\t", "<|endoftext|>", "\x1c", "ΑΣ ", "é", "\u0301", "<|"]
    more = ["".join(chance.choice(parts) for _ in range(chance.randint(0, 12))) for _ in range(400)]
    for t, ids in zip([*texts, *more], lib.encode_many([t or "" for t in [*texts, *more]])):
        assert ids == (lib.whole(t) if t else b"")


def test_words_of_letters_need_no_call_of_the_whole_library():
    lib, chance = encoding.Encoder(BYTE), random.Random(5)
    letters = [chr(c) for c in range(65, 0x250) if encoding._LETTERS.fullmatch(chr(c))]
    words = [*letters, *("".join(chance.choices(letters, k=chance.randint(2, 12))) for _ in range(500))]
    texts = [f"{w} {w}{w}, x\n{w}{chance.choice(words)}. {w}" for w in words]
    want, calls, whole = [lib.whole(t) for t in texts], [], lib.whole
    lib.whole = lambda text: calls.append(text) or whole(text)
    assert list(lib.encode_many(texts)) == want
    assert set(calls) <= {",", "."}


def test_a_group_of_texts_looks_each_word_up_once():
    lib, asked = encoding.Encoder(BYTE), []

    class Asked(encoding._Table):
        def get(self, key):
            asked.append(key)
            return super().get(key)

    lib.table = Asked(lib.table.make)
    texts = ["the cat sat, the cat ran", "a  cat\n\nsat", "", "the cat"] * 20
    assert list(lib.encode_many(texts)) == [lib.whole(t) if t else b"" for t in texts]
    assert len(asked) == len(set(asked))


def test_prefix_counts_are_exact(texts):
    lib, tool = encoding.Encoder(BYTE), token_counts.Counter(BYTE)
    chance = random.Random(3)
    parts = [" ", "   ", "\n", "a", "foo.", "'s", "'re", "'", "!", "12", "日", "\t", "<|endoftext|>", "<|end", "aaaa"]
    more = ["".join(chance.choice(parts) for _ in range(chance.randint(0, 10))) for _ in range(200)]
    for t in [*(x for x in texts if x and len(x) < 400), *more]:
        steps = tool.steps(t)
        want = [len(lib.lib.encode(t[:i + 1], add_special_tokens=False).ids) for i in range(len(t))]
        assert np.cumsum(np.frombuffer(steps, np.int8), dtype=int).tolist() == want
        if want:
            assert token_counts.count_at(steps, len(t)) == want[-1]
            assert token_counts.longest_prefix(steps, 3) == max((i + 1 for i, n in enumerate(want) if n <= 3), default=0)


def test_prefix_counts_of_mixed_white_space():
    lib, tool = encoding.Encoder(BYTE), token_counts.Counter(BYTE)
    chance = random.Random(8)
    parts = [" ", " ", "\xa0", "\xa0 ", " \xa0", "\t", "\r\n", "\n", "\u3000", "\u2028", "a", "foo.", "12"]
    more = ["".join(chance.choice(parts) for _ in range(chance.randint(2, 14))) for _ in range(200)]
    for t in ["word \xa0 \xa0 word", "Price: \xa0 \xa0 \xa0 10", *more]:
        want = [len(lib.lib.encode(t[:i + 1], add_special_tokens=False).ids) for i in range(len(t))]
        assert np.cumsum(np.frombuffer(tool.steps(t), np.int8), dtype=int).tolist() == want


def test_levels_give_any_token():
    ids = np.random.default_rng(1).integers(0, 70000, 4000).astype(np.uint32)
    ids[::3] = 7
    levels = token_store.Levels(token_store.encode_levels(ids))
    assert [levels.token(i) for i in range(0, 4000, 7)] == ids[::7].tolist()
    for a, b in ((0, 4000), (0, 0), (5, 6), (511, 1025), (3999, 4000)):
        assert (levels.tokens(a, b) == ids[a:b]).all()
    assert len(token_store.Levels(token_store.encode_levels(ids[:0]))) == 0


def test_token_store(docs, texts):
    lib, start, want = encoding.Encoder(BYTE), 0, []
    for i, t in enumerate(texts):
        ids = [*(lib.lib.encode(t, add_special_tokens=False).ids if t else []), 0]
        want.append((i, start, len(ids), brute.crc(ids)))
        start += len(ids)
    shards = token_store.write(docs, BYTE, shard_tokens=500)
    assert sorted(map(tuple, token_store.read(shards, token_store.checksum, "ids_crc32 bigint").collect())) == want


def test_token_store_of_nothing(nothing):
    assert token_store.read(token_store.write(nothing, BYTE), token_store.checksum, "ids_crc32 bigint").collect() == []


def test_schedule_serves_by_credit():
    chance = random.Random(5)
    for turn in range(60):
        totals = {f"s{i}": chance.randint(0, 50) for i in range(chance.randint(1, 6))}
        weights = {s: chance.randint(1, 9) for s in totals} if turn % 2 else {s: n for s, n in totals.items() if n}
        if not sum(totals.values()):
            continue
        totals = {s: n for s, n in totals.items() if n}
        window = chance.choice([1, 4, 16])
        plan, want, got = packing.Schedule(totals, weights, window), brute.windows_of(totals, weights, window), {}
        for s, n in totals.items():
            for first, length, w, _ in plan.pieces(s, 0, n):
                got |= {(s, first + j): w for j in range(length)}
        assert got == want
        for w in range(plan.windows + 1):  # what a queue is short of its credit is under one token a queue
            assert sum(plan.served(w)) == min(w * window, plan.all)


def test_packing(docs, texts):
    lib = encoding.Encoder(WORD)
    window = 64
    rows = packing.pack(docs, WORD, window=window).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*(lib.lib.encode(t, add_special_tokens=False).ids if t else []), 1]
        own = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == np.array(ids, "<u4").tobytes()
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert {r.doc_tokens for r in own} == {len(ids)}
    for seq, own in by_seq.items():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        if seq < max(by_seq):
            assert sum(r.length for r in own) == window
    whole = {r.sequence_id: r.ids for r in packing.sequences(packing.pack(docs, WORD, window=window)).collect()}
    assert all(len(whole[s]) == 4 * sum(r.length for r in own) for s, own in by_seq.items())
    # every full window has the mixture of the corpus, but for less than a token a queue
    totals = {}
    for i in range(len(texts)):
        source = "" if i % 7 == 0 else f"s{i % 3}"
        totals[source] = totals.get(source, 0) + sum(r.length for r in by_doc[i])
    plan = packing.Schedule(totals, None, window)
    for w in range(plan.windows):
        for n, share in zip(plan.served(w), plan.totals):
            assert abs(n - w * window * share / plan.all) <= len(totals)


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, WORD).collect() == []


def near_copies(seed):
    chance = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base, shared = [chance.choice(words) for _ in range(90)], [chance.choice(words) for _ in range(40)]
    rows = []
    for _ in range(70):
        own = list(base)
        for _ in range(chance.randint(0, 4)):
            own[chance.randrange(90)] = chance.choice(words)
        rows.append(" ".join(own))
    for _ in range(60):
        rows.append(" ".join([chance.choice(words) for _ in range(chance.randint(3, 70))] + shared))
    rows += [" ".join(chance.choice(["A", "b", "c"]) for _ in range(chance.randint(0, 6))) for _ in range(30)]
    return rows


@pytest.mark.parametrize("long, sent", [(6, 500_000), (6, 0), (100, 500_000)])
def test_jaccard_components(spark, monkeypatch, long, sent):
    monkeypatch.setattr(jaccard_join, "LONG", long)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", sent)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    texts = near_copies(4) + ODD + made(2, 20)
    docs = table(spark, texts).withColumns({c: F.lit("x") for c in ("n", "rep", "t", "class")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(docs).collect()}
    assert got == brute.components(enumerate(texts), 4, 85)


def test_jaccard_merge_drops_what_occurs_too_seldom(spark, monkeypatch):
    tried = []
    possible = jaccard_join._possible
    monkeypatch.setattr(jaccard_join, "_possible", lambda pairs, *rest: tried.append(sorted(map(tuple, pairs.collect()))) or possible(pairs, *rest))
    shared = "a notice that many texts hold word for word"
    texts = [" ".join([shared, *(f"t{i}w{k}" for k in range(20 + i % 3))]) for i in range(12)]
    texts += [f"{texts[0]} end", " ".join(f"z{k}" for k in range(200)), " ".join(f"z{k}" for k in range(120))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(table(spark, texts)).collect()}
    assert got == brute.components(enumerate(texts), 4, 85)
    assert tried == [[(12, 0)]]


def test_jaccard_rows_without_id_and_repeated_ids(spark, nothing):
    texts, ids = ["one two three four five", "one two three four five", "six seven eight nine ten", "other"], [None, 5, 5, 6]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.components(table(spark, texts, ids)).collect()), key=str)
    assert got == [(5, 5), (5, 5), (6, 6), (None, None)]
    assert jaccard_join.components(nothing).collect() == []


def test_jaccard_documents_with_several_texts(spark, folder):
    import duckdb

    from diurna.llm.sql import OP8

    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    more = f"{a} more"
    texts, ids = [a, a, b, b, f"{a} {b}", a, more, "", b, b], [5, 7, 7, 9, 8, 11, 11, 12, 12, 12]
    docs = table(spark, texts, ids)
    got = sorted(tuple(r) for r in jaccard_join.components(docs).collect())
    con = duckdb.connect()
    docs.coalesce(1).write.parquet(f"{folder}/documents")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents/*.parquet'")
    assert got == sorted(con.execute(OP8).fetchall())
    assert {i: c for i, _, c in got} == {5: 5, 7: 7, 8: 7, 9: 9, 11: 5, 12: 9}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "u long, v long")
    assert dict(map(tuple, connected.roots(links).collect())) == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100}


def test_components_of_stars_take_no_round(spark, monkeypatch):
    written = []
    staged = connected.staged
    monkeypatch.setattr(connected, "staged", lambda df, name: written.append(name) or staged(df, name))
    links = spark.createDataFrame([(1, 0), (2, 0), (0, 3), (11, 10), (10, 11), (12, 12)], "u long, v long")
    assert dict(map(tuple, connected.roots(links).collect())) == {1: 0, 2: 0, 3: 0, 11: 10}
    assert len(written) == 1


@pytest.mark.parametrize("sent", [1 << 16, 0])
def test_jaccard_blocks_of_few_members_are_sent(spark, monkeypatch, sent):
    monkeypatch.setattr(jaccard_join, "MINOR_ROWS", sent)
    monkeypatch.setattr(jaccard_join, "LONG", 6)
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    rows = [(t, rep, 9, rep % 3, bytes(32), 0, 4, 6) for t in (1, 2) for rep in range(6)]
    members = spark.createDataFrame(rows, "t long, rep long, n long, comp long, sketch binary, main long, m1 long, m2 long")
    blocks = jaccard_join._blocks(members)
    assert ("BroadcastHashJoin" in blocks._jdf.queryExecution().executedPlan().toString()) == bool(sent)
    got = {(x.rep, y.rep) for r in blocks.collect() for x in r.minor for y in r.members}
    assert got == {(a, b) for a in (1, 2, 4, 5) for b in range(6)}
    texts = near_copies(9) + made(3, 10)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(table(spark, texts)).collect()}
    assert got == brute.components(enumerate(texts), 4, 85)


@pytest.mark.parametrize("length", [24, 100])
def test_repeated_bytes(spark, length):
    chance = random.Random(6)
    words = ["".join(chance.choice("abcdeé ") for _ in range(chance.randint(1, 9))) for _ in range(50)]
    passages = ["".join(chance.choice(words) for _ in range(chance.randint(3, 40))) for _ in range(8)]
    texts = list(ODD)
    for _ in range(120):
        texts.append("".join(
            chance.choice(passages) if r < 0.4 else chance.choice(["a", "xyz "]) * chance.randint(1, 60) if r < 0.5
            else "".join(chance.choice(words) for _ in range(chance.randint(0, 25)))
            for r in (chance.random() for _ in range(chance.randint(0, 5)))))
    texts += [texts[40], texts[40], texts[50]]
    docs = table(spark, texts).withColumns({c: F.lit("x") for c in ("n", "id", "sha", "names", "_n")})
    marks = brute.repeated_bytes(texts, length)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(docs, length).collect()}
    assert got == {i: brute.dedup_row(*m) for i, m in enumerate(marks)}
    left = {r.doc_id: r.text for r in suffix_dedup.cut(docs, length).collect()}
    assert {i: t or "" for i, t in left.items()} == {i: brute.cut(*m) for i, m in enumerate(marks)}


def test_repeated_bytes_of_nothing(nothing):
    assert suffix_dedup.digests(nothing).collect() == []


def test_quality_neighbours_hold_out(spark, sample):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in queries.op2_quality_neighbours(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    held = [(r.quality, rows[r.doc_id]) for r in labels.collect() if rows[r.doc_id].held_out]
    right = {q: [x.predicted == q for y, x in held if y == q] for q in (0, 1)}
    assert min(sum(v) / len(v) for v in right.values()) > 0.9


def test_quality_scores_are_exact_cosines(docs, texts):
    rows = np.array([knn_quality.terms(t) for t in texts])
    labels = np.arange(len(texts)) % 2
    model = knn_quality.fit(rows, labels.astype(float), np.ones(len(texts)), 0.5)
    got = {r.doc_id: r.score for r in knn_quality.scored(docs.drop("score"), model).collect()}
    for i, row in enumerate(rows):
        z = (row * model.weights) @ model.directions
        sims = [float(v @ z) / max(1e-12, float(np.linalg.norm(z))) for v in model.vectors]
        top = np.argsort(sims)[::-1][:knn_quality.NEIGHBOURS]
        votes = [max(0.0, sims[j]) ** knn_quality.POWER for j in top]
        want = sum(v * labels[j] for v, j in zip(votes, top)) / sum(votes) if sum(votes) > 1e-9 else 0.5
        if len(set(np.round(sims, 5))) == len(sims):  # no ties at the border
            assert math.isclose(got[i], want, abs_tol=1e-3)


def test_quality_without_labels(spark, docs, texts):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = knn_quality.fit(*knn_quality.sampled(docs, none))
    assert {r.score for r in knn_quality.scored(docs.drop("score"), model).collect()} == {0.5}


URLS = [None, "", "no scheme.com/x", "http://", "HTTP://WWW.Example.COM/en/1?q#f", "https://example.com/en/x", "https://a.example.com/fr/",
        "http://com", "http://com/", "http://x.net/es/1", "http://x.net/en/1", "http://fox.org", "http://Ä.net/fr/", "ftp://a://b/c", "http://a.net/ES/"]


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r.page_id: r for r in url_model.judged(pages).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = brute.lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        best = max((r for r in url_model.RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0]))
                    and path.startswith(r[0][r[0].index("/"):])), key=lambda r: len(r[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[0])
        assert got[i].verdict in ("allow", "block") and (best[1] is None or got[i].verdict == best[1])


def test_url_scores(spark):
    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet").limit(10**9)
    rows = url_model.judged(pages).collect()
    import zlib

    seen = [(r.host + r.path, r.verdict) for r in rows if r.rule and zlib.crc32((r.host + r.path).encode()) % 5]
    asked = {r.host + r.path for r in rows if not r.rule}
    want = brute.url_scores(seen, asked)
    for r in rows:
        if not r.rule:
            assert math.isclose(r.score, want[r.host + r.path], abs_tol=1e-9)
    cut = {v: [r.score for r in rows if not r.rule and r.verdict == v] for v in ("allow", "block")}
    assert max(cut["block"], default=-9) < min(cut["allow"], default=9)


def test_licence_families(spark, docs, texts):
    model = license_scan.fit([t.split("\n")[0] for t in texts if t and t.strip()])
    for family, own in license_scan.TEMPLATES.items():
        for t in own:
            assert model.classify(license_scan.words_of(t))[0] == family
    for t in license_scan.MENTIONS:
        assert model.classify(license_scan.words_of(t))[0] == license_scan.UNKNOWN
    some = [None, "", "Plain text.\nReleased under the MIT License.\n\nMore", "All rights reserved.\nLicensed under CC BY-NC 4.0."]
    got = {r.doc_id: (r.n_paragraphs, r.families) for r in license_scan.scan(table(spark, some), model).collect()}
    assert got == {0: (0, []), 1: (0, []), 2: (3, ["mit"]), 3: (2, ["all-rights-reserved", "cc-by-nc"])}
    clean = license_scan.scan(docs.drop("score"), model).collect()
    assert all(r.families == [] for r in clean) and len(clean) == len(texts)
