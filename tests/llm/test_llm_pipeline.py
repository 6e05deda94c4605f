"""The pipeline's stages against plain versions on a small corpus."""

import re
import time

import brute
import corpus_pipeline
import public_tokenizers
import pytest
from diurna.llm import encoding, jaccard_join, packing, stages

SMALL = "/root/testdata/sf0.001"


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "packing"]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]

    first = stages.quality_rules_stage(spark, docs, SMALL).cache()
    assert first.columns == docs.columns
    kept = {r.doc_id: r.text for r in first.collect()}
    assert kept.items() <= rows.items() and not any(brute.measures(t)[-1] for t in kept.values())

    groups = brute.components(kept.items(), stages.SHINGLE_WORDS, stages.SIMILARITY)
    second = stages.near_duplicate_stage(spark, first, SMALL).cache()
    assert second.columns == docs.columns
    unique = {i: t for i, t in kept.items() if groups[i][1] == i}
    assert {r.doc_id: r.text for r in second.collect()} == unique

    third = stages.repeated_passage_stage(spark, second, SMALL).cache()
    assert third.columns == docs.columns
    marks = brute.repeated_bytes(unique.values(), stages.PASSAGE_BYTES)
    left = {i: brute.cut(*m) for i, m in zip(unique, marks)}
    got = third.collect()
    assert {r.doc_id: r.text for r in got} == left and all(r.n_chars == len(r.text) for r in got)

    fourth = stages.decontamination_stage(spark, third, SMALL).cache()
    assert fourth.columns == docs.columns
    clean = {i: t for (i, t), w in zip(left.items(), brute.decontaminated(left.values(), items)) if not w[-1]}
    assert {r.doc_id: r.text for r in fourth.collect()} == clean

    lib = encoding.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {i: len(lib.whole(t)) // 4 + 1 if t else 1 for i, t in clean.items()}
    pieces = stages.packing_stage(spark, fourth, SMALL).collect()
    own = {}
    for r in pieces:
        own[r.doc_id] = own.get(r.doc_id, 0) + r.length
    assert own == tokens
    whole = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pieces))


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).collect() == []


def test_rows_without_id_or_text_go_on(spark):
    text = "The cat sat on the mat of the house and " + " ".join(f"word{i} of" for i in range(60))
    docs = spark.createDataFrame([(None, text, "en", "a", 1), (1, None, None, None, None), (2, text, "en", "a", 1), (2, text, "en", "a", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id or 0 for r in stages.near_duplicate_stage(spark, docs, SMALL).collect()) == [0, 1, 2]


def test_texts_that_share_an_id_stay_or_go_each_for_itself(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (7, a), (7, b), (7, b), (9, b), (3, c), (3, c + " end"), (None, a), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in stages.near_duplicate_stage(spark, docs, SMALL).collect()]
    assert len([g for g in got if g[0] == 3]) == 1
    assert sorted((g for g in got if g[0] != 3), key=str) == sorted([(5, a), (7, b), (None, a), (4, None), (4, "")], key=str)


def test_quality_stage_is_linear_in_text_length(spark):
    def docs(n):
        text = " ".join(f"the{i % 977} of" for i in range(n // 2))
        return spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")

    def seconds(n):
        start = time.monotonic()
        assert len(stages.quality_rules_stage(spark, docs(n), SMALL).collect()) <= 1
        return time.monotonic() - start

    seconds(100)
    short, long = min(seconds(2_000) for _ in range(2)), min(seconds(20_000) for _ in range(2))
    assert long < 20 * short + 2
    # lambdas of the pushed filter refer to lambda variables only: the text is split once into words, once into lines
    plan = stages.quality_rules_stage(spark, docs(100), SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"split\(", plan)) == 2


def test_pipeline_with_long_texts(spark, folder):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = " ".join(f"the word{i % 4001} of{i}" for i in range(7_000))
    long = spark.createDataFrame([(10**6, text, "en", "s", len(text)), (10**6 + 1, None, None, None, None)], docs.schema)
    docs.unionByName(long).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sum(r.length for r in rows if r.doc_id == 10**6) > 20_000


def test_no_task_needs_two_python_workers(spark, monkeypatch):
    plans = {}

    def staged(df, name, write=jaccard_join.staged):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(jaccard_join, "staged", staged)
    text = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join([*text[:2 * i], f"own{i}", *text[2 * i + 1:]])) for i in range(130)]
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"), stages.SHINGLE_WORDS, stages.SIMILARITY).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 130
    # lists of over LONG classes: their members' texts become taken shingles in one map
    assert plans["more"].count("MapInArrow") == 1


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_few_remembered_words_give_the_same_ids(name):
    lib = encoding.Encoder(public_tokenizers.path(name), 200)
    texts = ["", *(" ".join(f"Word{i * j % 997} of, {chr(228 + j % 9)}{i}\nthe" for i in range(70)) for j in range(1, 40))]
    most = 0
    for at in range(0, len(texts), 4):
        some = texts[at:at + 4]
        assert list(lib.encode_many(some)) == [lib.whole(t) if t else b"" for t in some]
        most = max(most, len(lib.table))
    assert most < 200 // 2 + len({w for t in texts[:5] for w in t.split()}) * 4 and len(lib.old) < 1_000


def test_packing_stage_remembers_fewer_words(spark, monkeypatch):
    asked = []
    pack = packing.pack
    monkeypatch.setattr(stages.packing, "pack", lambda *a, **k: asked.append(k) or pack(*a, **k))
    docs = spark.createDataFrame([(1, "the cat sat", "en", "a", 11), (2, None, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.length) for r in stages.packing_stage(spark, docs, SMALL).collect()) == [(1, 4), (2, 1)]
    assert asked[0]["remembered"] < encoding.REMEMBERED
