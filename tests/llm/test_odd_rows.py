"""Empty tables, repeated rows, clashing names and very long texts of the operators that had no such test."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from diurna.llm import decontaminate, knn_quality, quality_rules, token_counts, url_model

BYTE = public_tokenizers.path("byte_bpe_50k.json")
CLASH = ("n", "n_words", "n_tokens", "n_bytes", "steps", "score", "host", "path", "rule", "verdict", "hit", "kept", "_m")


def docs(spark, texts, ids=None):
    df = spark.createDataFrame([(i if ids is None else ids[i], t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in CLASH})


TEXTS = [None, "", "a b", "a b", "A Plain sentence, with marks! " * 5, "word " * 40_000]


def test_token_counts(spark):
    rows = token_counts.prefix_counts(docs(spark, TEXTS, [1, 2, 3, 3, None, 6]), BYTE).select("doc_id", "n_bytes", "n_tokens").collect()
    got = sorted(map(tuple, rows), key=str)
    assert got[:4] == [(1, 0, 0), (2, 0, 0), (3, 3, 2), (3, 3, 2)] and got[4][:2] == (6, 200_000)
    assert token_counts.prefix_counts(docs(spark, TEXTS).limit(0), BYTE).collect() == []


def test_quality_rules(spark):
    rows = quality_rules.judged(docs(spark, TEXTS).drop("n_words", "kept")).select("doc_id", "n_words", "kept").collect()
    assert [r.n_words for r in sorted(rows)] == [0, 0, 2, 2, 25, 40_000] and not any(r.kept for r in rows)
    # measures stand in place of columns of their names
    assert quality_rules.judged(docs(spark, TEXTS)).filter("n_words = 40000").count() == 1
    assert quality_rules.judged(docs(spark, TEXTS).limit(0)).collect() == []


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "item_id long, text string")
    rows = decontaminate.hits(docs(spark, TEXTS), items, ["doc_id"]).collect()
    assert {r.doc_id: r.n_hit for r in rows} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 0, 5: 0}
    assert decontaminate.hits(docs(spark, TEXTS).limit(0), items, ["doc_id"]).collect() == []
    assert {r.n_hit for r in decontaminate.hits(docs(spark, TEXTS), items.limit(0), ["doc_id"]).collect()} == {0}


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, "http://b.org/y"), (3, None), (4, "http://c.org/" + "z" * 20_000)],
                                  "page_id long, url string")
    rows = url_model.judged(pages.withColumns({c: F.lit("x") for c in CLASH})).collect()
    assert len(rows) == 5 and {r.verdict for r in rows if r.page_id == 1} == {"allow"}
    assert url_model.judged(pages.limit(0)).collect() == []


def test_neighbours_of_equal_similarity(spark):
    # copies of one text with both labels: whichever of them are picked, the votes are those of the group
    own = knn_quality.terms("The same sentence, over and over. " * 4)
    import numpy as np

    model = knn_quality.fit(np.array([own] * 40 + [knn_quality.terms("XX!! yy || $$ " * 9)] * 40), np.array([1.0] * 40 + [0.0] * 40), np.ones(80), 0.5)
    texts = ["The same sentence, over and over. " * 4] * 3
    scores = {r.score for r in knn_quality.scored(docs(spark, texts).drop("score"), model).collect()}
    assert len(scores) == 1 and scores.pop() > 0.9
    assert knn_quality.scored(docs(spark, texts).drop("score").limit(0), model).collect() == []


@pytest.mark.parametrize("n", [1, 5])
def test_copies_are_judged_alike(spark, n):
    text = "The cat sat on the mat of the house and it was not a dog. " * n
    rows = quality_rules.judged(docs(spark, [text] * 4).drop("n_words", "kept")).collect()
    assert len({tuple(r)[2:] for r in rows}) == 1
