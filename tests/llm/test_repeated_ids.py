"""Rows that share a doc_id and hold unrelated texts."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_texts_of_one_id_are_documents_of_their_own(spark):
    r = random.Random(3)
    say = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    a, b, c = say(), say(), say()
    rows = [(3, a, "en", "x"), (7, b, "en", "x"), (7, c, "en", "x"), (7, c, "en", "x"), (7, a, "en", "x"), (9, c, "en", "x"), (None, a, "en", "x"), (5, None, "en", "x"), (5, "", "en", "x"), (5, "", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = [tuple(x)[:2] for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    # a stays with 3, and 7's other texts stay with 7, once each
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted([(3, a), (7, b), (7, c), (None, a), (5, None), (5, "")], key=key)
