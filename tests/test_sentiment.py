"""Sentiment rules against scores worked out by hand."""

import math

import pytest

from lexigrain.operators import joins
from lexigrain.operators.sentiment import sentiment_by_rules

# good 2, awful -3
CASES = {
    "the good end": 2,
    "awful good": -1,
    "Good, \"awful\" (good)": 1,
    "a GOOD end": 2 + 0.733,
    "an AWFUL end": -3 - 0.733,
    "GOOD END": 2,
    "very good": 2 + 0.293,
    "very awful": -3 - 0.293,
    "very so good": 2 + 0.293 * 1.95,
    "very so truly good": 2 + 0.293 * 2.85,
    "very a b c good": 2,
    "slightly good": 2 - 0.293,
    "slightly a awful": -3 + 0.293 * 0.95,
    "not good": -0.74 * 2,
    "not a very good": -0.74 * 2.293,
    "don't a b good": -0.74 * 2,
    "not a b c good": 2,
    "not never awful": 0.74 * 3,
    "good but awful": 2 * 0.5 - 3 * 1.5,
    "good but awful but good": (2 - 3) * 0.5 + 2 * 1.5,
    "But good": 3,
    "good!": 2 + 0.292,
    "awful!!": -3 - 2 * 0.292,
    "good !!!!!! !": 2 + 4 * 0.292,
    "nothing rated here!!!": 0,
    "!!!": 0,
    "": 0,
    None: 0,
    "good " * 20_000: 40_000,
}


def normal(total):
    return total / math.sqrt(total * total + 15)


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [("good", 2.0), ("good", 1.0), ("awful", -3.0), ("unused", 4.0)]
    return spark.createDataFrame(rows, "token string, valence double")


def judged(spark, lexicon):
    texts = list(CASES)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, "awful", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, compound string").repartition(3)
    got = sentiment_by_rules(docs, lexicon)
    assert got.columns == ["doc_id", "compound", "sentiment"]
    return texts, got.collect()


def test_every_rule_by_hand(spark, lexicon):
    texts, rows = judged(spark, lexicon)
    assert len(rows) == len(CASES) + 2
    for r in rows:
        want = normal(CASES[texts[r.doc_id]] if r.doc_id is not None else -3)
        assert r.compound == pytest.approx(want, abs=1e-4), texts[r.doc_id]
        assert r.sentiment == ("positive" if want >= 0 else "negative")


def test_a_lexicon_too_large_to_send_gives_the_same(spark, lexicon, monkeypatch):
    _, want = judged(spark, lexicon)
    monkeypatch.setattr("lexigrain.operators.sentiment.BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins.lookup_join, "__defaults__", (None, "inner", None, 0, joins.HOT_KEYS))
    _, got = judged(spark, lexicon)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_rows_and_no_ratings(spark, lexicon):
    docs = spark.createDataFrame([(1, "good awful")], "doc_id long, text string")
    assert sentiment_by_rules(docs.limit(0), lexicon).count() == 0
    assert sentiment_by_rules(docs, lexicon.limit(0)).first()["compound"] == 0


def test_word_lists_are_parameters(spark, lexicon):
    docs = spark.createDataFrame([(1, "kaum good"), (2, "not good")], "doc_id long, text string")
    rows = sentiment_by_rules(docs, lexicon, negations=("kaum",)).collect()
    assert {r.doc_id: r.sentiment for r in rows} == {1: "negative", 2: "positive"}


def test_a_word_is_looked_up_once():
    from lexigrain.functions import sentiment as rules

    assert str(rules.word_scores()).count("element_at") == 1
