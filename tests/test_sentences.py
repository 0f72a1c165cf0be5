"""Sentence borders: what the corpus teaches, and what follows for single texts."""

import pytest

from lexigrain.operators import joins, sentences
from lexigrain.session import persisted

PLAIN = "we walked over to the market and bought bread there today"

# dr and e.g stand before a full stop only; "we" opens sentences and never has a capital inside one
CORPUS = (
    [f"Yesterday dr. Miller saw us. {PLAIN}. We like the fruit, e.g. apples and plums."] * 40
    + [f"{PLAIN}. The house is old! Nobody lives there? {PLAIN}."] * 40
    + ["The shop of Smith and Miller sells paper"] * 10
    + ["today they gave us plums and bread there"] * 20
)

CASES = {
    "Dr. Miller saw the house.": 1,
    "We saw dr. Miller. We left.": 2,
    "We asked the dr. We left.": 2,
    "Bread, e.g. Miller bread, is old.": 1,
    "J. Smith and K. Miller left.": 1,
    "The house is old. nobody lives there.": 2,
    "The house is old . Nobody left .": 2,
    "Old! Nobody? yes.": 3,
    "The house... is old... Nobody left.": 2,
    '"The house is old." (We left.)': 2,
    "no mark at all": 1,
    "... !!! ...": 0,
    "": 0,
    None: 0,
    "We left. " * 5_000: 5_000,
}


@pytest.fixture(scope="module")
def statistics(spark):
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(CORPUS)], "text string, n int")
    return persisted(sentences.border_statistics(docs.repartition(3)), "borders")


def counted(spark, statistics):
    rows = [(i, t, 7) for i, t in enumerate(CASES)] + [(0, "Dr. Miller saw the house.", 7), (None, "Yes! No.", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sentences long").repartition(3)
    got = sentences.sentence_counts(docs, statistics)
    assert got.columns == ["doc_id", "sentences"]
    return sorted(((r.doc_id, r.sentences) for r in got.collect()), key=str)


def test_abbreviations_are_found_by_their_counts(statistics):
    rows = {r.token: r for r in statistics.collect()}
    assert {t for t, r in rows.items() if r.abbreviation} == {"dr", "e.g"}
    assert rows["today"].n_stopped == 120 and rows["today"].score < sentences.LEAST_SCORE
    assert rows["bread"].score is None
    assert rows["we"].opener and not rows["miller"].opener and not rows["smith"].opener


def test_every_rule_by_hand(spark, statistics):
    want = [(i, n) for i, n in enumerate(CASES.values())] + [(0, 1), (None, 2)]
    assert counted(spark, statistics) == sorted(want, key=str)


def test_statistics_too_large_to_send_give_the_same(spark, statistics, monkeypatch):
    want = counted(spark, statistics)
    monkeypatch.setattr(joins.lookup_join, "__defaults__", (None, "inner", None, 0, joins.HOT_KEYS))
    assert counted(spark, statistics) == want


def test_empty_tables(spark, statistics):
    docs = spark.createDataFrame([(1, "Dr. Miller. We left.")], "doc_id long, text string")
    assert sentences.border_statistics(docs.limit(0)).count() == 0
    assert sentences.border_statistics(docs.selectExpr("CAST(NULL AS STRING) AS text")).count() == 0
    assert sentences.sentence_counts(docs.limit(0), statistics).count() == 0
    # without statistics every full stop is a border
    assert sentences.sentence_counts(docs, statistics.limit(0)).first()["sentences"] == 3


def test_a_corpus_whose_words_all_carry_a_full_stop(spark):
    docs = spark.createDataFrame([("Yes. No.",), ("Yes.",)], "text string")
    rows = {r.token: (r.n, r.n_stopped, r.abbreviation) for r in sentences.border_statistics(docs).collect()}
    assert rows == {"yes": (2, 2, False), "no": (1, 1, False)}
