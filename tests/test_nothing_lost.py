"""Counts and fits leave nothing out: classes, labels, terms, tokens."""

import pytest
from pyspark.sql import functions as F

from lexigrain.operators import features, models, scoring, stats, trees


def test_cross_tab_fails_on_a_value_without_a_column(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "r string, c string")
    assert stats.class_values(df, "c") == ["x", "y"]
    whole = {r.r: (r.x, r.y) for r in stats.cross_tab(df, "r", "c", ["x", "y"]).collect()}
    assert whole == {"a": (1, 1), "b": (1, 0)}
    with pytest.raises(Exception, match="not a column"):
        stats.cross_tab(df, "r", "c", ["x"]).collect()


def test_class_counts_fail_on_a_label_outside(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    assert df.agg(trees.class_counts("label", "1", 3).alias("c")).first().c == [1, 1, 1]
    for outside in (df.agg(trees.class_counts("label", "1", 2)), df.withColumn("label", F.lit(None).cast("int")).agg(trees.class_counts("label", "1", 2))):
        with pytest.raises(Exception, match="labels must be"):
            outside.collect()


def test_count_vectors_hold_every_term(spark, monkeypatch):
    df = spark.createDataFrame([([f"t{i}" for i in range(300)],), (["t1", "new"],)], "tokens array<string>")
    assert len(models.count_vectors(df).fit(df).vocabulary) == 301
    monkeypatch.setattr(models, "DRIVER_TERMS", 300)
    with pytest.raises(ValueError, match="301"):
        models.count_vectors(df)


def test_topics_read_all_documents(spark):
    assert models.topic_model().getSubsamplingRate() == 1.0


def test_term_runs(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, ["z"])]
    df = spark.createDataFrame(rows, "doc_id long, toks array<string>")
    got = {r.doc_id: (r.doc_len, [tuple(x) for x in r.runs]) for r in features.counted_terms(df, F.col("toks")).collect()}
    assert got == {1: (3, [("a", 1), ("b", 2)]), 2: (0, []), 3: (1, [("z", 1)])}
    plan = features.doc_terms(df, F.col("toks"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_filter_by_set_and_by_join_agree(spark, monkeypatch):
    rows = [(1, ["a", "b", "a", "c"]), (2, ["c"]), (3, [])]
    df = spark.createDataFrame(rows, "doc_id long, toks array<string>")
    kept = spark.createDataFrame([("a", 2), ("b", 1)], "token string, n long")
    want = {1: ["a", "b", "a"], 2: [], 3: []}
    in_place = features.filter_tokens(df, F.col("toks"), kept)
    assert {r.doc_id: r.tokens for r in in_place.collect()} == want
    plan = in_place._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    monkeypatch.setattr(features, "LISTED_TOKENS", 1)
    joined = features.filter_tokens(df, F.col("toks"), kept)
    assert {r.doc_id: r.tokens for r in joined.collect()} == want


def test_short_texts_reach_the_scorer_unchanged(spark):
    def echo():
        return lambda texts: [[float(len(t)), float(t.count("  "))] for t in texts]

    texts = ["a  b,  c", "one two three four five  six"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.logits for r in scoring.score_texts(df, echo, max_tokens=5).collect()}
    assert got[0] == [8.0, 2.0]
    assert got[1] == [float(len("one two three four five")), 0.0]
