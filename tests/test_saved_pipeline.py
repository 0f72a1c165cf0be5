"""The whole baseline as one pipeline: saved, loaded, and equal to its operators one by one."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lexigrain import sources
from lexigrain.functions import text
from lexigrain.operators import features, saved_stages, subtrees, vocab
from lexigrain.session import shared_path

WORDS = {"a": "river stone moss water", "b": "engine wheel brake fuel", "c": "flour butter sugar oven"}


def rows(first, n):
    out = []
    for i in range(first, first + n):
        label = "abc"[i % 3]
        own = WORDS[label].split()
        out.append((i, label, " ".join([own[i % 4], own[(i // 3) % 4], own[(i * 7) % 4], f"The common word{i % 5}!"])))
    return out


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(rows(0, 90), "doc_id long, label string, text string").repartition(3)


@pytest.fixture(scope="module")
def fitted(train):
    pipeline = saved_stages.baseline_pipeline("label", top_tokens=6, top_features=12, components=50, max_depth=6, n_trees=9)
    return saved_stages.fit_written(pipeline, train, "doc_id", "label")


def unseen(spark):
    odd = [(1000, None, None), (1001, None, ""), (1002, None, "zzz unknown"), (3, "a", "river moss"), (3, "b", "engine fuel"),
           (None, None, "flour oven"), (1003, None, "sugar " * 50_000)]
    return spark.createDataFrame(rows(500, 60) + odd, "doc_id long, label string, text string").repartition(4)


def scores(model, docs):
    return sorted((str(r["doc_id"]), str(r["text"])[:40], r["predicted"]) for r in model.transform(docs).collect())


def test_a_loaded_pipeline_scores_like_the_fitted_one(spark, fitted):
    path = shared_path(spark, "whole")
    sources.save_model(fitted, path)
    sources.save_model(fitted, path)  # overwrites
    loaded = sources.load_model(path)
    assert isinstance(loaded, PipelineModel)
    assert [type(s) for s in loaded.stages] == [type(s) for s in fitted.stages]
    docs = unseen(spark)
    want = scores(fitted, docs)
    assert scores(loaded, docs) == want
    assert len(want) == 67 and all(p in ("a", "b", "c") for *_, p in want)
    by_text = {t: p for _, t, p in want}
    assert (by_text["river moss"], by_text["engine fuel"], by_text["flour oven"]) == ("a", "b", "c")
    held = loaded.transform(docs.filter("doc_id >= 500 AND doc_id < 1000"))
    assert held.filter("label <> predicted").count() == 0


def test_stages_give_what_the_operators_give(train, fitted):
    got = fitted.transform(train)
    tokens = train.select("doc_id", "label", text.clean_tokens(F.col("text")).alias("tokens"))
    top = vocab.top_tokens(tokens, "label", F.col("tokens"), 6)
    kept = features.filter_tokens(tokens, F.col("tokens"), top)
    table = features.fit_features(kept, F.col("tokens"), 12)
    want = {r["doc_id"]: r["features"] for r in table.vectors(kept, F.col("tokens"), table.table.count()).collect()}
    for r in got.select("doc_id", vector_to_array("features").alias("v")).collect():
        assert r["v"] == pytest.approx(want[r["doc_id"]], abs=1e-12)


def test_plain_fit_gives_the_same(train, fitted, spark):
    pipeline = saved_stages.baseline_pipeline("label", top_tokens=6, top_features=12, components=50, max_depth=6, n_trees=9)
    docs = unseen(spark)
    assert scores(pipeline.fit(train), docs) == scores(fitted, docs)


def test_weights_with_idf(spark, train):
    stages = [saved_stages.CleanTokens(), saved_stages.TermTable(inputCol="tokens", nFeatures=8, weighting="tfidf", idf="document")]
    model = Pipeline(stages=stages).fit(train)
    tokens = train.select("doc_id", text.clean_tokens(F.col("text")).alias("tokens"))
    table = features.fit_features(tokens, F.col("tokens"), 8, "tfidf", "document")
    want = {r["doc_id"]: r["features"] for r in table.vectors(tokens, F.col("tokens"), 8).collect()}
    for r in model.transform(train).select("doc_id", vector_to_array("features").alias("v")).collect():
        assert r["v"] == pytest.approx(want[r["doc_id"]], abs=1e-12)


def test_a_forest_too_large_for_tasks_is_joined(spark, fitted, monkeypatch):
    docs = unseen(spark).filter("doc_id >= 500")
    want = scores(fitted, docs)
    monkeypatch.setattr(subtrees, "SHARED_NODES", 1)
    assert scores(fitted, docs) == want


def test_one_tree_and_numeric_labels(spark, train):
    numbered = train.withColumn("label", F.ascii("label").cast("long"))
    pipeline = saved_stages.baseline_pipeline("label", top_tokens=6, top_features=12, components=3, max_depth=6, n_trees=0)
    scored = saved_stages.fit_written(pipeline, numbered, "doc_id", "label").transform(numbered)
    assert dict(scored.dtypes)["predicted"] == "bigint"
    assert scored.filter("label = predicted").count() >= 85


def test_nothing_to_learn_is_refused(spark, train):
    empty = train.withColumn("text", F.lit(""))
    with pytest.raises(ValueError, match="no tokens"):
        saved_stages.baseline_pipeline("label").fit(empty)
    with pytest.raises(ValueError, match="no tokens"):
        saved_stages.baseline_pipeline("label").fit(train.limit(0))


def test_an_empty_table_is_scored(fitted, train):
    assert fitted.transform(train.limit(0)).count() == 0
