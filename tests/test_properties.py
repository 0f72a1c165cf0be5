"""Properties that hold for any input."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrain import sources
from lexigrain.functions import text
from lexigrain.functions.numeric import entropy
from lexigrain.operators import bayes, evaluate, features, labels, models, scoring, splits
from lexigrain.plans.model_queries import letter_scorer
from lexigrain.session import shared_path

FOLDER = "/root/testdata/sf0.001"
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_term_frequencies_sum_to_one(spark):
    terms = features.term_frequencies(features.doc_terms(documents(spark), text.clean_tokens(F.col("text"))))
    sums = terms.groupBy("doc_id").agg(F.sum("tf").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_normalised_rows_have_length_one(spark):
    rows = features.normalised_tfidf(documents(spark))
    sums = rows.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


@FEW
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("abcd")), min_size=1, max_size=30))
def test_outcomes_add_up(spark, rows):
    df = spark.createDataFrame(rows, "a string, p string")
    counted = evaluate.pair_counts(df, "a", "p")
    for r in evaluate.outcomes(counted, "either").collect():
        assert r.tp + r.fp + r.tn + r.fn == len(rows)
        assert r.tp == sum(a == p == r.label for a, p in rows)
        assert r.fn == sum(a == r.label != p for a, p in rows)
    weights = labels.class_weights(df, "a").agg(F.sum("weight")).first()[0]
    assert weights == pytest.approx(1.0)


@FEW
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8))
def test_entropy_is_bounded(spark, counts):
    found = spark.createDataFrame([(counts,)], "c array<long>").select(entropy("c")).first()[0]
    total = sum(counts)
    want = -sum(c / total * math.log2(c / total) for c in counts if c) if total else 0.0
    assert found == pytest.approx(want, abs=1e-9)
    assert -1e-9 <= found <= math.log2(len(counts)) + 1e-9


def test_splits_are_disjoint_and_complete(spark):
    docs = documents(spark).select("doc_id", "lang")
    for df in (splits.positional_split(docs, "doc_id"), splits.random_split(docs, "doc_id", 1),
               splits.exact_random_split(docs, "doc_id", 1)):
        assert df.count() == df.select("doc_id").distinct().count() == docs.count()
    exact = splits.exact_random_split(docs, "doc_id", 1).filter("split = 'train'").count()
    assert exact == int(docs.count() * 0.8)
    folds = splits.stratified_folds(docs, "doc_id", "lang", 5)
    sizes = folds.groupBy("lang", "fold").count().groupBy("lang").agg((F.max("count") - F.min("count")).alias("d"))
    assert max(r.d for r in sizes.collect()) <= 1


def test_folds_of_small_groups(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(3)], "k long, label string")
    assert sorted(r.fold for r in splits.stratified_folds(rows, "k", "label", 5).collect()) == [0, 1, 2]


def test_naive_bayes_separates_languages(spark):
    docs = documents(spark).select("doc_id", "text", "lang")
    tokens = text.clean_tokens(F.col("text"))
    fitted = bayes.fit_naive_bayes(docs, "lang", tokens)
    judged = docs.select("doc_id", "lang").join(fitted.predict(docs, tokens), "doc_id")
    assert evaluate.accuracy(evaluate.pair_counts(judged, "lang", "predicted")).first()[0] > 0.95
    odd = spark.createDataFrame([(1, "zzzz9 qqqq"), (2, "")], "doc_id long, text string")
    prior = fitted.predict(odd, tokens).collect()
    assert {r.predicted for r in prior} == {"en"}


def test_components_are_orthonormal_and_centred(spark):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select(
        F.col("vec_id").alias("doc_id"), F.slice("embedding", 1, 12).cast("array<double>").alias("features")
    )
    rows = features.as_vectors(vectors)
    fitted = models.reduction(50, rows.count(), 12).fit(rows)
    pc = fitted.stages[1].pc.toArray()
    assert pc.shape == (12, 12)
    assert np.allclose(pc.T @ pc, np.eye(12), atol=1e-9)
    projected = np.array([r.components.toArray() for r in fitted.transform(rows).collect()])
    assert np.allclose(projected.mean(axis=0), 0, atol=1e-9)


def test_mean_vectors_ignore_unknown_words(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(1, ["a", "a", "zz"]), (2, ["zz"])], "doc_id long, toks array<string>")
    vectors = spark.createDataFrame([("a", Vectors.dense([1.0, 2.0]))], ["word", "vector"])
    found = {r.doc_id: r["mean"] for r in models.mean_vectors(df, F.col("toks"), vectors, 2).collect()}
    assert found == {1: [1.0, 2.0], 2: [0.0, 0.0]}


def test_scoring_keeps_rows_and_whole_texts(spark):
    long = "x " * 5000 + "ü"
    df = spark.createDataFrame([(i, long) for i in range(70)], "doc_id long, text string")
    whole = scoring.score_texts(df, letter_scorer, max_tokens=None, batch=16).collect()
    assert len(whole) == 70 and all(r.logits[0] == 1.0 for r in whole)
    cut = scoring.score_texts(df, letter_scorer, max_tokens=512).first()
    assert cut.logits[0] == 0.0


def test_weighted_loss(spark):
    rows = spark.createDataFrame([([0.0, 0.0], 0), ([0.0, math.log(3)], 1)], "logits array<double>, target int")
    weights = spark.createDataFrame([(0, 1.0, 1), (1, 3.0, 1)], "target int, weight double, n long")
    loss = scoring.weighted_cross_entropy(rows, F.col("logits"), "target", weights).first()[0]
    assert loss == pytest.approx((math.log(2) + 3 * -math.log(0.75)) / 4)


def test_row_wise_operators_accept_a_stream(spark, tmp_path):
    documents(spark).select("doc_id", "text", "lang").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string, lang string").parquet(str(tmp_path / "in"))
    rows = labels.merge_labels(stream, "lang", ["es", "fr"], "romance").select(
        "doc_id", "lang", text.token_count(text.clean_tokens(F.col("text"))).alias("n")
    )
    running = rows.writeStream.format("memory").queryName("cleaned").start()
    running.processAllAvailable()
    running.stop()
    assert spark.table("cleaned").count() == documents(spark).count()


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "text": "x", "age": "10s"}, {"id": "2", "text": "y"}]')
    (tmp_path / "b.jsonl").write_text('{"id": "1", "text": "x", "age": "10s"}\n{"text": "y"}\n')
    (tmp_path / "stop.txt").write_text("the\nand\n")
    for df in (sources.read_json_array(spark, str(tmp_path / "a.json")),
               sources.read_json_lines(spark, str(tmp_path / "b.jsonl"))):
        assert sorted(((r.text, r.age) for r in df.collect()), key=str) == [("x", "10s"), ("y", None)]
    assert sources.read_stop_words(spark, str(tmp_path / "stop.txt")) == ["the", "and"]
    with pytest.raises(ValueError):
        sources.read_stop_words(spark, str(tmp_path / "stop.txt"), limit=1)
    metrics = spark.createDataFrame([("a", 0.5)], "label string, f1 double")
    sources.write_metrics(metrics, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().f1 == 0.5


class Unset:
    """A session without the checkpoint setting."""

    def __init__(self, master):
        self.conf = self
        self.sparkContext = self
        self.master = master

    def get(self, key, default=None):
        return default


def test_shared_folder_is_required_on_a_cluster(spark):
    assert shared_path(Unset("local[2]"), "x") != shared_path(Unset("local[2]"), "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(Unset("yarn"), "x")


def test_saved_trees(spark, tmp_path):
    from lexigrain.operators import trees

    rows = spark.createDataFrame([(i, [float(i)], i // 2) for i in range(4)], "row_id long, features array<double>, label int")
    nodes = trees.grow(rows, 1, 2, max_depth=2)
    sources.save_node_table(nodes, str(tmp_path / "t"))
    again = sources.load_node_table(spark, str(tmp_path / "t"))
    assert [r.predicted for r in trees.predict(rows, again).orderBy("row_id").collect()] == [0, 0, 1, 1]
