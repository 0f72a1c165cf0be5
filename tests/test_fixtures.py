"""Small inputs with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lexigrain.functions import text
from lexigrain.functions.fixed_values import AGE_LABELS, MERGED_AGE_LABEL, RARE_AGE_LABELS
from lexigrain.functions.numeric import argmax, entropy, round4
from lexigrain.operators import evaluate, features, labels, splits, trees, vocab
from lexigrain.session import persisted


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def one(spark, value, expression):
    return docs(spark, [(0, value)]).select(expression(F.col("text"))).first()[0]


def test_clean(spark):
    def clean(t):
        return text.clean_tokens(t, ["the", "and"])

    assert one(spark, "The 3 cats, and the dog's co-op!", clean) == ["cats", "dogs", "coop"]
    assert one(spark, "42 the", clean) == []


def test_clean_keeps_unicode_spaces_and_letters(spark):
    value = "Été naïve x² ½ ١٢ ok_1"
    assert one(spark, value, lambda t: text.clean_tokens(t, [])) == ["été", "naïve", "x²", "½", "ok_"]


def test_tokens(spark):
    assert one(spark, "@bob it's co-op U.S. #x", text.tokens) == ["@bob", "it's", "co-op", "U.S", "#x"]


def test_words_sentences_and_padding(spark):
    assert one(spark, "It's 5, ok!", text.words) == ["It's", "5", ",", "ok", "!"]
    assert one(spark, "It's 5, Ok! the", lambda t: text.tidy_words(text.words(t), ["the"])) == ["it's", "ok"]
    assert one(spark, "a1 Bc the d", lambda t: text.alphabetic_words(t, ["the"])) == ["bc", "d"]
    assert one(spark, "One. Two?! Three", text.sentence_count) == 3
    assert one(spark, "", text.sentence_count) == 0
    padded = one(spark, "a b", lambda t: text.pad(F.split(t, " "), F.lit(4), "-"))
    assert padded == ["a", "b", "-", "-"]
    assert one(spark, "a b c", lambda t: text.truncate(F.split(t, " "), 2)) == ["a", "b"]


def test_topic_names(spark):
    words = F.array(*[F.lit(w) for w in "abcdefghij"])
    row = spark.range(1).select(
        text.topic_name(F.lit(2), words).alias("a"),
        text.topic_name(F.lit(2), words, from_rank=8).alias("b"),
    ).first()
    assert (row.a, row.b) == ("Topic 2: a, b, c", "Topic 2: h, i, j")


TOKENS = "doc_id long, label string, toks array<string>"


def test_top_tokens_tie_goes_to_first_seen(spark):
    rows = [(1, "a", ["x", "y"]), (2, "a", ["y", "x", "z"])]
    top = vocab.top_tokens(spark.createDataFrame(rows, TOKENS), "label", F.col("toks"), 2)
    assert [(r.token, r.n) for r in top.orderBy("rk").collect()] == [("x", 2), ("y", 2)]


def test_first_seen_key_refuses_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1 << 40, "a", ["x"])], TOKENS)
    with pytest.raises(Exception, match="too large"):
        vocab.token_counts(rows, "label", F.col("toks")).collect()


def test_vocabulary_in_first_seen_order(spark):
    rows = [(2, "a", ["y", "q"]), (1, "a", ["z", "y", "z"])]
    found = vocab.vocabulary(spark.createDataFrame(rows, TOKENS), F.col("toks"))
    assert [(r.token, r.cf) for r in found.orderBy("term_id").collect()] == [("z", 2), ("y", 2), ("q", 1)]


def weights(spark):
    return spark.createDataFrame(
        [(1, "x", ["a", "b", "a"]), (2, "x", []), (3, "x", ["b"])], TOKENS
    )


def test_term_frequency_and_idf(spark):
    df = weights(spark)
    tf = features.term_frequencies(features.doc_terms(df, F.col("toks"))).collect()
    assert {(r.doc_id, r.term): r.tf for r in tf} == {(1, "a"): 2 / 3, (1, "b"): 1 / 3, (3, "b"): 1.0}
    stats = features.term_statistics(features.doc_terms(df, F.col("toks")))
    n = features.document_count(df)
    found = {
        r.term: (r.c, r.d)
        for r in stats.select(
            "term",
            features.inverse_frequency(n, F.col("cf")).alias("c"),
            features.inverse_frequency(n, F.col("df")).alias("d"),
        ).collect()
    }
    assert found["a"] == pytest.approx((0.0, math.log(3 / 2)))
    assert found["b"] == pytest.approx((0.0, 0.0))


def test_feature_vectors_cover_empty_documents(spark):
    df = weights(spark)
    fitted = features.fit_features(df, F.col("toks"), 2)
    assert [r.term for r in fitted.table.orderBy("feature_pos").collect()] == ["b", "a"]
    rows = {r.doc_id: r.features for r in fitted.vectors(df, F.col("toks"), 2).collect()}
    assert rows[2] == [0.0, 0.0]
    assert rows[1] == pytest.approx([1 / 3, 2 / 3])


@pytest.mark.parametrize("weighting", ["tf", "tfidf"])
def test_feature_vectors_are_counted_inside_the_row(spark, weighting):
    rows = [(1, ["a", "b", "b", "z"]), (2, None), (3, ["b", None]), (4, []), (None, ["a"])]
    df = spark.createDataFrame(rows, "doc_id long, toks array<string>").repartition(2)
    fitted = features.fit_features(df, F.col("toks"), 2, weighting)
    dense = fitted.vectors(df, F.col("toks"), 2)
    chosen = {r.feature_pos: (r.term, r.idf if weighting == "tfidf" else 1.0) for r in fitted.table.collect()}
    for r in dense.collect():
        toks = dict(rows)[r.doc_id] if r.doc_id is not None else None
        want = [chosen[i][1] * (toks or []).count(chosen[i][0]) / max(len(toks or []), 1) for i in range(2)]
        assert r.features == pytest.approx(want)
    assert dense.count() == len(rows)
    plan = fitted.vectors(persisted(df), F.col("toks"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_filter_tokens_keeps_order_and_documents(spark):
    df = weights(spark)
    kept = spark.createDataFrame([("a", 2)], "token string, n long")
    found = {r.doc_id: r.tokens for r in features.filter_tokens(df, F.col("toks"), kept).collect()}
    assert found == {1: ["a", "a"], 2: [], 3: []}


def test_class_weights(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    found = {r.label: (r.inverse, r.weight) for r in labels.class_weights(rows, "label").collect()}
    assert found["a"] == pytest.approx((4 / 3, 0.25))
    assert found["b"] == pytest.approx((4.0, 0.75))


def test_label_codes(spark):
    rows = spark.createDataFrame([(x,) for x in ("10s", "20s", "100s", "110s")], "label string")
    lexicographic = labels.encode(rows, labels.category_codes(rows, "label"), "label")
    assert {r.label: r.code for r in lexicographic.collect()} == {"10s": 1, "20s": 3, "100s": 0, "110s": 2}
    numeric = labels.code_by_map(rows, "label", labels.numeric_codes(AGE_LABELS))
    assert {r.label: r.code for r in numeric.collect()} == {"10s": 0, "20s": 1, "100s": 9, "110s": 10}


def test_unknown_label(spark):
    rows = spark.createDataFrame([("x",)], "label string")
    codes = labels.numeric_codes(AGE_LABELS)
    with pytest.raises(Exception, match="unknown label"):
        labels.code_by_map(rows, "label", codes).collect()
    assert labels.code_by_map(rows, "label", codes, on_unknown="null").first().code is None
    known = spark.createDataFrame([("a",)], "label string")
    assert labels.encode(rows, labels.category_codes(known, "label"), "label").first().code == -1


def test_recode_and_exclude(spark):
    rows = spark.createDataFrame([("80s",), ("110s",), ("10s",), (None,)], "label string")
    merged = labels.merge_labels(rows, "label", RARE_AGE_LABELS, MERGED_AGE_LABEL)
    assert [r.label for r in merged.collect()] == ["70s", "70s", "10s", None]
    left = labels.exclude_labels(rows, "label", RARE_AGE_LABELS).collect()
    assert [r.label for r in left] == ["10s", None]
    assert rows.select(labels.label_number(F.col("label"))).collect()[0][0] == 80


def pairs(spark, actual, predicted):
    rows = spark.createDataFrame(list(zip(actual, predicted)), "a string, p string")
    return evaluate.pair_counts(rows, "a", "p")


def test_metrics(spark):
    counted = pairs(spark, "aabb", "abbb")
    row = evaluate.one_class_summary(counted, "a").first()
    assert (row.precision, row.recall, row.f1, row.accuracy) == (1.0, 0.5, 0.6667, 0.75)
    macro = evaluate.macro_scores(counted).first()
    assert (macro.macro_precision, macro.macro_recall, macro.macro_f1) == (0.8334, 0.75, 0.7333)
    assert evaluate.balanced_accuracy(counted).first()[0] == 0.75


def test_predicted_class_that_is_never_actual(spark):
    counted = pairs(spark, "aa", "ac")
    assert [r.label for r in evaluate.class_scores(counted).collect()] == ["a"]
    cells = {(r.actual, r.predicted): r.n for r in evaluate.confusion_matrix(counted).collect()}
    assert cells == {("a", "a"): 1, ("a", "c"): 1, ("c", "a"): 0, ("c", "c"): 0}
    report = {r.label: r for r in evaluate.classification_report(counted).collect()}
    assert report["c"].support == 0 and report["accuracy"].f1 == 0.5


def test_empty_predictions(spark):
    counted = evaluate.pair_counts(spark.createDataFrame([], "a string, p string"), "a", "p")
    assert evaluate.accuracy(counted).first()[0] is None


def test_gold_against_gold(spark):
    rows = spark.createDataFrame([("10s",), ("20s",)], "age string")
    found = {r.label: r.f1 for r in evaluate.gold_scores(rows, "age", AGE_LABELS).collect()}
    assert found["10s"] == found["20s"] == 1.0 and found["30s"] == 0.0


def test_entropy_and_argmax(spark):
    row = spark.createDataFrame([([2, 2], [4, 0], [1, 3, 3])], "a array<long>, b array<long>, c array<long>")
    found = row.select(entropy("a"), entropy("b"), argmax(F.col("c")), round4(F.lit(1 / 32))).first()
    assert tuple(found) == (1.0, 0.0, 1, 0.0312)


def tree_rows(spark, columns, y):
    rows = [(i, [float(c[i]) for c in columns], k) for i, k in enumerate(y)]
    return spark.createDataFrame(rows, "row_id long, features array<double>, label int")


def test_best_split_and_tie(spark):
    x = [1, 2, 3, 4]
    nodes = trees.grow(tree_rows(spark, [x, x], [0, 0, 1, 1]), 2, 2, max_depth=2)
    root = nodes.filter("node_id = 0").first()
    assert (root.feature_idx, root.threshold, root.gain) == (0, 2.5, 1.0)
    assert nodes.count() == 3


def test_forest_votes(spark):
    votes = spark.createDataFrame([(0, t, v) for t, v in enumerate([0, 1, 1, 0])], "row_id long, tree_id int, predicted int")
    shares = {r.predicted: r.share for r in trees.vote_shares(votes, 4).collect()}
    assert shares == {0: 0.5, 1: 0.5}
    assert trees.majority(votes).first().predicted == 0


def test_positional_split(spark):
    rows = spark.range(1, 11).withColumnRenamed("id", "k")
    found = {r.k: r.split for r in splits.positional_split(rows, "k").collect()}
    assert [k for k, s in sorted(found.items()) if s == "train"] == [1, 2, 3, 4, 5, 6]
    assert [k for k, s in sorted(found.items()) if s == "validation"] == [7, 8]
