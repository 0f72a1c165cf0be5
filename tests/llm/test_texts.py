"""Language, quality, line rules and mixing."""

import collections

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexigrain.llm import langid, line_rules, mixing, quality

SF = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "42 !!! 7"), (5, "a"), (None, "the and of the")]


def plain_viterbi(scores, switch):
    n, k = scores.shape
    best, back = scores[0].astype(float), []
    for t in range(1, n):
        came = [max(range(k), key=lambda j: best[j] - (switch if j != i else 0)) for i in range(k)]
        back.append(came)
        best = np.array([best[c] - (switch if c != i else 0) + scores[t, i] for i, c in enumerate(came)])
    path = [int(best.argmax())]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1], best.max()


def value(path, scores, switch):
    return sum(scores[t, p] for t, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(200):
        scores = -rng.exponential(2, (rng.integers(1, 40), rng.integers(1, 5))).round(3)
        got = langid.viterbi(scores, 4.0)
        _, best = plain_viterbi(scores, 4.0)
        assert value(got, scores, 4.0) == pytest.approx(best)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_languages(spark, documents):
    model = langid.learn(documents)
    held_out = documents.filter(langid.fold(F.col("doc_id"), 3) == 1)
    found = langid.identify(held_out, model).join(held_out, "doc_id").select("lang", "lang_pred").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.98

    edges = spark.createDataFrame([(i, t, "x", 1.5) for i, t in EDGES + [(5, "a")]], "doc_id long, text string, lang_pred string, score double")
    got = langid.identify(edges, model).toPandas()
    assert len(got) == 7
    by_id = got.drop_duplicates("doc_id").set_index("doc_id")
    assert (by_id.loc[[1, 2, 3, 4], "lang_pred"] == "und").all() and (by_id.loc[[1, 2, 3, 4], "score"] == 0).all()
    assert by_id.loc[5, "lang_pred"] in model.langs
    assert got[got.doc_id.isna()].lang_pred.tolist() == ["en"]
    assert langid.identify(edges.limit(0), model).count() == 0


def test_spans_of_mixed_text(documents):
    model = langid.learn(documents)
    rows = documents.filter("n_chars > 600").groupBy("lang").agg(F.min_by("text", "doc_id").alias("t")).collect()
    text = {r.lang: " ".join(r.t.split()[:60]) for r in rows}
    found = langid.Labeller(model).label([f"{text['en']} {text['de']} {text['en']}"])
    spans = found["spans"][0]
    assert [s["lang"] for s in spans] == ["en", "de", "en"]
    assert sum(s["n_words"] for s in spans) == len(langid.words_of(f"{text['en']} {text['de']} {text['en']}"))


def test_unlearned_scripts_and_empty_models(spark):
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(i, "the house of the", "en") for i in range(9)] + [(9, "привет", None)], schema)
    model = langid.fit(docs)
    assert langid.Labeller(model).label(["привет мир", "½ ²"])[["lang_pred", "score"]].values.tolist() == [["en", 0.0], ["und", 0.0]]
    nothing = langid.fit(docs.filter("lang IS NULL"))
    assert langid.Labeller(nothing).label(["the"])["lang_pred"].tolist() == ["und"]


def test_flattened_trees_equal_walking_them():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(400, len(quality.FEATURES)))
    labels = (rows[:, 2] + rows[:, 5] > 0).astype(float)
    model = quality.fit(rows, labels, trees=12, depth=3)

    def walk(row):
        odds = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            odds += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-odds))

    assert np.allclose(model.score(rows), [walk(r) for r in rows])
    assert ((model.score(rows) > 0.5) == labels).mean() > 0.9


def test_held_out_quality(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(documents, labels)
    known = labels.filter(quality.fold(F.col("doc_id"), 5) == 0)
    found = quality.score(documents, model).join(known, "doc_id").toPandas()
    assert (found.predicted == found.quality).mean() > 0.95
    edges = spark.createDataFrame([(i, t, 7, 1) for i, t in EDGES], "doc_id long, text string, score int, features int")
    got = quality.score(edges, model).toPandas()
    assert len(got) == len(EDGES) and got.score.between(0, 1).all()


def test_quality_without_labels(spark, documents):
    labels = spark.createDataFrame([(1, None), (2, 5)], "doc_id long, quality int")
    model = quality.learn(documents, labels)
    assert set(quality.score(documents.limit(3), model).toPandas().score) == {0.5}


def plain_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    return len({i + k for i, w in enumerate(windows) if w in often for k in range(5)})


def test_repeated_words():
    rng = np.random.default_rng(4)
    for _ in range(300):
        words = [b"%d" % x for x in rng.integers(0, rng.integers(1, 5), rng.integers(0, 40))]
        assert line_rules.repeated_words(words) == plain_repeats(words)
    many = [b"%d" % (i % 9000) for i in range(20_000)]
    assert line_rules.repeated_words(many) == 20_000


def test_line_rules_edges_and_cleaned_texts(spark):
    own = ["".join("abcdefghij"[int(c)] for c in str(i)) for i in range(40)]
    body = [f"text {x} is about subject {x} and has twelve words of its own {x}" for x in own]
    rows = [(i, f"Page 1{i} of our site\n{t}", "h", 0) for i, t in enumerate(body)]
    rows += [(99, "page 777 of   OUR site\nshort rest of words here", "h", 0)] * 2
    rows += [(100 + i, t, None, 0) for i, (_, t) in enumerate(EDGES)] + [(None, body[0], "k", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host int").repartition(3)
    got = line_rules.quality_rules(docs).toPandas()
    assert len(got) == len(rows)
    kept = got[got.doc_id < 40]
    assert kept.kept.all() and (kept.left_words == kept.n_words - 5).all()
    assert not got[got.doc_id == 99].kept.any() and len(got[got.doc_id == 99]) == 2
    edge = got[got.doc_id >= 100]
    assert edge.base_failed.all() and not edge.kept.any()
    assert got[got.doc_id.isna()].kept.tolist() == [True]
    texts = {r.doc_id: r.text for r in line_rules.without_frequent_lines(docs).filter("doc_id < 40").collect()}
    assert texts == dict(enumerate(body))
    assert line_rules.quality_rules(docs.limit(0)).count() == 0


def mix_docs(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        source = ["a", "b", "c", None, "é", "z"][int(rng.choice(6, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05]))]
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 60))), source, 1, 2, "k"))
    rows += [(900, None, "a", 1, 2, "k"), (901, "", "only-empty", 1, 2, "k"), (902, " ".join(["w"] * 30_000), "a", 1, 2, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken int, key string")


@pytest.mark.parametrize("rows_per_range", [7, 4000])
def test_mix_meets_targets(spark, rows_per_range):
    docs = mix_docs(spark)
    got = mixing.mix(docs, rows_per_range=rows_per_range).select("doc.doc_id", "doc.source", "size", "source_size", "target", "taken").toPandas()
    assert len(got) == docs.count() and (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    got["source"] = got.source.fillna("~null")
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), n=("size", "sum"), given=("source_size", "first"))
    assert (per.n == per.given).all() and (per.taken - per.target).abs().max() <= 0.5001
    assert per.target.sum() == pytest.approx(got["size"].sum())
    names = sorted(per.index)  # '~null' is last
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    levels = [per.target[s] / weights[s] for s in names if per.target[s] < 3 * per.n[s] - 1e-9]
    assert max(levels) == pytest.approx(min(levels))
    assert all(per.target[s] / weights[s] <= max(levels) + 1e-9 for s in names)
    mixed = mixing.mixed(docs, rows_per_range=rows_per_range)
    assert mixed.columns == docs.columns
    words = mixed.select("doc_id", mixing.word_count(F.col("text")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).toPandas()
    assert dict(zip(words.doc_id, words.n)) == {i: t for i, t in zip(got.doc_id, got.taken) if t > 0}


def test_mix_of_nothing_and_of_repeated_rows(spark):
    docs = mix_docs(spark)
    assert mixing.mix(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c", "s")] * 4 + [(None, "d", "s"), (None, None, None)], "doc_id long, text string, source string")
    got = mixing.mix(twice).toPandas()
    assert len(got) == 6 and got.taken.sum() == 13
    pd.testing.assert_frame_equal(got, mixing.mix(twice).toPandas())
