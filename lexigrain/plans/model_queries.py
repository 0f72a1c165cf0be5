"""Queries that fit and apply models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain import sources
from lexigrain.functions import text
from lexigrain.functions.numeric import argmax
from lexigrain.functions.fixed_values import SEARCH_GRID
from lexigrain.operators import bayes, cooccurrence, features, labels, machines, models, scoring, splits, stats
from lexigrain.operators.topics import Topics
from lexigrain.plans import sql
from lexigrain.plans.registry import query
from lexigrain.session import colocate, persisted, shared_path, widen
from lexigrain.sources import json_ranges, read_table


#: Classes of the embeddings.
N_CLASSES = 10


def _texts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text", *columns)
    return colocate(docs, "doc_id")


def _clean() -> Column:
    return text.clean_tokens(F.col("text"))


def _embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """All 64 dimensions as a vector, the class as a number, and five folds."""
    vectors = widen(read_table(spark, folder, "embeddings"))
    ready = vectors.select(
        "vec_id",
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.col("label").cast("double").alias("label"),
    )
    return persisted(splits.stratified_folds(ready, "vec_id", "label"), "embeddings")


def _logits() -> Column:
    return F.slice(F.col("embedding"), 1, 10).cast("array<double>")


@query()
def e09_word_vectors(spark: SparkSession, folder: str) -> DataFrame:
    fitted = models.word_vectors().fit(_texts(spark, folder).select("doc_id", _clean().alias("tokens")))
    return fitted.getVectors().select("word", vector_to_array("vector").alias("vector"))


_PAIRS_SQL = f"""{sql.DOC_TOKENS},
        p AS (SELECT a.token AS term, b.token AS other FROM tok a JOIN tok b
                ON a.doc_id = b.doc_id AND b.pos IN (a.pos - 2, a.pos - 1, a.pos + 1, a.pos + 2)),
        c AS (SELECT term, other, count(*) AS n FROM p GROUP BY term, other)"""


@query(f"WITH {_PAIRS_SQL} SELECT * FROM c")
def e09_pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours of every word within two places."""
    return cooccurrence.pair_counts(_texts(spark, folder), _clean())


def _information(spark: SparkSession, folder: str) -> DataFrame:
    # documents are dealt out to blocks, so they are not exchanged by id before
    docs = widen(read_table(spark, folder, "documents").select("doc_id", "text"))
    counts = cooccurrence.pair_counts(docs, _clean(), sums=True)
    return cooccurrence.pair_information(counts, shift=2.0)


@query(
    f"""WITH {_PAIRS_SQL},
        m AS (SELECT term, sum(n)::DOUBLE AS n_term FROM c GROUP BY term),
        i AS (SELECT c.term, c.other, c.n, ln(c.n::DOUBLE) + ln((SELECT sum(n_term) FROM m)) - ln(a.n_term)
                     - ln(b.n_term) - ln(2::DOUBLE) AS weight
              FROM c JOIN m a ON c.term = a.term JOIN m b ON c.other = b.term)
        SELECT term, other, n, round(weight, 6) AS weight FROM i WHERE round(weight, 9) > 0"""
)
def e09_pair_information(spark: SparkSession, folder: str) -> DataFrame:
    return _information(spark, folder).withColumn("weight", F.round("weight", 6))


@query()
def e09_factor_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Word vectors of 100 numbers from the pairs of all texts."""
    return cooccurrence.factor_vectors(persisted(_information(spark, folder), "information"), 100)


@query()
def e10_mean_word_vectors(spark: SparkSession, folder: str) -> DataFrame:
    docs = persisted(_texts(spark, folder).select("doc_id", _clean().alias("tokens")), "tokens")
    fitted = models.word_vectors().fit(docs)
    return models.mean_vectors(docs, F.col("tokens"), fitted.getVectors(), 100, kind="float32")


@query(
    f"""WITH {sql.DOC_TOKENS},
        m AS (SELECT doc_id, avg(CAST(ascii(token) % 7 AS DOUBLE)) AS a, avg(CAST(length(token) AS DOUBLE)) AS b
              FROM tok WHERE length(token) <> 3 GROUP BY doc_id)
        SELECT d.doc_id, round(coalesce(a, 0), 9) AS first, round(coalesce(b, 0), 9) AS second
        FROM documents d LEFT JOIN m USING (doc_id)"""
)
def e10_mean_of_given_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vectors from a table of word vectors; words of three letters are unknown to it."""
    docs = _texts(spark, folder)
    given = docs.select(F.explode(_clean()).alias("word")).filter(F.length("word") != 3).distinct()
    numbers = F.array((F.ascii("word") % 7).cast("double"), F.length("word").cast("double"))
    table = persisted(given.select("word", array_to_vector(numbers).alias("vector")), "words")
    mean = models.mean_vectors(docs, _clean(), table, 2)
    return mean.select(
        "doc_id", F.round(F.get("mean", F.lit(0)), 9).alias("first"), F.round(F.get("mean", F.lit(1)), 9).alias("second")
    )


@query(
    """SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM (
         SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings)
       GROUP BY label, dim"""
)
def e10_mean_vectors_by_label(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    means = models.mean_by_label(vectors, "label", F.col("embedding").cast("array<double>"))
    return means.withColumn("mean", F.round("mean", 6))


@query()
def e11_principal_components(spark: SparkSession, folder: str) -> DataFrame:
    docs = widen(read_table(spark, folder, "documents").select("doc_id", "text"))
    cleaned = persisted(docs.select("doc_id", _clean().alias("tokens")), "tokens")
    fitted = features.fit_features(cleaned, F.col("tokens"), 150)
    dense = persisted(fitted.vectors(cleaned, F.col("tokens"), fitted.table.count()), "dense")
    width = fitted.table.count()
    rows = features.as_vectors(dense)
    reduced = models.reduction(20, dense.count(), width).fit(rows).transform(rows)
    return reduced.select("doc_id", vector_to_array("components").alias("components"))


@query(
    """WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS d
                  FROM embeddings),
            c AS (SELECT vec_id, v - avg(v) OVER (PARTITION BY d) AS v FROM x)
       SELECT vec_id, round(sqrt(sum(v * v)), 6) AS length FROM c GROUP BY vec_id"""
)
def e11_component_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """With all components kept, a projected row is as long as the centred one."""
    rows = _embeddings(spark, folder).select("vec_id", "features")
    reduced = models.reduction(64, rows.count(), 64).fit(rows).transform(rows)
    square = F.aggregate(
        vector_to_array("components"), F.lit(0.0), lambda total, x: total + x * x
    )
    return reduced.select("vec_id", F.round(F.sqrt(square), 6).alias("length"))


def _topics(spark: SparkSession, folder: str) -> Topics:
    # documents are dealt out to blocks, so they are not exchanged by id before
    docs = widen(read_table(spark, folder, "documents").select("doc_id", "text", "lang")).select(
        "doc_id", "lang", text.long_words(F.col("text"), text.ENGLISH_STOP_WORDS).alias("tokens")
    )
    return models.topic_model().fit(docs, "tokens", ["doc_id", "lang"])


@query()
def e12_topic_distribution(spark: SparkSession, folder: str) -> DataFrame:
    found = _topics(spark, folder).distributions()
    return found.select("doc_id", F.col("topicDistribution").alias("shares"))


@query()
def e13_topic_of_document(spark: SparkSession, folder: str) -> DataFrame:
    return models.assign_topics(_topics(spark, folder)).select("doc_id", "topic")


@query()
def d16_topic_words(spark: SparkSession, folder: str) -> DataFrame:
    return models.topic_words(_topics(spark, folder))


@query()
def d10_topics_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """Named topics against languages, zeros filled in."""
    fitted = _topics(spark, folder)
    found, words = models.assign_topics(fitted), models.topic_words(fitted)
    pairs = F.array_sort(F.collect_list(F.struct("rk", "term")))
    lists = words.groupBy("topic").agg(F.transform(pairs, lambda p: p["term"]).alias("w"))
    named = persisted(
        lists.select("topic", text.topic_name(F.col("topic"), F.col("w")).alias("name")), "names"
    )
    # one row per topic
    labelled = found.select("topic", "lang").join(F.broadcast(named), "topic")
    return stats.cross_tab(labelled, "name", "lang", stats.class_values(found, "lang"))


@query(
    """WITH k AS (SELECT doc_id, length(text) % 5 AS topic FROM documents)
       SELECT doc_id, 'Topic ' || topic AS name FROM k"""
)
def e14_topic_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Names joined to topic numbers; the number is derived from the text length here."""
    docs = read_table(spark, folder, "documents").select(
        "doc_id", (F.length("text") % 5).alias("topic")
    )
    names = docs.groupBy("topic").agg(F.count(F.lit(1)).alias("n_rows"))
    named = names.withColumn("name", F.concat(F.lit("Topic "), F.col("topic").cast("string")))
    return labels.decode(docs, persisted(named, "names"), "topic").drop("topic")


@query()
def t13_library_trees(spark: SparkSession, folder: str) -> DataFrame:
    rows = _embeddings(spark, folder)
    fitted = {
        "tree": models.decision_tree(maxDepth=20),
        "forest": models.random_forest(200, 3),
    }
    return models.compare(rows.filter("fold > 0"), rows.filter("fold = 0"), fitted)


@query("SELECT CAST(label AS INTEGER) AS label, round(CAST(count(*) AS DOUBLE), 3) AS total FROM embeddings GROUP BY label")
def t13_tree_class_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves give the shares of their training rows, so these add up to the classes."""
    rows = _embeddings(spark, folder)
    fitted = models.decision_tree(maxDepth=8).fit(rows)
    shares = fitted.transform(rows).select(
        F.posexplode(vector_to_array("probability")).alias("label", "p")
    )
    return shares.groupBy("label").agg(F.round(F.sum("p"), 3).alias("total"))


def _arrays(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", vector_to_array("features"))


@query()
def t14_linear_svm(spark: SparkSession, folder: str) -> DataFrame:
    """One linear machine per class, all of them fitted in the same passes."""
    rows = _arrays(_embeddings(spark, folder))
    fitted = machines.fit(rows.filter("fold > 0"), N_CLASSES)
    return fitted.predict(rows.filter("fold = 0"), "vec_id", "label")


@query()
def t15_kernel_svm(spark: SparkSession, folder: str) -> DataFrame:
    """Machines on 512 random Fourier features of the radial kernel."""
    rows = _arrays(_embeddings(spark, folder))
    fitted = machines.fit(rows.filter("fold > 0"), N_CLASSES, kernel_width=512, seed=42)
    return fitted.predict(rows.filter("fold = 0"), "vec_id", "label")


_NB = f"""{sql.DOC_TOKENS},
    c AS (SELECT lang, token AS term, count(*) AS c FROM tok GROUP BY ALL),
    v AS (SELECT count(DISTINCT term) AS v FROM c),
    k AS (SELECT lang, n_docs, coalesce(n, 0) AS n FROM
            (SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang)
            LEFT JOIN (SELECT lang, sum(c) AS n FROM c GROUP BY lang) USING (lang)),
    t AS (SELECT doc_id, token AS term, count(*) AS n FROM tok GROUP BY ALL),
    m AS (SELECT doc_id, c.lang, sum(t.n * ln(c + 1)) AS s FROM t JOIN c USING (term) GROUP BY ALL),
    p AS (SELECT d.doc_id, k.lang, round(ln(n_docs / (SELECT count(*) FROM documents))
                 + coalesce(s, 0) - len(toks) * ln(k.n + v), 6) AS score
          FROM cleaned d CROSS JOIN k CROSS JOIN v LEFT JOIN m ON m.doc_id = d.doc_id AND m.lang = k.lang)"""


@query(
    f"""WITH {_NB} SELECT doc_id, lang AS predicted, round(score, 4) AS score FROM p
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1"""
)
def t16_naive_bayes(spark: SparkSession, folder: str) -> DataFrame:
    docs = _texts(spark, folder, "lang")
    fitted = bayes.fit_naive_bayes(docs, "lang", _clean())
    return fitted.predict(docs, _clean()).withColumn("score", F.round("score", 4))


@query()
def t17_logistic_regression(spark: SparkSession, folder: str) -> DataFrame:
    rows = _embeddings(spark, folder)
    train = rows.filter("fold > 0")
    fitted = models.logistic_regression(train.count()).fit(train)
    return fitted.transform(rows.filter("fold = 0")).select("vec_id", "label", "prediction")


@query("SELECT CAST(label AS INTEGER) AS label, round(CAST(count(*) AS DOUBLE), 3) AS total FROM embeddings GROUP BY label")
def t17_class_totals(spark: SparkSession, folder: str) -> DataFrame:
    """At the optimum the predicted probabilities of a class add up to its rows, as intercepts bear
    no penalty."""
    rows = _embeddings(spark, folder)
    fitted = models.logistic_regression(rows.count(), tol=1e-10, maxIter=1000).fit(rows)
    shares = fitted.transform(rows).select(
        F.posexplode(vector_to_array("probability")).alias("label", "p")
    )
    return shares.groupBy("label").agg(F.round(F.sum("p"), 3).alias("total"))


@query(
    f"""WITH {sql.DOC_TOKENS},
        c AS (SELECT lang, token AS term, count(*) AS c FROM tok GROUP BY ALL),
        s AS (SELECT lang, term, c, sum(c) OVER (PARTITION BY term) AS a,
                     sum(c) OVER (PARTITION BY lang) AS n, sum(c) OVER () AS t,
                     (SELECT count(DISTINCT term) FROM c) AS v FROM c),
        o AS (SELECT lang, term, round(ln((c + 1) / (n + v)) - ln((a - c + 1) / (t - n + v)), 9) AS score FROM s)
        SELECT lang, term, round(score, 6) AS score, CAST(row_number() OVER w AS INTEGER) AS rk FROM o
        WINDOW w AS (PARTITION BY lang ORDER BY o.score DESC, term) QUALIFY row_number() OVER w <= 20"""
)
def t18_predictive_terms(spark: SparkSession, folder: str) -> DataFrame:
    docs = widen(read_table(spark, folder, "documents").select("lang", "text"))
    return bayes.predictive_terms(docs, "lang", _clean(), 20).withColumn(
        "score", F.round("score", 6)
    )


@query()
def t18_coefficient_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms by the coefficients of a regression on count vectors."""
    docs = _texts(spark, folder, "lang")
    coded = labels.encode(docs, labels.category_codes(docs, "lang", "label"), "lang", "label")
    words = text.long_words(F.col("text"), text.ENGLISH_STOP_WORDS)
    rows = persisted(coded.select("label", words.alias("tokens")), "tokens")
    counts = models.count_vectors(rows, "tokens", "features").fit(rows)
    fitted = models.logistic_regression(rows.count(), maxIter=1000).fit(counts.transform(rows))
    return models.coefficient_terms(fitted, counts.vocabulary, rows)


@query()
def t19_class_weighted_training(spark: SparkSession, folder: str) -> DataFrame:
    rows = _embeddings(spark, folder)
    train = rows.filter("fold > 0")
    weights = persisted(labels.class_weights(train, "label").select("label", "weight"), "weights")
    # one row per class
    weighted = train.join(F.broadcast(weights), "label")
    settings = {"weightCol": "weight"}
    return models.compare(
        weighted,
        rows.filter("fold = 0"),
        {
            "forest": models.random_forest(200, 3, **settings),
            "regression": models.logistic_regression(train.count(), **settings),
        },
    )


@query(
    """WITH f AS (SELECT label, count(*) AS n, count(*) / (SELECT count(*) FROM embeddings) AS freq
                  FROM embeddings GROUP BY label),
            w AS (SELECT label, n, (1 / freq) / sum(1 / freq) OVER () AS weight FROM f)
       SELECT CAST(label AS INTEGER) AS label, round(n * weight, 3) AS total FROM w"""
)
def t19_weighted_class_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted probabilities of a class add up to its weighted rows."""
    rows = _embeddings(spark, folder)
    weights = persisted(labels.class_weights(rows, "label").select("label", "weight"), "weights")
    # one row per class
    weighted = persisted(rows.join(F.broadcast(weights), "label"), "weighted")
    settings = {"weightCol": "weight", "tol": 1e-10, "maxIter": 1000}
    fitted = models.logistic_regression(rows.count(), **settings).fit(weighted)
    shares = fitted.transform(weighted).select(
        "weight", F.posexplode(vector_to_array("probability")).alias("label", "p")
    )
    return shares.groupBy("label").agg(F.round(F.sum(F.col("p") * F.col("weight")), 3).alias("total"))


@query(
    """WITH f AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings) AS freq FROM embeddings GROUP BY label),
            w AS (SELECT label, (1 / freq) / sum(1 / freq) OVER () AS weight FROM f),
            x AS (SELECT vec_id, label, CAST(embedding[1:10] AS DOUBLE[]) AS l FROM embeddings),
            e AS (SELECT label, ln(list_sum(list_transform(l, lambda v: exp(v)))) - l[label + 1] AS nll FROM x)
       SELECT round(sum(weight * nll) / sum(weight), 6) AS loss FROM e JOIN w USING (label)"""
)
def t20_weighted_cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings")
    weights = persisted(
        labels.class_weights(rows, "label").select("label", "weight", "n"), "weights"
    )
    loss = scoring.weighted_cross_entropy(rows, _logits(), "label", weights)
    return loss.withColumn("loss", F.round("loss", 6))


@query(
    """SELECT vec_id, CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INTEGER) AS predicted
       FROM embeddings"""
)
def t21_predicted_class(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings")
    return rows.select("vec_id", argmax(_logits()).alias("predicted"))


LETTERS = ["ü", "w", "ñ", "ê"]


def letter_scorer() -> Callable[[list[str]], np.ndarray]:
    """A small stand-in for a user's model: one logit per letter, its count in the text."""

    def score(batch: list[str]) -> np.ndarray:
        return np.array([[t.count(letter) for letter in LETTERS] for t in batch])

    return score


_COUNTS = ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in LETTERS)


@query(
    f"""WITH t AS (SELECT doc_id, [{_COUNTS}] AS l FROM documents)
        SELECT doc_id, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS predicted FROM t"""
)
def t22_batched_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = widen(read_table(spark, folder, "documents").select("doc_id", "text"))
    scored = scoring.score_texts(docs, letter_scorer, max_tokens=None)
    return scored.select("doc_id", argmax(F.col("logits")).alias("predicted"))


def _coded(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the toxicity-independent quality rating as class, where rated."""
    rated = read_table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return persisted(colocate(docs.join(rated, "doc_id"), "doc_id"), "rated")


@query()
def t23_grid_search(spark: SparkSession, folder: str) -> DataFrame:
    """All 288 points of the grid."""
    parts = splits.random_split(_coded(spark, folder), "doc_id", 42)
    return models.grid_search(
        parts.filter("split = 'train'"), parts.filter("split = 'test'"), _clean(), "label", SEARCH_GRID
    )


@query()
def t24_cross_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of three models on five folds; the linear machines of all folds share their passes."""
    rows = _embeddings(spark, folder)
    others = {
        "RandomForest": models.random_forest(200, 3),
        "LogisticRegression": models.logistic_regression(rows.count()),
    }
    scores = models.cross_validate(rows, others)
    dense = _arrays(rows)
    fitted = machines.fit(dense, N_CLASSES, fold="fold", folds=5)
    judged = fitted.predict(dense, "vec_id", "label", "fold", fold="fold")
    return scores.unionByName(machines.fold_accuracy(judged, "LinearSVM"))


_HELD_NB = f"""{sql.DOC_TOKENS},
    ranked AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn,
                      count(*) OVER (PARTITION BY lang) AS size FROM documents),
    folds AS (SELECT doc_id, CAST(CASE WHEN rn < (size % 5) * (size // 5 + 1) THEN rn // (size // 5 + 1)
                ELSE (size % 5) + (rn - (size % 5) * (size // 5 + 1)) // greatest(size // 5, 1) END AS INTEGER) AS fold
              FROM ranked),
    k AS (SELECT fold AS held, doc_id FROM folds),
    h AS (SELECT DISTINCT fold AS held FROM folds),
    c AS (SELECT held, lang, token AS term, count(*) AS c FROM tok JOIN folds USING (doc_id) JOIN h ON held <> fold GROUP BY ALL),
    v AS (SELECT held, count(DISTINCT term) AS v FROM c GROUP BY held),
    n AS (SELECT held, lang, count(*) AS n_docs FROM documents JOIN folds USING (doc_id) JOIN h ON held <> fold GROUP BY ALL),
    a AS (SELECT held, sum(n_docs) AS all_docs FROM n GROUP BY held),
    s AS (SELECT held, lang, sum(c) AS n FROM c GROUP BY ALL),
    classes AS (SELECT n.held, n.lang, ln(n_docs / all_docs) AS prior, ln(coalesce(s.n, 0) + v) AS total
                FROM n JOIN a USING (held) LEFT JOIN s USING (held, lang) JOIN v USING (held)),
    t AS (SELECT doc_id, held, token AS term, count(*) AS n FROM tok JOIN k USING (doc_id)
          WHERE EXISTS (SELECT 1 FROM c WHERE c.held = k.held AND c.term = tok.token) GROUP BY ALL),
    l AS (SELECT doc_id, sum(n) AS len FROM t GROUP BY doc_id),
    m AS (SELECT doc_id, c.lang, sum(t.n * ln(c + 1)) AS s FROM t JOIN c USING (held, term) GROUP BY ALL),
    p AS (SELECT k.doc_id, k.held, classes.lang,
                 round(prior + coalesce(m.s, 0) - coalesce(len, 0) * total, 6) AS score
          FROM k JOIN classes USING (held) LEFT JOIN m ON m.doc_id = k.doc_id AND m.lang = classes.lang
          LEFT JOIN l ON l.doc_id = k.doc_id)"""


@query(
    f"""WITH {_HELD_NB} SELECT doc_id, held AS fold, lang AS predicted, round(score, 4) AS score FROM p
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p.score DESC, lang) = 1"""
)
def t24_bayes_by_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Every document judged by the naive Bayes model of the other four folds."""
    docs = persisted(splits.stratified_folds(_texts(spark, folder, "lang"), "doc_id", "lang"), "folds")
    judged = bayes.predict_held_out(docs, "lang", _clean())
    return judged.select("doc_id", F.col("fold").cast("int").alias("fold"), "predicted", F.round("score", 4).alias("score"))


@query()
def d12_mean_accuracy_per_model(spark: SparkSession, folder: str) -> DataFrame:
    return models.mean_accuracy(t24_cross_validation(spark, folder))


@query()
def t25_model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Forest, linear machine and naive Bayes on one split of TF-IDF vectors."""
    rated = _coded(spark, folder).select(
        "doc_id", "label", text.tidy_words(text.words(F.col("text"))).alias("tokens")
    )
    stored = persisted(splits.random_split(rated, "doc_id", 42), "tokens")
    train = stored.filter("split = 'train'")
    vectoriser = models.term_pipeline(train).fit(train)
    ready = persisted(
        vectoriser.transform(stored).select("doc_id", "label", "split", "features"), "vectors"
    )
    chosen = {
        "RandomForest": models.random_forest(200, 3),
        "LinearSVM": models.binary_svm(),
        "NaiveBayes": models.naive_bayes(),
    }
    return models.compare(
        ready.filter("split = 'train'"), ready.filter("split = 'test'"), chosen
    )


# Sources and sinks: the given tables are written in the other formats and read back.


@query("SELECT doc_id, text, lang FROM documents")
def a01_json_array_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each part file holds one JSON array, so parts are parsed side by side in one flat folder."""
    docs = widen(read_table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return sources.read_json_array(spark, _array_files(spark, docs), docs.schema)


def _array_files(spark: SparkSession, docs: DataFrame) -> str:
    """Documents as files that each hold an array of 1,000."""
    batch = splits.batches(docs.select("doc_id"), "doc_id", 1_000)
    record = F.struct("doc_id", "text", "lang")
    arrays = (
        docs.join(batch, "doc_id")
        .groupBy("batch")
        .agg(F.to_json(F.collect_list(record)).alias("value"))
    )
    path = shared_path(spark, "json_array")
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("SELECT doc_id, text, lang FROM documents")
def a01_large_json_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays of 1,000 documents, each read by several tasks from ranges of 256 KB."""
    docs = widen(read_table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return json_ranges.read_large_json_array(spark, _array_files(spark, docs), docs.schema, 256 << 10)


@query("SELECT doc_id, text, lang FROM documents")
def a02_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = widen(read_table(spark, folder, "documents").select("doc_id", "text", "lang"))
    path = shared_path(spark, "json_lines")
    docs.write.json(path)
    return sources.read_json_lines(spark, path, docs.schema)


@query(
    f"""WITH {sql.DOC_TOKENS},
        stop AS (SELECT token FROM tok GROUP BY token ORDER BY count(*) DESC, token LIMIT 20)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM tok
        WHERE token NOT IN (SELECT token FROM stop) GROUP BY doc_id"""
)
def a03_stop_word_file(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens left after the twenty most frequent ones went to a stop-word file and back."""
    docs = widen(read_table(spark, folder, "documents").select("doc_id", "text"))
    tokens = docs.select("doc_id", F.explode(_clean()).alias("token"))
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    path = shared_path(spark, "stop_words")
    counted.orderBy(F.col("n").desc(), "token").limit(20).select("token").write.text(path)
    left = tokens.filter(~F.col("token").isin(sources.read_stop_words(spark, path)))
    return left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang")
def a05_written_metrics(spark: SparkSession, folder: str) -> DataFrame:
    counted = stats.label_counts(read_table(spark, folder, "documents"), "lang")
    path = shared_path(spark, "metrics")
    sources.write_metrics(counted, path)
    return sources.read_json_lines(spark, path, counted.schema)


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS ids FROM documents")
def a06_read_table(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return docs.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")
    )


@query()
def a04_saved_model(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of a regression after it was stored and loaded."""
    rows = _embeddings(spark, folder)
    train = rows.filter("fold > 0")
    fitted = Pipeline(stages=[models.logistic_regression(train.count())]).fit(train)
    path = shared_path(spark, "model")
    sources.save_model(fitted, path)
    loaded = sources.load_model(path)
    return loaded.transform(rows.filter("fold = 0")).select("vec_id", "label", "prediction")
