"""Reductions, topics, word vectors, classifiers of ``pyspark.ml``, and model search."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.classification import NaiveBayes as MLNaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF,
    PCA,
    CountVectorizer,
    Normalizer,
    StandardScaler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.functions.numeric import argmax
from lexigrain.operators import machines, subtrees, trees, word_blocks
from lexigrain.operators.features import filter_tokens, fit_features
from lexigrain.operators.skip_grams import SkipGrams
from lexigrain.operators.splits import bootstrap
from lexigrain.operators.topics import TopicModel, Topics
from lexigrain.operators.vocab import top_tokens
from lexigrain.operators.word_blocks import WordBlocks
from lexigrain.session import persisted


def reduction(k: int, n_rows: int, n_features: int, features: str = "features") -> Pipeline:
    """Centre, then project on the first ``k`` principal components.

    ``k`` is clipped to the smaller of rows and features, and to at least 1. Centring is a stage of
    its own because the projection does not centre.
    """
    clipped = max(1, min(k, n_rows, n_features))
    centre = StandardScaler(
        withMean=True, withStd=False, inputCol=features, outputCol="centred"
    )
    return Pipeline(stages=[centre, PCA(k=clipped, inputCol="centred", outputCol="components")])


#: Distinct terms that a driver can hold as the vocabulary of a library model.
DRIVER_TERMS = 20_000_000


def count_vectors(df: DataFrame, tokens: str = "tokens", name: str = "counts") -> CountVectorizer:
    """Count vectors over every term of ``df``. The library keeps the vocabulary on the driver, so
    more terms than it can hold are an error, never left out."""
    n_terms = df.select(F.explode(tokens).alias("term")).distinct().count()
    if n_terms > DRIVER_TERMS:
        raise ValueError(f"{n_terms} terms are more than the driver holds ({DRIVER_TERMS})")
    return CountVectorizer(inputCol=tokens, outputCol=name, vocabSize=max(n_terms, 1))


def term_pipeline(df: DataFrame, tokens: str = "tokens") -> Pipeline:
    """Count vectors of all terms, weighted by IDF and scaled to length 1, in column ``features``."""
    counts = count_vectors(df, tokens)
    idf = IDF(inputCol="counts", outputCol="weighted")
    return Pipeline(stages=[counts, idf, Normalizer(inputCol="weighted", outputCol="features")])


def topic_model(topics: int = 5, seed: int = 0, iterations: int = 20) -> TopicModel:
    """Every iteration reads all documents; topics x words are a table, never on the driver or in one task."""
    return TopicModel(topics, seed, iterations)


def assign_topics(model: Topics, name: str = "topic") -> DataFrame:
    """Shares of the topics and the most probable one per row; ``model.on`` takes rows that it was not fitted on."""
    found = persisted(model.distributions(), "shares")
    return found.withColumn(name, argmax(F.col("topicDistribution")))


def topic_words(model: Topics, n: int = 10) -> DataFrame:
    """The strongest words of each topic: topics x n rows."""
    return persisted(model.words(n), "topic_words")


def word_vectors(
    tokens: str = "tokens",
    size: int = 100,
    window: int = 2,
    min_count: int = 1,
    seed: int = 0,
    partitions: int = 8,
) -> SkipGrams:
    """Training is spread over ``partitions`` tasks or more; no task and not the driver holds all words."""
    return SkipGrams(tokens, size, window, min_count, seed, partitions)


def mean_vectors(
    df: DataFrame, token_array: Column, vectors: DataFrame, size: int, doc_id: str = "doc_id", kind: str = "float64"
) -> DataFrame:
    """Mean of the known word vectors per document, zeros where there is none.

    ``vectors`` is a table (word, vector). Unknown words do not count, unlike in the model's own
    transformation, which divides by all words. A vector goes once to each block of documents that
    holds its word, as numbers of ``kind``; trained ones are ``float32``. Rows that repeat an id have the mean over
    all their words.
    """
    docs = df.filter(F.col(doc_id).isNotNull())
    blocks = WordBlocks.deal(docs, token_array, F.xxhash64(doc_id), [doc_id])
    known = vectors.select("word", vector_to_array("vector", kind).alias("x"))
    used = blocks.words().drop("rows").join(known, "word")
    schema = T.StructType([df.schema[doc_id], T.StructField("mean", T.ArrayType(T.DoubleType()))])

    def means(rows: pa.Table, known: pa.Table) -> pa.Table:
        ids, owner, at, n = word_blocks.entries(rows, doc_id, known["word"])
        x = word_blocks.stacked(known["x"])
        found, first = np.unique(owner, return_index=True)
        out, ends = np.empty((len(found), x.shape[1])), np.append(first, len(owner))[1:]
        for i, (lo, hi) in enumerate(zip(first, ends, strict=True)):
            out[i] = n[lo:hi] @ x[at[lo:hi]] / n[lo:hi].sum()
        return pa.table({doc_id: ids.take(pa.array(found)), "mean": word_blocks.ragged(out)})

    means_of = blocks.meet(used, means, schema)
    zeros = F.array_repeat(F.lit(0.0), size)
    return df.select(doc_id).join(means_of, doc_id, "left").select(
        doc_id, F.coalesce("mean", zeros).alias("mean")
    )


def mean_by_label(df: DataFrame, label: str, vector: Column) -> DataFrame:
    """Mean of each vector dimension per label, in long form."""
    rows = df.select(label, F.posexplode(vector).alias("dim", "value"))
    return rows.groupBy(label, "dim").agg(F.avg("value").alias("mean"))


def decision_tree(**settings: object) -> Estimator:
    return DecisionTreeClassifier(impurity="entropy", **settings)


def random_forest(trees: int = 200, max_depth: int = 3, seed: int = 0, **settings: object) -> Estimator:
    return RandomForestClassifier(numTrees=trees, maxDepth=max_depth, seed=seed, **settings)


def binary_svm(features: str = "features", label: str = "label", max_iter: int = 50) -> Estimator:
    """A linear machine for two classes on sparse vectors of any width; see ``machines`` for more classes."""
    return LinearSVC(featuresCol=features, labelCol=label, tol=1e-4, maxIter=max_iter)


def logistic_regression(n_rows: int, label: str = "label", **settings: object) -> Estimator:
    """Multinomial regression with a penalty that does not grow with the number of rows."""
    chosen = {"regParam": 1 / n_rows, "standardization": False, "tol": 1e-4} | settings
    return LogisticRegression(family="multinomial", labelCol=label, **chosen)


def naive_bayes(label: str = "label") -> Estimator:
    return MLNaiveBayes(modelType="multinomial", smoothing=1.0, labelCol=label)


def coefficient_terms(
    model: Model, vocabulary: Sequence[str], spark_df: DataFrame, n: int = 20, mean: bool = False
) -> DataFrame:
    """Terms with the largest coefficients per class, or of the mean over classes.

    The coefficient matrix lives on the driver already: classes x vocabulary of the fitted model.
    """
    matrix = model.coefficientMatrix.toArray()
    if mean:
        matrix = matrix.mean(axis=0, keepdims=True)
    rows = []
    for code, weights in enumerate(matrix):
        best = sorted(range(len(weights)), key=lambda i: (-weights[i], vocabulary[i]))[:n]
        rows += [(code, rk + 1, vocabulary[i], float(weights[i])) for rk, i in enumerate(best)]
    return spark_df.sparkSession.createDataFrame(
        rows, "code int, rk int, term string, coefficient double"
    )


def _accuracy(predictions: DataFrame, label: str) -> float:
    return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy").evaluate(predictions)


def _without_summary(fitted: Model) -> Model:
    """A copy, which leaves the training summary of trees and machines behind: that of two classes holds the
    session, which cannot be sent to tasks once a table was observed in it."""
    return fitted.copy()


def cross_validate(
    df: DataFrame, models: Mapping[str, Estimator], fold: str = "fold", folds: int = 5,
    label: str = "label", parallelism: int = 4,
) -> DataFrame:
    """Accuracy of every model on every held-out fold."""

    def run(point: tuple[str, int]) -> tuple[str, int, float]:
        name, held_out = point
        fitted = _without_summary(models[name].copy().fit(df.filter(F.col(fold) != held_out)))
        tested = fitted.transform(df.filter(F.col(fold) == held_out))
        return name, held_out, _accuracy(tested, label)

    with ThreadPool(parallelism) as pool:
        rows = pool.map(run, list(product(models, range(folds))), chunksize=1)
    return df.sparkSession.createDataFrame(
        rows, "model_name string, fold_idx int, accuracy double"
    )


def mean_accuracy(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model_name").agg(F.avg("accuracy").alias("accuracy"))


def compare(
    train: DataFrame, test: DataFrame, models: Mapping[str, Estimator], label: str = "label",
    parallelism: int = 4,
) -> DataFrame:
    """Accuracy of every model on one split."""

    def run(name: str) -> tuple[str, float]:
        return name, _accuracy(_without_summary(models[name].copy().fit(train)).transform(test), label)

    with ThreadPool(parallelism) as pool:
        rows = pool.map(run, list(models), chunksize=1)
    return train.sparkSession.createDataFrame(rows, "model_name string, accuracy double")


def _projections(
    vectors: DataFrame, width: int, widths: Sequence[int], longest: int
) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mean of the dense rows, and for each width the principal components of so many first features.

    One pass sums the products of all pairs of features; each width's covariance is a corner of it.
    Components are columns, as many as rows and features allow, largest entry positive.
    """

    def part(batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    found = machines.summed(vectors.select("features"), part, 1 + width + width * width)
    n, mean = found[0], found[1 : 1 + width] / max(found[0], 1)
    covariance = found[1 + width :].reshape(width, width) / max(n, 1) - np.outer(mean, mean)
    out = []
    for used in widths:
        _, axes = np.linalg.eigh(covariance[:used, :used])
        axes = axes[:, ::-1][:, : max(1, min(longest, int(n), used))]
        sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
        out.append(axes * np.where(sign == 0, 1, sign))
    return mean, out


def _projected(vectors: DataFrame, doc_id: str, label: str, mean: np.ndarray, axes: list[np.ndarray]) -> DataFrame:
    """``row_id, label, features``: the components of all widths, one after the other."""
    shared = vectors.sparkSession.sparkContext.broadcast((mean, axes))

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes = shared.value
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(mean))
            found = np.concatenate([(x - mean)[:, : len(a)] @ a for a in axes], axis=1)
            offsets = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
            column = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("label"), column], names=["row_id", "label", "features"]
            )

    rows = vectors.select(
        F.col(doc_id).cast("long").alias("row_id"), F.col(label).cast("int").alias("label"), "features"
    )
    return rows.mapInArrow(project, "row_id long, label int, features array<double>")


def _deep_forests(
    known: DataFrame, weights: DataFrame, n_classes: int, depth: int, columns: Sequence[tuple[int, int]]
) -> DataFrame:
    """Node tables of one forest per range of features, all grown to ``depth``."""
    width = max(end for _, end in columns)
    if known.count() * width <= subtrees.SHARED_CELLS:
        return persisted(subtrees.grow_shared(known, weights, n_classes, depth, columns), "forests")
    n_trees = weights.agg(F.max("tree_id")).first()[0] + 1
    grown = []
    for i, (first, end) in enumerate(columns):
        part = known.withColumn("features", F.slice("features", first + 1, end - first))
        nodes = trees.forest(part, weights, end - first, n_classes, depth)
        shifted = nodes.withColumn("tree_id", F.col("tree_id") + i * n_trees)
        grown.append(shifted.withColumn("feature_idx", F.col("feature_idx") + first))
    return reduce(DataFrame.unionByName, grown)


def _accuracies(
    asked: DataFrame, nodes: DataFrame, most: int, used: int, forests: int, depths: Sequence[int]
) -> dict[tuple[int, int], float]:
    """Accuracy of the first ``used`` of ``most`` trees of every forest, if trees ended at each depth."""
    tree, forest = F.col("tree_id") % most, F.floor(F.col("tree_id") / most)
    first = nodes.filter(tree < used).withColumn("tree_id", (forest * used + tree).cast("int"))
    judged = subtrees.forest_predictions(asked, first, depths, forests, ["label"])
    if judged is None:
        parts = []
        for i, depth in product(range(forests), depths):
            mine = nodes.filter((forest == i) & (tree < used)).withColumn("tree_id", tree.cast("int"))
            votes = trees.majority(trees.predict(asked, persisted(trees.cut(mine, depth), "cut"), "label"), "label")
            parts.append(votes.select(F.lit(i).alias("forest"), F.lit(depth).alias("depth"), "label", "predicted"))
        judged = reduce(DataFrame.unionByName, parts)
    right = F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy")
    return {(r.forest, r.depth): r.accuracy for r in judged.groupBy("forest", "depth").agg(right).collect()}


def grid_search(
    train: DataFrame,
    validation: DataFrame,
    token_array: Column,
    label: str,
    grid: Mapping[str, Sequence[int]],
    seed: int = 42,
    doc_id: str = "doc_id",
) -> DataFrame:
    """Validation accuracy of every grid point, with the best one marked; the first wins a tie.

    Label codes 0 to K-1 are in column ``label``. Shared between points: tokens are ranked once for the
    longest list, and per list one pass gives the covariance of the widest matrix, whose corners are
    those of narrower ones. Shorter projections are prefixes of the longest. Of the points that differ in
    projection and depth all forests are grown in one job, once, to the deepest level; a shallower tree is the
    same tree cut at its depth, and a smaller forest the first trees of the largest.
    """
    ranked = persisted(
        top_tokens(train, label, token_array, max(grid["top_tokens"]), doc_id), "ranked"
    )
    widest, longest = max(grid["top_features"]), max(grid["components"])
    depths, most = list(dict.fromkeys(grid["max_depth"])), max(grid["trees"])
    n_classes = train.agg(F.max(label)).first()[0] + 1
    keys = train.select(F.col(doc_id).cast("long").alias("row_id"))
    weights = persisted(bootstrap(keys, "row_id", most, seed), "weights")
    found: dict[tuple[int, ...], float] = {}
    for n_tokens in dict.fromkeys(grid["top_tokens"]):
        kept = ranked.filter(F.col("rk") <= n_tokens)
        parts = {}
        for name, part in (("train", train), ("validation", validation)):
            tokens = filter_tokens(part, token_array, kept, doc_id)
            parts[name] = persisted(part.select(doc_id, label).join(tokens, doc_id), name)
        fitted = fit_features(parts["train"], F.col("tokens"), widest, doc_id=doc_id)
        width = max(1, fitted.table.count())
        vectors = {}
        for name, part in parts.items():
            dense = fitted.vectors(part, F.col("tokens"), width, doc_id)
            vectors[name] = persisted(part.select(doc_id, label).join(dense, doc_id), name)
        features = list(dict.fromkeys(grid["top_features"]))
        mean, axes = _projections(vectors["train"], width, [min(n, width) for n in features], longest)
        rows = {n: persisted(_projected(v, doc_id, label, mean, axes), n) for n, v in vectors.items()}
        starts = np.cumsum([0] + [a.shape[1] for a in axes])
        columns, points = [], []
        for (i, n_features), k in product(enumerate(features), dict.fromkeys(grid["components"])):
            columns.append((int(starts[i]), int(starts[i]) + min(k, axes[i].shape[1])))
            points.append((n_tokens, n_features, k))
        nodes = _deep_forests(rows["train"], weights, n_classes, max(depths), columns)
        for used in dict.fromkeys(grid["trees"]):
            scores = _accuracies(rows["validation"], nodes, most, used, len(columns), depths)
            for i, depth in product(range(len(columns)), depths):
                found[(*points[i], depth, used)] = scores.get((i, depth), 0.0)
    order = list(product(*[grid[g] for g in GRID_NAMES]))
    rows_of = [(i, *point, found[point]) for i, point in enumerate(order)]
    schema = "place int, " + ", ".join(f"{g} int" for g in GRID_NAMES) + ", accuracy double"
    scores = train.sparkSession.createDataFrame(rows_of, schema)
    # one row per grid point
    best = F.row_number().over(Window.orderBy(F.col("accuracy").desc(), "place")) == 1
    return scores.withColumn("best", best)


GRID_NAMES = ["top_tokens", "top_features", "components", "max_depth", "trees"]
