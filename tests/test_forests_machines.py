"""Trees grown in tasks, forests cut at depths, the grid, and machines, against plain computations."""

from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lexigrain.operators import bayes, machines, models, splits, subtrees, trees
from lexigrain.plans.catalog import QUERIES
from lexigrain.session import persisted

# --- trees


def plain_entropy(labels):
    _, n = np.unique(labels, return_counts=True)
    return -sum(x / len(labels) * np.log2(x / len(labels)) for x in n) if len(labels) else 0.0


def plain_tree(values, labels, max_depth, node=0, depth=0):
    """Recursive growth on repeated rows: node id -> (feature, threshold, class counts)."""
    out = {node: (None, None, np.bincount(labels, minlength=3).tolist())}
    if depth == max_depth or len(set(labels)) < 2:
        return out
    best = None
    for f, q in product(range(values.shape[1]), (25, 50, 75)):
        t = np.percentile(values[:, f], q)
        low = values[:, f] < t
        h = sum(m.mean() * plain_entropy(labels[m]) for m in (low, ~low) if m.any())
        if best is None or round(h, 12) < best[0]:
            best = (round(h, 12), f, t, low)
    _, f, t, low = best
    if low.any() and not low.all():
        out[node] = (f, t, out[node][2])
        out |= plain_tree(values[low], labels[low], max_depth, 2 * node + 1, depth + 1)
        out |= plain_tree(values[~low], labels[~low], max_depth, 2 * node + 2, depth + 1)
    return out


def fixture(n=70, seed=1):
    rng = np.random.default_rng(seed)
    values = np.round(rng.normal(size=(n, 3)), 1)  # ties
    labels = (values[:, 0] * 2 + values[:, 1] + rng.normal(size=n) * 0.4 > 0).astype(int) + (values[:, 2] > 1)
    weights = rng.integers(0, 3, (4, n))
    return values, labels, weights


def frames(spark, values, labels, weights):
    rows = spark.createDataFrame(
        [(i, v, int(y)) for i, (v, y) in enumerate(zip(values.tolist(), labels))], "row_id long, features array<double>, label int"
    )
    drawn = [(t, i, int(w)) for t, ws in enumerate(weights) for i, w in enumerate(ws) if w]
    return rows, spark.createDataFrame(drawn, "tree_id int, row_id long, w long")


@pytest.mark.parametrize("way", ["shared", "local", "mixed", "levels"])
def test_every_way_of_growth_gives_the_plain_tree(spark, monkeypatch, way):
    values, labels, weights = fixture()
    rows, drawn = frames(spark, values, labels, weights)
    if way == "shared":
        nodes = trees.forest(rows, drawn, 3, 3, max_depth=6)
    else:
        monkeypatch.setattr(subtrees, "SHARED_CELLS", 0)
        limit = {"local": None, "mixed": 25, "levels": 0}[way]
        depth = 3 if way == "levels" else 6
        nodes = trees.forest(rows, drawn, 3, 3, max_depth=depth, local_rows=limit)
    got = nodes.toPandas()
    for t, w in enumerate(weights):
        at = np.repeat(np.arange(len(labels)), w)
        want = plain_tree(values[at], labels[at], 3 if way == "levels" else 6)
        mine = got[got.tree_id == t].set_index("node_id")
        assert set(mine.index) == set(want)
        for node, (feature, threshold, counts) in want.items():
            row = mine.loc[node]
            assert row.n == sum(counts)
            assert np.allclose(row.probs, np.array(counts) / sum(counts))
            assert bool(row.is_leaf) == (feature is None)
            if feature is not None:
                assert (row.feature_idx, row.threshold) == (feature, pytest.approx(threshold, abs=1e-12))


def test_a_deep_forest_cut_at_a_depth_votes_like_a_shallow_one(spark, monkeypatch):
    values, labels, weights = fixture(120, 2)
    rows, drawn = frames(spark, values, labels, weights[:, :].repeat(1, axis=0)[:, :120])
    deep = trees.forest(rows, drawn, 3, 3, max_depth=50)
    found = subtrees.forest_predictions(rows, deep, [0, 2, 5, 50]).toPandas()
    for depth in (0, 2, 5, 50):
        shallow = trees.forest(rows, drawn, 3, 3, max_depth=depth)
        joined = trees.majority(trees.predict(rows, shallow)).toPandas().set_index("row_id").predicted
        cut = trees.majority(trees.predict(rows, persisted(trees.cut(deep, depth), "cut"))).toPandas().set_index("row_id").predicted
        mine = found[found.depth == depth].set_index("row_id").predicted
        assert mine.sort_index().tolist() == joined.sort_index().tolist() == cut.sort_index().tolist()
    monkeypatch.setattr(subtrees, "SHARED_NODES", 3)
    assert subtrees.forest_predictions(rows, deep, [2]) is None
    assert trees.forest_votes(rows, deep, 50).count() == 120


def test_quartiles_of_weighted_rows_are_those_of_repeated_rows():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 50):
        values, weights = np.round(rng.normal(size=(n, 4)), 1), rng.integers(1, 5, n)
        want = np.percentile(np.repeat(values, weights, axis=0), [25, 50, 75], axis=0)
        assert np.allclose(subtrees.quartiles(values, weights), want)


def test_labels_outside_the_classes_fail():
    with pytest.raises(ValueError, match="labels"):
        subtrees.grow_node(0, 0, 0, np.zeros((1, 1)), np.array([3]), np.array([1]), 2, 1)


# --- the grid


def grid_documents():
    rng = np.random.default_rng(4)
    words = [["alpha", "beta", "gamma", "delta"], ["kappa", "omega", "sigma", "delta"]]
    rows = []
    for i in range(60):
        label = i % 2
        picked = [words[label if rng.random() < 0.8 else 1 - label][rng.integers(4)] for _ in range(rng.integers(1, 12))]
        rows.append((i, picked, label))
    return rows + [(60, [], 0)]


def test_every_grid_point_is_a_search_of_its_own(spark):
    docs = persisted(spark.createDataFrame(grid_documents(), "doc_id long, words array<string>, label int"), "docs")
    train, test = docs.filter("doc_id % 4 > 0"), docs.filter("doc_id % 4 = 0")
    grid = {"top_tokens": [2, 4], "top_features": [2, 7], "components": [1, 3], "max_depth": [1, 40], "trees": [2, 5]}
    whole = models.grid_search(train, test, F.col("words"), "label", grid).toPandas().sort_values("place")
    points = list(product(*[grid[g] for g in models.GRID_NAMES]))
    assert list(whole[models.GRID_NAMES].itertuples(index=False, name=None)) == points
    assert whole.best.sum() == 1 and whole[whole.best].index[0] == whole.accuracy.idxmax()
    for point in (points[0], points[9], points[22], points[-1]):
        alone = models.grid_search(train, test, F.col("words"), "label", {g: [v] for g, v in zip(models.GRID_NAMES, point)})
        # fewer trees are the first of the largest forest, and their draws do not depend on its size
        assert alone.first().accuracy == whole.set_index(models.GRID_NAMES).loc[point].accuracy


def test_projections_are_principal_components(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6)) * [5, 4, 3, 2, 1, 0.5] + 3
    vectors = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "doc_id long, features array<double>, label int")
    mean, axes = models._projections(vectors, 6, [3, 6], 2)
    for used, found in zip((3, 6), axes):
        _, _, want = np.linalg.svd(x[:, :used] - x[:, :used].mean(axis=0), full_matrices=False)
        assert np.allclose(np.abs(found.T), np.abs(want[:2]), atol=1e-6)
    got = models._projected(vectors, "doc_id", "label", mean, axes).toPandas().sort_values("row_id")
    assert np.allclose(np.array(got.features.tolist())[:, 2:], (x - x.mean(axis=0)) @ axes[1])


# --- machines


def machine_rows(spark, x, y):
    rows = [(i, v, int(k), i % 3) for i, (v, k) in enumerate(zip(x.tolist(), y))]
    return persisted(spark.createDataFrame(rows, "id long, features array<double>, label int, fold int").repartition(3), "rows")


def test_all_machines_are_at_their_minimum(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 4, 300)
    x = rng.normal(size=(300, 5)) * 3 + np.eye(5)[y] * 2 + 7
    x[:, 4] = 1.0  # a constant feature
    rows = machine_rows(spark, x, y)
    fitted = machines.fit(rows, 4, penalty=0.01)
    z = np.concatenate([(x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1), np.ones((300, 1))], axis=1)
    for k in range(4):
        w, sign = fitted.weights[0, k], np.where(y == k, 1, -1)
        slack = np.maximum(0, 1 - sign * (z @ w))
        gradient = -2 * (slack * sign) @ z / 300 + 0.01 * np.append(w[:-1], 0)
        assert np.abs(gradient).max() < 1e-5
    got = fitted.predict(rows, "id").toPandas().sort_values("id").prediction
    assert got.tolist() == (z @ fitted.weights[0].T).argmax(axis=1).tolist()
    with pytest.raises(Exception, match="labels must be"):
        machines.fit(rows, 3)


def test_machines_of_a_fold_are_those_of_the_other_folds_alone(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, 200)
    rows = machine_rows(spark, rng.normal(size=(200, 4)) + np.eye(4)[y], y)
    together = machines.fit(rows, 3, fold="fold", folds=3)
    for fold in range(3):
        alone = machines.fit(rows.filter(F.col("fold") != fold), 3)
        assert np.allclose(together.weights[fold], alone.weights[0], atol=1e-4)
    judged = together.predict(rows, "id", "label", "fold", fold="fold")
    scores = machines.fold_accuracy(judged, "svm").toPandas()
    assert sorted(scores.fold_idx) == [0, 1, 2] and scores.accuracy.between(0.3, 1).all()


def test_kernel_features_approach_the_kernel_and_separate_rings(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    mapped = machines.Fourier.draw(3, 4096, 0.5, 1)(x)
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(mapped @ mapped.T - kernel).max() < 0.1
    angle, y = rng.uniform(0, 6.28, 400), np.arange(400) % 2
    rings = np.stack([np.cos(angle), np.sin(angle)], axis=1) * (1 + y)[:, None] + rng.normal(size=(400, 2)) * 0.1
    rows = machine_rows(spark, rings, y)
    train, test = rows.filter("fold > 0"), rows.filter("fold = 0")
    right = {}
    for width in (0, 256):
        judged = machines.fit(train, 2, kernel_width=width).predict(test, "label")
        right[width] = judged.filter("prediction = label").count() / test.count()
    assert right[256] > 0.97 and right[0] < 0.75


def test_machines_without_rows_and_with_too_many_features(spark):
    none = spark.createDataFrame([], "id long, features array<double>, label int")
    assert machines.fit(none, 2).predict(none, "id").count() == 0
    one = spark.createDataFrame([(1, [0.0] * 3000, 0)], "id long, features array<double>, label int")
    with pytest.raises(ValueError, match="more than a driver holds"):
        machines.fit(one, 10)


def test_held_out_bayes_is_the_model_of_the_other_folds(spark):
    rows = [(i, ["ab"[i % 2], "abcd"[i % 4], "rare"] if i % 5 else [], "xy"[i % 2], i % 3) for i in range(40)]
    docs = persisted(spark.createDataFrame(rows, "doc_id long, words array<string>, label string, fold int"), "docs")
    got = bayes.predict_held_out(docs, "label", F.col("words")).toPandas().set_index("doc_id")
    for fold in range(3):
        model = bayes.fit_naive_bayes(docs.filter(F.col("fold") != fold), "label", F.col("words"))
        want = model.predict(docs.filter(F.col("fold") == fold), F.col("words")).toPandas()
        for r in want.itertuples():
            assert got.loc[r.doc_id].predicted == r.predicted
            assert got.loc[r.doc_id].score == pytest.approx(r.score, abs=1e-6)


def test_model_queries_one_after_the_other_in_one_session(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("t13_library_trees", "t14_linear_svm", "t25_model_comparison", "t24_cross_validation", "t15_kernel_svm"):
        assert isinstance(QUERIES[name](spark, folder).toPandas(), pd.DataFrame)
    kept = splits.bootstrap(spark.range(5).withColumnRenamed("id", "row_id"), "row_id", 2, 1)
    assert kept.agg(F.sum("w")).first()[0] == 10


def test_models_of_two_classes_are_judged_after_an_observation(spark):
    observed = Observation()
    spark.range(3).observe(observed, F.count(F.lit(1)).alias("n")).collect()
    assert observed.get == {"n": 3}
    rows = [(Vectors.dense([float(i % 2), 1.0 + i % 3]), float(i % 2), i % 2) for i in range(40)]
    df = persisted(spark.createDataFrame(rows, ["features", "label", "fold"]).select("features", "label", F.floor(F.rand(1) * 2).alias("fold")), "rows")
    chosen = {"forest": models.random_forest(3, 2), "machine": models.binary_svm(), "bayes": models.naive_bayes()}
    scores = {r.model_name: r.accuracy for r in models.compare(df, df, chosen).collect()}
    assert scores["forest"] == scores["machine"] == 1.0 and len(scores) == 3
    assert models.cross_validate(df, chosen, folds=2).count() == 6
