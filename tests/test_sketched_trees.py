"""Quartile sketches: the stated rank error, and trees grown with them."""

import numpy as np
import pytest

from lexigrain.operators import trees
from lexigrain.session import persisted

SCHEMA = "tree_id int, node_id long, row_id long, features array<double>, label int, w long"


def table(n=20_000):
    """Two trees, a hot node, repeated values, weights from 0 to 3."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        features = [float(rng.normal()), float(rng.integers(5)), float(np.exp(3 * rng.normal()))]
        node = 1 if i % 3 else int(rng.integers(2, 5))
        rows.append((i % 2, node, i, features, int(features[0] > 0.2), int(rng.integers(4))))
    return rows


@pytest.mark.parametrize("accuracy", [20, 200])
def test_ranks_are_within_the_stated_error(spark, accuracy):
    rows = table()
    assigned = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = trees.sketched_quartiles(assigned, accuracy).collect()
    values = {}
    for tree, node, _, features, _, w in rows:
        for f, v in enumerate(features):
            values.setdefault((tree, node, f), []).extend([v] * w)
    assert {(r.tree_id, r.node_id, r.feature_idx) for r in found} == set(values)
    assert len(found) == len(values)
    for r in found:
        here = np.array(values[r.tree_id, r.node_id, r.feature_idx])
        assert r.n == len(here)
        for q in (1, 2, 3):
            t = r[f"t{q}"]
            assert (here == t).any()
            low, high = (here < t).sum(), (here <= t).sum()
            target = q / 4 * len(here)
            assert max(low - target, target - high, 0) <= len(here) / accuracy + 1


def test_a_tree_grown_with_sketches_separates_the_classes(spark):
    rows = [(i, f, label) for _, _, i, f, label, _ in table(4000)]
    docs = persisted(spark.createDataFrame(rows, "row_id long, features array<double>, label int"), "rows")
    # without small nodes every level is a job of its own
    nodes = trees.grow(docs, 3, 2, max_depth=4, local_rows=0, accuracy=500).collect()
    root = next(r for r in nodes if r.node_id == 0)
    assert root.feature_idx == 0 and root.n == 4000
    ids = {r.node_id for r in nodes}
    for r in nodes:
        assert r.is_leaf or {2 * r.node_id + 1, 2 * r.node_id + 2} <= ids
    right = sum(max(r.probs) * r.n for r in nodes if r.is_leaf)
    assert sum(r.n for r in nodes if r.is_leaf) == 4000
    assert right / 4000 > 0.95


def test_no_rows(spark):
    assert trees.sketched_quartiles(spark.createDataFrame([], SCHEMA)).count() == 0
