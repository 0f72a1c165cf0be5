"""Entropy-based decision trees and forests grown level by level.

All nodes of a level, over all trees, are split by the same few aggregates. Rows stay whole:
(tree_id, node_id, row_id, features ARRAY<DOUBLE>, label INT, w BIGINT), where ``w`` counts how often
a bootstrap sample holds the row. Classes are 0..K-1, children of node i are 2i+1 and 2i+2.

Each candidate threshold is a quartile of one feature inside one node. Quartiles are exact. A node
with many rows never meets in one task: values are first counted per value range, the ranges that
hold a quartile are found from the running totals, and only their distinct values are sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.functions.numeric import argmax, entropy
from lexigrain.operators import drawn_forests, subtrees
from lexigrain.operators.joins import lookup_join
from lexigrain.session import persisted, shuffle_width

NODE = ["tree_id", "node_id"]

# Rows of the largest node up to which all distinct values of one node may be sorted by one task.
NODE_LIMIT = 1_000_000


def class_counts(label: str, weight: str, n_classes: int) -> Column:
    """Aggregate: rows per class as an array with an entry for every class.

    A label outside 0..K-1 fails the job, as its rows would be in no class.
    """
    parts = [
        f"coalesce(sum(CASE WHEN {label} = {k} THEN {weight} END), 0)" for k in range(n_classes)
    ]
    outside = f"count_if({label} IS NULL OR NOT {label} BETWEEN 0 AND {n_classes - 1})"
    return F.expr(
        f"if({outside} > 0, raise_error('labels must be 0 to {n_classes - 1}'), array({', '.join(parts)}))"
    )


def _size(counts: str) -> Column:
    return F.expr(f"aggregate({counts}, 0L, (acc_, item_) -> acc_ + item_)")


def class_shares(counts: str) -> Column:
    return F.expr(f"transform({counts}, item_ -> item_ / aggregate({counts}, 0D, (acc_, other_) -> acc_ + other_))")


def present_class_shares(df: DataFrame, group: str, label: str) -> DataFrame:
    """Share of each class that occurs in a group."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    # one row per class of the group
    total = F.sum("n").over(Window.partitionBy(group))
    return counts.withColumn("share", F.col("n") / total)


def weighted_entropy(left: str, right: str) -> Column:
    """Entropy of two sides weighted by their rows; an empty side adds nothing."""
    n_left, n_right = _size(left), _size(right)
    n = n_left + n_right
    return entropy(left) * (n_left / n) + entropy(right) * (n_right / n)


def child_of(node: Column, value: Column, threshold: Column) -> Column:
    return F.when(value < threshold, node * 2 + 1).otherwise(node * 2 + 2)


def with_ranges(rows: DataFrame, n_features: int, ranges: int | None = None) -> DataFrame:
    """Add to each row the value range of every feature, cut at approximate quantiles.

    The ranges only divide the work; results do not depend on them. The driver gets features x
    ranges numbers.
    """
    n = ranges or max(256, shuffle_width(rows.sparkSession))
    names = [f"_f{i}" for i in range(n_features)]
    wide = rows.select("*", *[F.col("features")[i].alias(name) for i, name in enumerate(names)])
    limits = wide.approxQuantile(names, [i / n for i in range(1, n)], 0.5 / n)
    splits = [[float("-inf"), *sorted(set(found)), float("inf")] for found in limits]
    cut = Bucketizer(
        splitsArray=splits, inputCols=names, outputCols=[f"{c}r" for c in names]
    ).transform(wide)
    ranged = F.array(*[F.col(f"{c}r").cast("int") for c in names])
    return cut.select(*rows.columns, ranged.alias("ranges"))


# Zero-based ranks of the lower and upper neighbour of each quartile, given the group size.
_RANKS = [f"cast({end}((total - 1) * {q / 4}D) AS bigint)" for q in (1, 2, 3) for end in ("floor", "ceil")]
_FEATURE = [*NODE, "feature_idx"]


def _holds(start: str, rank: str) -> str:
    return f"{start} <= {rank} AND {rank} < {start} + n"


def _placed_by_range(assigned: DataFrame) -> DataFrame:
    """Distinct values around the quartiles, with the rows before their range."""
    pairs = F.arrays_zip(F.col("features").alias("value"), F.col("ranges").alias("range"))
    rows = assigned.select(*NODE, "w", F.posexplode(pairs).alias("feature_idx", "_p"))
    rows = rows.select(*_FEATURE, "w", "_p.value", "_p.range")
    counted = rows.groupBy(*_FEATURE, "range").agg(F.sum("w").alias("n"))
    running = Window.partitionBy(*_FEATURE).orderBy("range")
    placed = counted.select(
        *_FEATURE,
        "range",
        "n",
        (F.sum("n").over(running) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy(*_FEATURE)).alias("total"),
    )
    wanted = placed.filter(" OR ".join(f"({_holds('before', r)})" for r in _RANKS))
    return (
        lookup_join(rows, persisted(wanted, "ranges"), [*_FEATURE, "range"], "n", ["value"])
        .groupBy(*_FEATURE, "range", "before", "total", "value")
        .agg(F.sum("w").alias("n"))
    )


def _placed_by_node(assigned: DataFrame) -> DataFrame:
    """Distinct values of each node; for levels whose nodes are all small."""
    rows = assigned.select(*NODE, "w", F.posexplode("features").alias("feature_idx", "value"))
    counted = rows.groupBy(*_FEATURE, "value").agg(F.sum("w").alias("n"))
    return counted.select(
        *_FEATURE,
        F.lit(0).alias("range"),
        F.lit(0).alias("before"),
        F.sum("n").over(Window.partitionBy(*_FEATURE)).alias("total"),
        "value",
        "n",
    )


def node_quartiles(assigned: DataFrame) -> DataFrame:
    """Exact quartiles t1, t2, t3 of each feature in each node, linearly interpolated.

    With a column ``ranges`` the work of one task is bounded by a value range, else by a node.
    """
    by_range = "ranges" in assigned.columns
    values = _placed_by_range(assigned) if by_range else _placed_by_node(assigned)
    inside = Window.partitionBy(*_FEATURE, "range").orderBy("value")
    exact = values.withColumn("start", F.col("before") + F.sum("n").over(inside) - F.col("n"))
    neighbours = exact.groupBy(*_FEATURE, "total").agg(
        *[
            F.expr(f"max(CASE WHEN {_holds('start', r)} THEN value END)").alias(f"v{i}")
            for i, r in enumerate(_RANKS)
        ]
    )
    quartiles = [
        F.expr(f"v{i} + (v{i + 1} - v{i}) * ((total - 1) * {q / 4}D - floor((total - 1) * {q / 4}D))")
        .alias(f"t{q}")
        for q, i in ((1, 0), (2, 2), (3, 4))
    ]
    return neighbours.select(*_FEATURE, F.col("total").alias("n"), *quartiles)


def sketched_quartiles(assigned: DataFrame, accuracy: int = 1000) -> DataFrame:
    """Quartiles t1, t2, t3 of each feature in each node from mergeable sketches.

    Each is a value of the node whose rank is off by at most ``n / accuracy`` of the node's ``n``
    rows, a row counting ``w`` times. One pass and one exchange of sketches, of about ``accuracy``
    numbers per task, node and feature, whatever the rows; no value range is sorted.
    """
    times = F.explode(F.array_repeat(F.lit(1), F.col("w").cast("int")))
    rows = assigned.select(*NODE, "features", times.alias("_one"))
    values = rows.select(*NODE, F.posexplode("features").alias("feature_idx", "value"))
    sketched = values.groupBy(*_FEATURE).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("value", [0.25, 0.5, 0.75], accuracy).alias("t"),
    )
    return sketched.select(*_FEATURE, "n", *[F.get("t", F.lit(q - 1)).alias(f"t{q}") for q in (1, 2, 3)])


def split_candidates(
    assigned: DataFrame, quartiles: DataFrame, n_classes: int, n_nodes: int
) -> DataFrame:
    """Three candidates per node and feature with the class counts of both sides.

    ``n_nodes`` is the number of nodes in ``assigned``, or an upper bound.
    """
    cuts = F.array_sort(F.collect_list(F.struct("feature_idx", "t1", "t2", "t3")))
    per_node = quartiles.groupBy(*NODE, "n").agg(cuts.alias("cuts"))
    joined = lookup_join(assigned, per_node, NODE, "n", ["row_id"], lookup_rows=n_nodes)
    zipped = F.explode(F.arrays_zip(F.col("features").alias("v"), "cuts"))
    pairs = joined.select(*NODE, "label", "w", zipped.alias("p")).select(
        *NODE, "label", "w", "p.v", "p.cuts.*"
    )
    below = [
        F.expr(f"coalesce(sum(CASE WHEN v < t{q} THEN w END), 0)").alias(f"b{q}") for q in (1, 2, 3)
    ]
    key = [*_FEATURE, "t1", "t2", "t3"]
    counted = pairs.groupBy(*key, "label").agg(F.sum("w").alias("b0"), *below)
    # at most one row per class from here on
    per_feature = counted.groupBy(*key).agg(
        *[class_counts("label", f"b{q}", n_classes).alias(f"c{q}") for q in range(4)]
    )
    candidates = ", ".join(
        f"struct({q} AS quartile, t{q} AS threshold, c{q} AS left_counts, "
        f"zip_with(c0, c{q}, (a, b) -> a - b) AS right_counts)"
        for q in (1, 2, 3)
    )
    rows = per_feature.select(*_FEATURE, F.inline(F.expr(f"array({candidates})")))
    # sums of the same numbers in another order may differ in the last digits
    h = F.round(weighted_entropy("left_counts", "right_counts"), 12)
    return rows.withColumn("entropy", h)


def best_splits(candidates: DataFrame) -> DataFrame:
    """Smallest entropy per node; equal ones go to the lowest feature, then the lowest quartile."""
    parts = ["entropy", "feature_idx", "quartile", "threshold", "left_counts", "right_counts"]
    return candidates.groupBy(*NODE).agg(F.min(F.struct(*parts)).alias("s")).select(*NODE, "s.*")


def decide(
    nodes: DataFrame,
    splits: DataFrame,
    min_samples_leaf: int = 1,
    min_information_gain: float = 0.0,
) -> DataFrame:
    """Information gain of each node's best split and whether it is carried out."""
    joined = nodes.join(splits, NODE)
    gain = F.round(F.round(entropy("counts"), 12) - F.col("entropy"), 12)
    smaller = F.least(_size("left_counts"), _size("right_counts"))
    split = (smaller >= min_samples_leaf) & (F.col("gain") >= min_information_gain)
    return joined.withColumn("gain", gain).withColumn("is_leaf", ~split)


def _is_open(depth: Column, counts: str, max_depth: int, stop_on_pure: bool) -> Column:
    """Whether a node looks for a split at all."""
    open_node = depth < max_depth
    return open_node & (F.array_max(counts) < _size(counts)) if stop_on_pure else open_node


def grow(
    rows: DataFrame,
    n_features: int,
    n_classes: int,
    max_depth: int = 4,
    min_samples_leaf: int = 1,
    min_information_gain: float = 0.0,
    stop_on_pure: bool = True,
    node_limit: int = NODE_LIMIT,
    local_rows: int | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """Node table of one tree, or of all trees when ``rows`` has ``tree_id`` and ``w``.

    A node of at most ``local_rows`` rows (of ``subtrees.LOCAL_CELLS`` values by default) is grown
    to its end by one task, so only the levels of larger nodes are jobs of their own.

    Each level writes its splits and its remaining rows to the shared folder, which cuts the
    lineage. The driver sees the number of nodes still open and the size of the largest. While
    that is over ``node_limit`` rows, quartiles are found by value range. With ``accuracy`` the
    levels that are jobs take them from sketches instead, whose ranks are off by at most
    1 / ``accuracy``; nodes grown in a task stay exact. Leaves hold no split, since it would never
    be used.
    """
    if "tree_id" not in rows.columns:
        rows = rows.withColumn("tree_id", F.lit(0)).withColumn("w", F.lit(1).cast("bigint"))
    if local_rows is None:
        local_rows = subtrees.LOCAL_CELLS // max(n_features, 1)
    rules = {
        "min_samples_leaf": min_samples_leaf,
        "min_information_gain": min_information_gain,
        "stop_on_pure": stop_on_pure,
    }
    root = F.lit(0).cast("bigint").alias("node_id")
    assigned = persisted(
        rows.select("tree_id", root, "row_id", "features", "label", "w"), "assigned"
    )
    nodes = (
        assigned.groupBy(*NODE)
        .agg(class_counts("label", "w", n_classes).alias("counts"))
        .withColumn("depth", F.lit(0))
    )
    done = []
    for depth in range(max_depth + 1):
        can_split = _is_open(F.col("depth"), "counts", max_depth, stop_on_pure)
        done.append(_node_rows(nodes.filter(~can_split).withColumn("is_leaf", F.lit(True))))
        if depth == max_depth:
            break
        open_nodes = nodes.filter(can_split)
        n_open, largest = open_nodes.agg(F.count(F.lit(1)), F.max(_size("counts"))).first()
        if not n_open:
            break
        small = _size("counts") <= local_rows
        if largest <= local_rows:
            done.append(subtrees.grow_nodes(assigned.drop("ranges"), depth, n_classes, max_depth, **rules))
            break
        few = persisted(open_nodes.filter(small).select(*NODE, _size("counts").alias("n")), "few")
        if not few.isEmpty():
            theirs = lookup_join(assigned, few, NODE, "n", ["row_id"]).select(*assigned.columns)
            below = subtrees.grow_nodes(theirs.drop("ranges"), depth, n_classes, max_depth, **rules)
            done.append(persisted(below, "below"))
            open_nodes = open_nodes.filter(~small)
            many = persisted(open_nodes.select(*NODE, _size("counts").alias("n")), "many")
            assigned = persisted(
                lookup_join(assigned, many, NODE, "n", ["row_id"]).select(*assigned.columns), "assigned"
            )
        if accuracy is not None:
            quartiles = sketched_quartiles(assigned, accuracy)
        else:
            if largest > node_limit and "ranges" not in assigned.columns:
                assigned = persisted(with_ranges(assigned, n_features), "assigned")
            elif largest <= node_limit:
                assigned = assigned.drop("ranges")
            quartiles = node_quartiles(assigned)
        candidates = split_candidates(assigned, quartiles, n_classes, n_open)
        decided = persisted(
            decide(open_nodes, best_splits(candidates), min_samples_leaf, min_information_gain),
            "decided",
        )
        done.append(_node_rows(decided))
        split = decided.filter(~F.col("is_leaf"))
        nodes = _children(split, depth + 1)
        if depth + 1 < max_depth:
            moved = _move_rows(assigned, split, depth + 1, max_depth, stop_on_pure, n_open)
            assigned = persisted(moved, "assigned")
    return persisted(reduce(DataFrame.unionByName, done), "tree")


def _children(split: DataFrame, depth: int) -> DataFrame:
    sides = F.array(
        F.struct((F.col("node_id") * 2 + 1).alias("node_id"), F.col("left_counts").alias("counts")),
        F.struct((F.col("node_id") * 2 + 2).alias("node_id"), F.col("right_counts").alias("counts")),
    )
    return split.select("tree_id", F.inline(sides)).withColumn("depth", F.lit(depth))


def _move_rows(
    assigned: DataFrame,
    split: DataFrame,
    depth: int,
    max_depth: int,
    stop_on_pure: bool,
    n_nodes: int,
) -> DataFrame:
    """Send rows to the children of split nodes, keeping those whose node is still open."""
    at = F.lit(depth)
    lookup = split.select(
        *NODE,
        "feature_idx",
        "threshold",
        _size("counts").alias("n"),
        _is_open(at, "left_counts", max_depth, stop_on_pure).alias("left_open"),
        _is_open(at, "right_counts", max_depth, stop_on_pure).alias("right_open"),
    )
    joined = lookup_join(assigned, lookup, NODE, "n", ["row_id"], lookup_rows=n_nodes)
    value = F.element_at("features", F.col("feature_idx") + 1)
    open_side = F.when(value < F.col("threshold"), F.col("left_open")).otherwise(F.col("right_open"))
    moved = joined.filter(open_side).withColumn(
        "node_id", child_of(F.col("node_id"), value, F.col("threshold"))
    )
    return moved.select(*assigned.columns)


def _node_rows(nodes: DataFrame) -> DataFrame:
    filled = nodes
    for name, kind in (("feature_idx", "int"), ("threshold", "double"), ("gain", "double")):
        if name not in filled.columns:
            filled = filled.withColumn(name, F.lit(None).cast(kind))
    return filled.select(
        "tree_id", "node_id", "depth", "feature_idx", "threshold", "gain",
        class_shares("counts").alias("probs"), _size("counts").alias("n"), "is_leaf",
    )


def leaves_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The leaf of each row in each tree, with its class shares, from a stored node table."""
    trees, depth, n_nodes = nodes.agg(
        F.sum((F.col("node_id") == 0).cast("int")), F.max("depth"), F.count(F.lit(1))
    ).first()
    at = rows.withColumn(
        "tree_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    ).withColumn("node_id", F.lit(0).cast("bigint"))
    splits = nodes.filter(~F.col("is_leaf")).select(*NODE, "feature_idx", "threshold", "n")
    value = F.element_at("features", F.coalesce("feature_idx", F.lit(0)) + 1)
    for _ in range(depth):
        joined = lookup_join(
            at, splits, NODE, "n", ["row_id"], how="left", lookup_rows=n_nodes
        )
        child = child_of(F.col("node_id"), value, F.col("threshold"))
        at = joined.withColumn(
            "node_id", F.when(F.col("feature_idx").isNull(), F.col("node_id")).otherwise(child)
        ).drop("feature_idx", "threshold", "n")
    shares = nodes.select(*NODE, "probs", "n")
    return lookup_join(at, shares, NODE, "n", ["row_id"], lookup_rows=n_nodes).drop("n")


def predict(rows: DataFrame, nodes: DataFrame, *keep: str) -> DataFrame:
    """Most probable class of the leaf, per row and tree; the lowest class wins a tie.

    Rows descend inside the tasks that read them. Only if a single tree has more nodes than a task
    should hold are they joined with the nodes level by level.
    """
    inside = subtrees.tree_predictions(rows, nodes, keep)
    if inside is not None:
        return inside.select("row_id", *keep, "tree_id", "node_id", "predicted")
    found = leaves_of(rows, nodes).withColumn("predicted", argmax(F.col("probs")))
    return found.select("row_id", *keep, "tree_id", "node_id", "predicted")


def cut(nodes: DataFrame, depth: int) -> DataFrame:
    """The node table as if growth had ended at ``depth``: what lies deeper goes, its parents are leaves."""
    return nodes.filter(F.col("depth") <= depth).withColumn(
        "is_leaf", F.col("is_leaf") | (F.col("depth") == depth)
    )


def forest_votes(rows: DataFrame, nodes: DataFrame, max_depth: int, *keep: str) -> DataFrame:
    """``row_id, predicted``: the class most trees vote for, the lowest of equal ones.

    Trees of bounded size descend in arrays inside the tasks that read the rows; larger ones are joined level by level.
    """
    found = subtrees.forest_predictions(rows, nodes, [max_depth], keep=keep)
    if found is None:
        return majority(predict(rows, nodes, *keep), *keep)
    return found.select("row_id", *keep, "predicted")


def forest(
    rows: DataFrame, weights: DataFrame, n_features: int, n_classes: int, max_depth: int = 30, **rules
) -> DataFrame:
    """Node table of all trees, from ``row_id, features, label`` and bootstrap ``tree_id, row_id, w``.

    Rows of a bounded size are sent to every task, and only the weights are exchanged. Larger ones
    are stored once with the trees that drew them, and all trees share each pass over them until
    nodes are small (``drawn_forests``); only with sketched quartiles or limits of ``grow`` does
    every tree get rows of its own.
    """
    if rows.count() * n_features <= subtrees.SHARED_CELLS:
        return persisted(subtrees.grow_shared(rows, weights, n_classes, max_depth, **rules), "forest")
    # a stored table of draws is small on disk only, so it is never sent whole
    drawn = weights.select("tree_id", "row_id", "w").hint("merge")
    if "accuracy" in rules or "node_limit" in rules:
        joined = rows.select("row_id", "features", "label").join(drawn, "row_id")
        return grow(joined, n_features, n_classes, max_depth, **rules)
    labels = rows.select("row_id", "label").join(drawn, "row_id")
    roots = labels.groupBy("tree_id").agg(class_counts("label", "w", n_classes).alias("counts"))
    return drawn_forests.grow(rows, drawn, roots, n_features, n_classes, max_depth, **rules)


def vote_shares(votes: DataFrame, n_trees: int) -> DataFrame:
    """Share of the trees that vote for each class; classes without votes give no row."""
    counted = votes.groupBy("row_id", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.lit(n_trees))


def majority(votes: DataFrame, *keep: str) -> DataFrame:
    """Class with most votes per row; the lowest class wins a tie."""
    counted = votes.groupBy("row_id", *keep, "predicted").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("predicted", F.struct(F.col("n"), -F.col("predicted")))
    return counted.groupBy("row_id", *keep).agg(best.alias("predicted"))
