"""Splits, shuffles, bootstrap samples, folds and batches, all reproducible from a seed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.numeric import poisson_one, uniform
from lexigrain.operators.joins import lookup_join
from lexigrain.operators.labels import category_codes
from lexigrain.operators.ranking import ordinal

THREE_WAY = {"train": 0.6, "validation": 0.8, "test": 1.0}


def _part(place: Column, size: Column, parts: Mapping[str, float]) -> Column:
    names = list(parts)
    chosen = F.lit(names[-1])
    for name in reversed(names[:-1]):
        chosen = F.when(place <= F.floor(size * F.lit(parts[name])), name).otherwise(chosen)
    return chosen


def positional_split(
    df: DataFrame, key: str, parts: Mapping[str, float] = THREE_WAY, name: str = "split"
) -> DataFrame:
    """Cut the rows in key order at the given cumulative shares, rounded down."""
    ranked = ordinal(df, key, name="_rn", size_name="_size")
    return ranked.withColumn(name, _part(F.col("_rn"), F.col("_size"), parts)).drop("_rn", "_size")


def random_split(
    df: DataFrame, key: str, seed: int, share: float = 0.8, name: str = "split"
) -> DataFrame:
    """Each row falls into train with the given probability; no shuffle."""
    return df.withColumn(
        name, F.when(uniform(F.col(key), seed) < share, "train").otherwise("test")
    )


def exact_random_split(
    df: DataFrame, key: str, seed: int, share: float = 0.8, name: str = "split"
) -> DataFrame:
    """A random split whose train part has exactly the given share, rounded down."""
    ranked = shuffled(df, key, seed, name="_rn", size_name="_size")
    parts = {"train": share, "test": 1.0}
    return ranked.withColumn(name, _part(F.col("_rn"), F.col("_size"), parts)).drop("_rn", "_size")


def shuffled(
    df: DataFrame, key: str, seed: int, name: str = "place", size_name: str | None = None
) -> DataFrame:
    """The place of each row in a seeded random order."""
    drawn = df.withColumn("_u", uniform(F.col(key), seed))
    return ordinal(
        drawn, "_u", name=name, size_name=size_name, unit_interval=True, then=[key]
    ).drop("_u")


def _per_tree(df: DataFrame, trees: int) -> DataFrame:
    return df.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))


def bootstrap(df: DataFrame, key: str, trees: int, seed: int, name: str = "w") -> DataFrame:
    """For each tree, n draws with replacement from n rows, as a count per drawn row.

    Draw number d of a tree picks the row at place floor(u * n) in key order. Draws are counted
    before they meet the rows, so a tree never moves more than one record per distinct row.
    """
    n = df.count()
    ranked = ordinal(df, key, name="_rn")
    draws = _per_tree(df.sparkSession.range(1, n + 1).withColumnRenamed("id", "_rn"), trees)
    u = uniform(F.concat_ws(":", "tree_id", "_rn"), seed)
    picks = draws.select("tree_id", (F.floor(u * F.lit(n)) + 1).cast("bigint").alias("_rn"))
    counted = picks.groupBy("_rn", "tree_id").agg(F.count(F.lit(1)).alias(name))
    # trees x rows are taken for a small table, which must not go through the driver
    return ranked.join(counted.hint("merge"), "_rn").drop("_rn")


def poisson_bootstrap(df: DataFrame, key: str, trees: int, seed: int, name: str = "w") -> DataFrame:
    """Independent Poisson(1) counts per tree and row: close to n draws, without any shuffle."""
    u = uniform(F.concat_ws(":", "tree_id", key), seed)
    weighted = _per_tree(df, trees).withColumn(name, poisson_one(u).cast("bigint"))
    return weighted.filter(F.col(name) > 0)


def random_labels(
    df: DataFrame, key: str, label: str, seed: int, name: str = "predicted"
) -> DataFrame:
    """A uniformly drawn label per row. The label table has one row per class."""
    classes = category_codes(df, label, "_code").withColumnRenamed(label, name)
    code = F.floor(uniform(F.col(key), seed) * F.lit(classes.count())).cast("int")
    drawn = df.withColumn("_code", code)
    return lookup_join(drawn, classes, ["_code"], "n_rows").drop("_code", "n_rows")


def stratified_folds(
    df: DataFrame, key: str, label: str, folds: int = 5, name: str = "fold"
) -> DataFrame:
    """Contiguous folds inside each label, larger ones first.

    The fold follows from place and group size, so a label may hold any share of the rows.
    """
    ranked = ordinal(df, key, group=[label], name="_rn", size_name="_size")
    base = F.floor(F.col("_size") / folds)
    extra = F.pmod(F.col("_size"), F.lit(folds))
    place = F.col("_rn") - 1
    in_large = F.floor(place / (base + 1))
    # base is 0 when a group has fewer rows than folds; then every row is in the first branch
    in_small = extra + F.floor((place - extra * (base + 1)) / F.greatest(base, F.lit(1)))
    fold = F.when(place < extra * (base + 1), in_large).otherwise(in_small)
    return ranked.withColumn(name, fold.cast("int")).drop("_rn", "_size")


def batches(df: DataFrame, key: str, size: int, name: str = "batch") -> DataFrame:
    """Number consecutive rows in key order into batches of ``size``."""
    ranked = ordinal(df, key, name="_rn")
    return ranked.withColumn(name, F.floor((F.col("_rn") - 1) / size).cast("bigint")).drop("_rn")
