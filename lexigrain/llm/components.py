"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexigrain.session import persisted


def _nearest(pairs: DataFrame) -> DataFrame:
    """Smallest node that each node ``u`` sees among its neighbours ``v`` and itself, as a table.

    Stored, so that its join with the links of a hub is between two plain exchanges, which adaptive
    execution splits; an aggregate below the join would hold all rows of the hub in one task.
    """
    return persisted(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "nearest")


def _large_star(links: DataFrame) -> DataFrame:
    """Connect each node's larger neighbours to the smallest node it sees."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    larger = both.filter(F.col("v") > F.col("u"))
    joined = larger.join(_nearest(both), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of them."""
    seen = _nearest(links)
    joined = links.join(seen, "u").filter(F.col("v") != F.col("m"))
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(seen.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(u, v)``; the component is its smallest node.

    Links point from the larger to the smaller node. Rounds of large and small stars halve distances
    until every node points at its component; the number of links never grows. Minima combine
    before the shuffle, and joins on a node with very many links can be split. Each round is a stored table, so lineage stays short and survives lost
    executors; only a count and a checksum reach the driver.
    """
    now = persisted(
        links.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        seen = Observation()
        star = _small_star(persisted(_large_star(now), "star")).distinct().observe(
            seen,
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("sum"),
        )
        now = persisted(star, "links")
        state = seen.get
        if state == before or not state["n"]:
            break
        before = state
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
