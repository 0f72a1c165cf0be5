"""Exact ranks over a whole table or inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.session import shuffle_width


def value_buckets(df: DataFrame, by: str, buckets: int | None = None) -> list[float]:
    """Split points that cut numeric column ``by`` into parts of about equal size.

    Only the split points, one number per bucket, reach the driver.
    """
    n = buckets or shuffle_width(df.sparkSession)
    probabilities = [i / n for i in range(1, n)]
    found = df.approxQuantile(by, probabilities, 0.5 / n) if probabilities else []
    return [float("-inf"), *sorted(set(found)), float("inf")]


def ordinal(
    df: DataFrame,
    by: str,
    group: Sequence[str] = (),
    name: str = "rn",
    size_name: str | None = None,
    buckets: int | None = None,
    unit_interval: bool = False,
    then: Sequence[str] = (),
) -> DataFrame:
    """Add the 1-based rank by the numeric column ``by``, whole table or per group.

    Equal values are ordered by ``then``, which must make the order unique.

    ``row_number`` over a whole table, or over a group that holds much of it, is one task. Here rows
    are cut into value ranges, ranked inside each range, and shifted by the number of rows in
    earlier ranges, so the work of one task is bounded by rows / buckets. ``unit_interval`` says
    that ``by`` is uniform in [0, 1), for which the ranges need no sampling pass.
    """
    keys = list(group)
    if unit_interval:
        n = buckets or shuffle_width(df.sparkSession)
        cut = df.withColumn("_bucket", F.floor(F.col(by) * n).cast("double"))
    else:
        # a cast to double keeps the order, so it is safe for range limits
        splits = value_buckets(df, by, buckets)
        wide = df.withColumn("_by", F.col(by).cast("double"))
        cut = Bucketizer(splits=splits, inputCol="_by", outputCol="_bucket").transform(wide)
        cut = cut.drop("_by")

    per_range = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    shifted = per_range.select(
        *keys,
        "_bucket",
        (F.sum("_n").over(earlier) - F.col("_n")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_group_size"),
    )
    if not keys:
        # one row per range, so the rows themselves are never the side that is sent
        shifted = F.broadcast(shifted)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(by, *then)
    ranked = (
        cut.withColumn("_inside", F.row_number().over(inside))
        .join(shifted, [*keys, "_bucket"])
        .withColumn(name, (F.col("_inside") + F.col("_shift")).cast("bigint"))
    )
    if size_name:
        ranked = ranked.withColumn(size_name, F.col("_group_size").cast("bigint"))
    return ranked.drop("_bucket", "_inside", "_shift", "_group_size")


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "rk"
) -> DataFrame:
    """The first ``n`` rows of each group with their rank.

    Up to the session's limit Spark keeps only ``n`` rows per group before the shuffle. Beyond it,
    a first round inside salted parts of each group does the same, so a large group never meets
    in one task; the top rows of the parts contain the top rows of the group.
    """
    limit = int(
        df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    )
    if n > limit:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(shuffle_width(df.sparkSession)))
        parts = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_part", F.row_number().over(parts))
            .filter(F.col("_part") <= n)
            .drop("_salt", "_part")
        )
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
