"""Counts, distributions and correlations by label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def label_shares(df: DataFrame, label: str) -> DataFrame:
    """The window runs over one row per class."""
    counts = label_counts(df, label)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def ordered_counts(df: DataFrame, label: str, number: Column | None = None) -> DataFrame:
    """Label counts with their place, by name or by the number in the label, missing numbers last."""
    counts = label_counts(df, label)
    key = F.col(label).asc_nulls_last() if number is None else number.asc_nulls_last()
    place = F.row_number().over(Window.orderBy(key, F.col(label).asc_nulls_last()))
    return counts.withColumn("place", place)


def length_summary(df: DataFrame, lengths: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Largest, smallest and mean value of each length column."""
    parts = []
    for c in lengths:
        parts += [
            F.max(c).alias(f"max_{c}"),
            F.min(c).alias(f"min_{c}"),
            F.avg(c).alias(f"mean_{c}"),
        ]
    return df.groupBy(*by).agg(*parts)


def correlation(df: DataFrame, **pairs: tuple[Column, Column]) -> DataFrame:
    """Pearson correlation of each named pair of columns, from one pass."""
    return df.agg(
        *[F.corr(x.cast("double"), y.cast("double")).alias(name) for name, (x, y) in pairs.items()]
    )


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).distinct()


def category_counts(df: DataFrame, label: str, category: str) -> DataFrame:
    return df.groupBy(label, category).agg(F.count(F.lit(1)).alias("n"))


def class_values(df: DataFrame, label: str) -> list[str]:
    """The classes that occur, in order; labels are few."""
    return sorted(r[0] for r in distinct_labels(df, label).collect())


def cross_tab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Counts with one column per value; absent pairs are zero, values not named fail the job."""
    given = F.col(columns).cast("string")
    known = F.when(given.isin(list(values)), given).otherwise(
        F.raise_error(F.concat(F.lit("not a column of the cross-tab: "), F.coalesce(given, F.lit("null"))))
    )
    counted = (
        df.select(rows, known.alias(columns)).groupBy(rows).pivot(columns, list(values))
        .agg(F.count(F.lit(1)))
    )
    return counted.na.fill(0)
