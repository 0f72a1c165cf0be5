"""Projection, filtering, recoding and weighting of labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.operators.joins import lookup_join
from lexigrain.session import persisted


def with_default(column: Column, default: str = "Unknown") -> Column:
    return F.coalesce(column, F.lit(default))


def exclude_labels(df: DataFrame, label: str, excluded: Sequence[str]) -> DataFrame:
    """Drop rows of the given labels; rows without a label stay."""
    return df.filter(~F.coalesce(F.col(label).isin(*excluded), F.lit(False)))


def at_least(df: DataFrame, column: str, minimum: int) -> DataFrame:
    return df.filter(F.col(column) >= minimum)


def of_label(df: DataFrame, label: str, value: str) -> DataFrame:
    return df.filter(F.col(label) == value)


def merge_labels(df: DataFrame, label: str, merged: Sequence[str], into: str) -> DataFrame:
    """Recode rare labels into one."""
    return df.withColumn(
        label, F.when(F.col(label).isin(*merged), F.lit(into)).otherwise(F.col(label))
    )


def label_number(label: Column, affix: str = "s") -> Column:
    """The number in a label such as ``30s``; anything else fails under ANSI mode."""
    return F.regexp_replace(label, affix, "").cast("int")


def numeric_codes(labels: Sequence[str]) -> dict[str, int]:
    """Label codes by position in the given order."""
    return {label: code for code, label in enumerate(labels)}


def code_by_map(
    df: DataFrame,
    label: str,
    codes: Mapping[str, int],
    name: str = "code",
    on_unknown: str = "error",
) -> DataFrame:
    """Codes from a fixed map. Unknown labels fail the job, or become null on request."""
    lookup = F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])
    found = F.element_at(lookup, F.col(label)).cast("int")
    if on_unknown == "error":
        message = F.concat(F.lit("unknown label: "), F.coalesce(F.col(label), F.lit("null")))
        found = F.when(found.isNotNull(), found).otherwise(F.raise_error(message).cast("int"))
    return df.withColumn(name, found)


def category_codes(df: DataFrame, label: str, name: str = "code") -> DataFrame:
    """The table of labels with their codes in lexicographic order and their number of rows.

    Labels are classes, so the table has one row per class; it is fitted on the training rows and
    used for every other split.
    """
    labels = df.filter(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    code = (F.row_number().over(Window.orderBy(label)) - 1).cast("int")
    return persisted(labels.withColumn(name, code), "categories")


def encode(df: DataFrame, categories: DataFrame, label: str, name: str = "code") -> DataFrame:
    """Codes for the labels of ``df``; labels outside the table become -1."""
    coded = lookup_join(df, categories, [label], "n_rows", how="left").drop("n_rows")
    return coded.withColumn(name, F.coalesce(name, F.lit(-1)))


def decode(df: DataFrame, categories: DataFrame, name: str = "code") -> DataFrame:
    return lookup_join(df, categories, [name], "n_rows", how="left").drop("n_rows")


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(key).limit(n)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class: rows, relative frequency, its inverse, and the inverse scaled to sum 1."""
    everything = Window.partitionBy()
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("freq", F.col("n") / F.sum("n").over(everything))
    inverse = shares.withColumn("inverse", 1 / F.col("freq"))
    return inverse.withColumn("weight", F.col("inverse") / F.sum("inverse").over(everything))
