"""Readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("age", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("age_exact", T.StringType()),
    ]
)


def read_json_array(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType = DOCUMENT_SCHEMA
) -> DataFrame:
    """Files that each hold one JSON array of records.

    Spark does not split such a file, so one task parses one file. That suits many small files; for
    large ones see ``json_ranges.read_large_json_array``.
    """
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType = DOCUMENT_SCHEMA
) -> DataFrame:
    """One JSON record per line; a missing field is null. The schema is given, never inferred."""
    return spark.read.schema(schema).json(path)


def read_stop_words(spark: SparkSession, path: str, limit: int = 100_000) -> list[str]:
    """A word list with one word per line, returned as literals for the cleaning expressions.

    A list is a setting, not data; a longer file than ``limit`` is refused, not cut.
    """
    rows = spark.read.text(path).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"stop word list has more than {limit} lines")
    return [r.value for r in rows]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_node_table(nodes: DataFrame, path: str) -> None:
    """Fitted trees are plain rows, so they are stored as Parquet."""
    nodes.write.mode("overwrite").parquet(path)


def load_node_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_metrics(metrics: DataFrame, path: str, fmt: str = "json") -> None:
    metrics.write.mode("overwrite").format(fmt).save(path)
