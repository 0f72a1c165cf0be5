"""Projection, filter and label queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions import text
from lexigrain.operators import labels
from lexigrain.plans import sql
from lexigrain.plans.registry import query
from lexigrain.session import widen
from lexigrain.sources import read_table

# The `source` column plays the part of a label that carries a number.
SOURCES = [f"src{i}" for i in range(20)]
RARE = ["src16", "src17", "src18", "src19"]
SOURCE_CODES = labels.numeric_codes(SOURCES)


@query("SELECT doc_id, lang, source FROM documents")
def b01_drop_columns(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").drop("text", "n_chars")


@query("SELECT lang, text FROM documents")
def b02_keep_columns(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("lang", "text")


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    rated = read_table(spark, folder, "labels").select(
        "doc_id", F.col("quality").cast("string").alias("label")
    )
    return read_table(spark, folder, "documents").select("doc_id").join(rated, "doc_id", "left")


@query(
    """SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), 'Unknown') AS label
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def b03_missing_label_default(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder).withColumn("label", labels.with_default(F.col("label")))


@query(
    """SELECT d.doc_id, CAST(quality AS VARCHAR) AS label
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       WHERE quality IS NULL OR quality <> 0"""
)
def b04_exclude_labels(spark: SparkSession, folder: str) -> DataFrame:
    return labels.exclude_labels(_quality(spark, folder), "label", ["0"])


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src16','src17','src18','src19')")
def b04_exclude_rare_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "source")
    return labels.exclude_labels(docs, "source", RARE)


@query(
    f"""SELECT * FROM (SELECT doc_id, CAST({sql.sentences('text')} AS BIGINT) AS sentences,
               CAST(len({sql.words('text')}) AS BIGINT) AS words FROM documents)
        WHERE sentences >= 100 OR words >= 1000"""
)
def b05_long_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = widen(read_table(spark, folder, "documents").select("doc_id", "text"))
    measured = docs.select(
        "doc_id",
        text.sentence_count(F.col("text")).alias("sentences"),
        text.token_count(text.words(F.col("text"))).alias("words"),
    )
    long = measured.withColumn("hundreds", F.greatest("sentences", F.floor(F.col("words") / 10)))
    return labels.at_least(long, "hundreds", 100).drop("hundreds")


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'de'")
def b06_rows_of_one_label(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return labels.of_label(docs, "lang", "de").drop("lang")


@query(
    """SELECT doc_id, CASE WHEN source IN ('src16','src17','src18','src19') THEN 'src15'
              ELSE source END AS source FROM documents"""
)
def b07_merge_rare_labels(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "source")
    return labels.merge_labels(docs, "source", RARE, "src15")


@query("SELECT doc_id, CAST(replace(source, 'src', '') AS INTEGER) AS number FROM documents")
def b08_label_number(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return docs.select("doc_id", labels.label_number(F.col("source"), "src").alias("number"))


@query("SELECT vec_id, label AS target FROM embeddings")
def b09_rename(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings").select("vec_id", "label")
    return vectors.withColumnRenamed("label", "target")


@query("SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS code FROM documents")
def b10_fixed_label_codes(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "source")
    return labels.code_by_map(docs, "source", SOURCE_CODES).drop("source")


_CATEGORIES = """cats AS (SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS code
                          FROM (SELECT DISTINCT source FROM documents))"""


@query(
    f"WITH {_CATEGORIES} SELECT doc_id, code FROM documents JOIN cats USING (source)"
)
def b11_category_codes(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "source")
    return labels.encode(docs, labels.category_codes(docs, "source"), "source").drop("source")


@query(
    f"""WITH {_CATEGORIES} SELECT vec_id, label AS code, source
        FROM embeddings LEFT JOIN cats ON label = code"""
)
def b12_codes_to_labels(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("source")
    coded = read_table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("code"))
    return labels.decode(coded, labels.category_codes(docs, "source"))


@query("SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 5")
def b13_preview(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "lang", "source")
    return labels.preview(docs, "doc_id")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM documents")
def b14_row_count(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").agg(F.count(F.lit(1)).alias("n"))
