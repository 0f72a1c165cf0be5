"""From documents to packed training windows: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain.llm import langid, mixing, packing, quality, simhash
from lexigrain.llm.common import bound_batches
from lexigrain.session import persisted

#: A document whose main language holds less of its letters is rejected.
LEAST_LANGUAGE_SHARE = 0.5
#: Ids of rows to go that are sent to every task, 8 bytes each.
MOST_SENT = 4_000_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are mainly in one learned language; ``und`` and null texts go.

    Texts without letters are ``und``. Repeated rows have one language; an empty table stays empty.
    """
    bound_batches(spark)
    language = langid.language_of(spark, langid.learn(docs))(F.col("text"))
    accepted = F.when(language["lang_pred"] != langid.UNKNOWN, language["score"])
    return docs.filter(accepted >= LEAST_LANGUAGE_SHARE)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier marks 1.

    Null and empty texts are scored like any other. Repeated rows have one score. Without labelled
    documents the classifier marks by its prior; an empty table stays empty.
    """
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = quality.quality_of(spark, quality.learn(docs, labels))(F.col("text"))
    return docs.filter(score >= quality.THRESHOLD)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id.

    Groups are those of the SimHash operator: fingerprints over shingles of 3 words link at 3 or
    fewer differing bits. Null texts and texts without words are one group. An id names a document,
    so of rows that repeat an id one stays, whatever their texts; rows without an id are no group's
    and stay.

    What goes is far less than what stays, so rows are held against the ids to go. Up to
    ``MOST_SENT`` of them are sent to the tasks that read the rows, and no text is exchanged; more are
    joined by a shuffle. Only rows that repeat an id are ranked.
    """
    groups = simhash.simhash_groups(docs, shingle=3, most=3).filter("doc_id IS NOT NULL")
    ids = groups.groupBy("doc_id").agg(F.min("component_id").alias("first"), F.count(F.lit(1)).alias("n"))
    listed = persisted(ids.filter("first <> doc_id OR n > 1"), "listed")
    few = listed.count() <= MOST_SENT
    sent = F.broadcast if few else (lambda table: table)
    single = docs.join(sent(listed.select("doc_id")), "doc_id", "left_anti")
    twice = listed.filter("first = doc_id").select("doc_id")
    repeated = docs.join(sent(twice), "doc_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))).alias("nth")
    first = repeated.select(F.struct(*docs.columns).alias("doc"), place).filter("nth = 1").select("doc.*")
    return single.select(docs.columns).unionByName(first)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and cut sources to their targets.

    A null source is a source, a null or empty text has no words and takes no part; repeated rows
    are documents of their own. A text that is cut at its source's budget is shortened. An empty table
    stays empty.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows; the pieces of all documents.

    A null or empty text is its end id alone. Long texts are cut, never dropped; repeated rows are
    packed as often as they occur. An empty table gives no piece.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_copies", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Language, quality and tokens are no SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = persisted(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
