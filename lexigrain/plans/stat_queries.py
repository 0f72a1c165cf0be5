"""Aggregation, ranking and vocabulary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions import text
from lexigrain.operators import labels, splits, stats, vocab
from lexigrain.plans import sql
from lexigrain.plans.registry import query
from lexigrain.session import widen
from lexigrain.sources import read_table


def _docs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", *columns)


def _texts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return widen(_docs(spark, folder, "text", *columns))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang")
def d01_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.label_counts(_docs(spark, folder, "lang"), "lang")


@query(
    """SELECT lang, CAST(count(*) AS BIGINT) AS n, count(*) / (SELECT count(*) FROM documents) AS share
       FROM documents GROUP BY lang"""
)
def d02_label_shares(spark: SparkSession, folder: str) -> DataFrame:
    return stats.label_shares(_docs(spark, folder, "lang"), "lang")


@query(
    """WITH c AS (SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source)
       SELECT source, n, CAST(row_number() OVER (ORDER BY source) AS INTEGER) AS place FROM c"""
)
def d03_counts_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return stats.ordered_counts(_docs(spark, folder, "source"), "source")


@query(
    """WITH c AS (SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source)
       SELECT source, n, CAST(row_number() OVER (ORDER BY CAST(substr(source, 4) AS INT)) AS INTEGER) AS place
       FROM c"""
)
def d03_counts_by_number(spark: SparkSession, folder: str) -> DataFrame:
    number = labels.label_number(F.col("source"), "src")
    return stats.ordered_counts(_docs(spark, folder, "source"), "source", number)


@query(
    f"""WITH t AS (SELECT CASE WHEN {sql.uniform('doc_id', 7)} < 0.8 THEN 'train' ELSE 'test' END AS split,
                     len({sql.words('text')}) AS raw, len({sql.tidy(sql.words('text'))}) AS tidy
                   FROM documents)
        SELECT split, CAST(max(raw) AS BIGINT) AS max_raw, CAST(min(raw) AS BIGINT) AS min_raw,
               round(avg(raw), 6) AS mean_raw, CAST(max(tidy) AS BIGINT) AS max_tidy,
               CAST(min(tidy) AS BIGINT) AS min_tidy, round(avg(tidy), 6) AS mean_tidy
        FROM t GROUP BY split"""
)
def d04_token_count_summary(spark: SparkSession, folder: str) -> DataFrame:
    docs = splits.random_split(_texts(spark, folder), "doc_id", 7)
    found = docs.select("split", text.words(F.col("text")).alias("w"))
    counted = found.select(
        "split",
        text.token_count(F.col("w")).alias("raw"),
        text.token_count(text.tidy_words(F.col("w"))).alias("tidy"),
    )
    summary = stats.length_summary(counted, ["raw", "tidy"], ["split"])
    for c in ("mean_raw", "mean_tidy"):
        summary = summary.withColumn(c, F.round(c, 6))
    return summary


@query(
    f"""SELECT round(corr(CAST(substr(source, 4) AS DOUBLE), CAST({sql.sentences('text')} AS DOUBLE)), 9) AS r_sentences,
               round(corr(CAST(substr(source, 4) AS DOUBLE), CAST(len({sql.words('text')}) AS DOUBLE)), 9) AS r_words
        FROM documents"""
)
def d05_correlation(spark: SparkSession, folder: str) -> DataFrame:
    measured = _texts(spark, folder, "source").select(
        labels.label_number(F.col("source"), "src").cast("double").alias("number"),
        text.sentence_count(F.col("text")).cast("double").alias("sentences"),
        text.token_count(text.words(F.col("text"))).cast("double").alias("words"),
    )
    number = F.col("number")
    found = stats.correlation(
        measured,
        r_sentences=(number, F.col("sentences")),
        r_words=(number, F.col("words")),
    )
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query("SELECT DISTINCT lang FROM documents")
def d06_distinct_labels(spark: SparkSession, folder: str) -> DataFrame:
    return stats.distinct_labels(_docs(spark, folder, "lang"), "lang")


@query(
    f"""WITH {sql.DOC_TOKENS}
        SELECT lang, token, CAST(count(*) AS BIGINT) AS n,
               CAST(min(doc_id * 16777216 + pos) AS BIGINT) AS first_seen FROM tok GROUP BY lang, token"""
)
def d07_token_counts_per_label(spark: SparkSession, folder: str) -> DataFrame:
    return vocab.token_counts(
        _texts(spark, folder, "lang"), "lang", text.clean_tokens(F.col("text"))
    )


_TOP = """SELECT lang, token, n, rk FROM (
            SELECT lang, token, CAST(count(*) AS BIGINT) AS n,
                   CAST(row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC,
                        min(doc_id), arg_min(pos, (doc_id, pos))) AS INTEGER) AS rk
            FROM tok GROUP BY lang, token) WHERE rk <= {n}"""


@query(f"WITH {sql.DOC_TOKENS} {_TOP.format(n=50)}")
def d08_top_tokens_per_label(spark: SparkSession, folder: str) -> DataFrame:
    docs = _texts(spark, folder, "lang")
    top = vocab.top_tokens(docs, "lang", text.clean_tokens(F.col("text")), 50)
    return top.drop("first_seen")


@query(
    f"""WITH a AS (SELECT doc_id, lang, {sql.alphabetic('text')} AS toks FROM documents),
             tok AS (SELECT doc_id, lang, unnest(toks) AS token,
                            generate_subscripts(toks, 1) - 1 AS pos FROM a)
        {_TOP.format(n=10)}"""
)
def d08_top_words_per_label(spark: SparkSession, folder: str) -> DataFrame:
    docs = _texts(spark, folder, "lang")
    top = vocab.top_tokens(docs, "lang", text.alphabetic_words(F.col("text")), 10)
    return top.drop("first_seen")


@query(
    f"""SELECT lang, CASE WHEN len({sql.words('text')}) >= 400 THEN 'long' ELSE 'short' END AS category,
               CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL"""
)
def d09_category_counts(spark: SparkSession, folder: str) -> DataFrame:
    size = F.size(text.words(F.col("text")))
    docs = _texts(spark, folder, "lang").select(
        "lang", F.when(size >= 400, "long").otherwise("short").alias("category")
    )
    return stats.category_counts(docs, "lang", "category")


@query(
    """SELECT source, CAST(count(*) FILTER (lang = 'de') AS BIGINT) AS de,
              CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS en,
              CAST(count(*) FILTER (lang = 'es') AS BIGINT) AS es,
              CAST(count(*) FILTER (lang = 'fr') AS BIGINT) AS fr FROM documents GROUP BY source"""
)
def d10_cross_tab(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder, "source", "lang")
    return stats.cross_tab(docs, "source", "lang", stats.class_values(docs, "lang"))


@query(
    """WITH c AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang),
            f AS (SELECT lang, n, n / sum(n) OVER () AS freq FROM c)
       SELECT lang, n, round(freq, 9) AS freq, round(1 / freq, 9) AS inverse,
              round((1 / freq) / sum(1 / freq) OVER (), 9) AS weight FROM f"""
)
def d11_class_weights(spark: SparkSession, folder: str) -> DataFrame:
    weights = labels.class_weights(_docs(spark, folder, "lang"), "lang")
    return weights.select(
        "lang", "n", *[F.round(c, 9).alias(c) for c in ("freq", "inverse", "weight")]
    )


@query(
    f"WITH {sql.DOC_TOKENS} SELECT token, CAST(count(*) AS BIGINT) AS cf FROM tok GROUP BY token"
)
def d13_term_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return vocab.term_frequency(_texts(spark, folder), text.clean_tokens(F.col("text")))


@query(
    f"""WITH {sql.DOC_TOKENS},
        c AS (SELECT token, count(*) AS cf, min(doc_id * 16777216 + pos) AS f FROM tok GROUP BY token)
        SELECT token, CAST(cf AS BIGINT) AS cf,
               CAST(row_number() OVER (ORDER BY f) - 1 AS BIGINT) AS term_id FROM c"""
)
def d14_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    docs = _texts(spark, folder)
    return vocab.vocabulary(docs, text.clean_tokens(F.col("text"))).drop("first_seen")
