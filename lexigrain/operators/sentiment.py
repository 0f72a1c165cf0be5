"""Sentiment of documents by rated words and rules, against a user's table of ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.functions import sentiment
from lexigrain.operators.joins import BROADCAST_ROWS, lookup_join
from lexigrain.session import colocate, persisted


def sentiment_by_rules(
    df: DataFrame, lexicon: DataFrame, text: str = "text", doc_id: str = "doc_id", **words: tuple[str, ...]
) -> DataFrame:
    """``doc_id, compound, sentiment`` of every row of ``df``; other columns are not read.

    ``lexicon`` has (token, valence) in lower case; the highest rating of a token counts. Each text
    is cut into words once and stays one row: only its different words are looked up, and their
    ratings come back as one map. Null and empty texts, and texts without rated words, have 0 and
    are positive. Repeated rows each give a row. ``words`` are the word lists of ``word_scores``.
    """
    marks = F.coalesce(F.regexp_count(text, F.lit("!")), F.lit(0)).alias("marks")
    cut = df.select(F.col(doc_id).alias("_id"), sentiment.plain_words(F.col(text)).alias("words"), marks)
    cut = colocate(cut, "_id").withColumn("lower", F.transform("words", F.lower))
    placed = persisted(
        cut.select(
            "*",
            F.exists("words", lambda w: ~sentiment.in_capitals(w)).alias("mixed"),
            sentiment.last_place(F.col("lower"), sentiment.CONTRAST).alias("contrast"),
        ),
        "words",
    )
    asked = placed.select("_id", F.explode(F.array_distinct("lower")).alias("token"))
    rated = lexicon.groupBy("token").agg(F.max("valence").cast("double").alias("valence"))
    rated = persisted(rated, "rated")
    if rated.count() > BROADCAST_ROWS:
        frequency = asked.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        rated = persisted(rated.join(frequency, "token"), "rated")
    else:
        rated = rated.withColumn("df", F.lit(1))
    found = lookup_join(asked, rated, ["token"], "df", ["_id"])
    pairs = F.map_from_entries(F.collect_set(F.struct("token", "valence"))).alias("rated")
    maps = found.groupBy(F.col("_id").alias("_of")).agg(pairs)
    scores = placed.join(maps, F.col("_id").eqNullSafe(F.col("_of")), "left").select(
        F.col("_id").alias(doc_id), sentiment.word_scores(**words).alias("scores"), "marks"
    )
    compound = sentiment.compound(F.col("scores"), F.col("marks"))
    judged = scores.select(doc_id, F.round(compound, 4).alias("compound"))
    named = F.when(F.col("compound") >= 0, "positive").otherwise("negative")
    return judged.withColumn("sentiment", named)
