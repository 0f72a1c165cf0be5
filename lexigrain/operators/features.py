"""Token filtering, term weights and feature vectors.

The document-term matrix is a long table (doc_id, doc_len, term, n) and never dense. Documents
should be partitioned by their id (see ``session.colocate``) so that all per-document steps stay
local.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.functions import text
from lexigrain.operators import word_blocks
from lexigrain.operators.joins import BROADCAST_ROWS, lookup_join
from lexigrain.operators.word_blocks import WordBlocks
from lexigrain.session import persisted


#: Tokens that a filter may hold as a set of literals.
LISTED_TOKENS = 10_000


def filter_tokens(
    df: DataFrame, token_array: Column, kept: DataFrame, doc_id: str = "doc_id", name: str = "tokens"
) -> DataFrame:
    """Keep the tokens listed in ``kept`` (columns ``token``, ``n``), in their order.

    ``kept`` holds top-token lists, so it has at most labels x n rows. Up to ``LISTED_TOKENS`` of
    them are a set that filters the array in place; longer lists are joined. Documents left without
    a token stay, with an empty array.
    """
    listed = persisted(kept.groupBy("token").agg(F.sum("n").alias("_kept")), "kept")
    known = [r["token"] for r in listed.select("token").limit(LISTED_TOKENS + 1).collect()]
    if len(known) <= LISTED_TOKENS:
        found = F.filter(token_array, lambda x: x.isin(known))
        return df.select(doc_id, F.coalesce(found, F.array().cast("array<string>")).alias(name))
    rows = df.select(doc_id, F.posexplode_outer(token_array).alias("pos", "token"))
    joined = lookup_join(
        rows, listed, ["token"], "_kept", [doc_id, "pos"], how="left"
    )
    pair = F.when(F.col("_kept").isNotNull(), F.struct("pos", "token"))
    regrouped = joined.groupBy(doc_id).agg(F.array_sort(F.collect_list(pair)).alias("_pairs"))
    return regrouped.select(doc_id, F.transform("_pairs", lambda p: p["token"]).alias(name))


def doc_terms(df: DataFrame, token_array: Column, doc_id: str = "doc_id") -> DataFrame:
    """Occurrences of each term per document, with the document length.

    A document is one row, so terms are counted inside it and nothing is shuffled. Empty documents
    give no rows: they are dropped by the missing term, because a plain ``explode`` lets Catalyst
    infer a filter on the array, which would clean every text once more.
    """
    counted = counted_terms(df, token_array, doc_id)
    exploded = counted.select(doc_id, "doc_len", F.explode_outer("runs").alias("_run"))
    return exploded.filter(F.col("_run").isNotNull()).select(doc_id, "doc_len", "_run.term", "_run.n")


def counted_terms(df: DataFrame, token_array: Column, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: its length, and its terms in order with their numbers as ``runs``."""
    ordered = df.select(doc_id, F.array_sort(token_array).alias("_sorted"))
    starts = ordered.select("*", run_starts("_sorted").alias("_starts"))
    return starts.select(
        doc_id,
        F.size("_sorted").cast("bigint").alias("doc_len"),
        run_lengths("_sorted", "_starts").alias("runs"),
    )


def run_starts(ordered: str) -> Column:
    """Places of a sorted array column where an entry differs from the one before."""
    return F.expr(
        f"filter(sequence(0, greatest(size({ordered}) - 1, 0)), i_ -> i_ < size({ordered}) AND "
        f"(i_ = 0 OR get({ordered}, i_) <> get({ordered}, i_ - 1)))"
    )


def run_lengths(ordered: str, starts: str) -> Column:
    """Distinct entries of a sorted array column and how often each occurs, as (term, n) pairs."""
    # each start lasts to the next one, the last to the end
    return F.expr(
        f"transform({starts}, (a_, k_) -> named_struct('term', get({ordered}, a_), 'n', "
        f"CAST(coalesce(get({starts}, k_ + 1), size({ordered})) - a_ AS BIGINT)))"
    )


def term_frequencies(terms: DataFrame) -> DataFrame:
    return terms.withColumn("tf", F.col("n") / F.col("doc_len"))


def term_statistics(terms: DataFrame) -> DataFrame:
    """Per term: occurrences, documents, and summed term frequency, combined before the shuffle."""
    return terms.groupBy("term").agg(
        F.sum("n").alias("cf"),
        F.count(F.lit(1)).alias("df"),
        F.sum(F.col("n") / F.col("doc_len")).alias("tf_sum"),
    )


def inverse_frequency(n_docs: Column, frequency: Column) -> Column:
    return F.log(n_docs / (1 + frequency))


def smooth_inverse_frequency(n_docs: Column, df: Column) -> Column:
    return F.log((1 + n_docs) / (1 + df)) + 1


def document_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def _idf(kind: str, n_docs: Column) -> Column:
    if kind not in ("collection", "document"):
        raise ValueError("idf is 'collection' or 'document'")
    return inverse_frequency(n_docs, F.col("cf" if kind == "collection" else "df"))


def tfidf(
    df: DataFrame,
    token_array: Column,
    weighting: str = "tfidf",
    idf: str = "collection",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Weight of every term in every document: term frequency, times IDF unless told otherwise.

    Counted terms are stored once, since tokenising the texts twice costs more.
    """
    terms = term_frequencies(doc_terms(df, token_array, doc_id))
    if weighting == "tf":
        return terms.select(doc_id, "term", F.col("tf").alias("weight"))
    terms = persisted(terms, "terms")
    stats = term_statistics(terms).withColumn("idf", _idf(idf, document_count(df)))
    stats = persisted(stats.select("term", "df", "idf"), "idf")
    joined = lookup_join(terms, stats, ["term"], "df", [doc_id])
    return joined.select(doc_id, "term", (F.col("tf") * F.col("idf")).alias("weight"))


@dataclass(frozen=True)
class TermFeatures:
    """Terms chosen on training rows: ``table`` has (term, feature_pos, idf, total), N rows."""

    table: DataFrame
    weighting: str

    def weights(self, df: DataFrame, token_array: Column, doc_id: str = "doc_id") -> DataFrame:
        """Long feature rows (doc_id, feature_pos, weight) of any split."""
        terms = term_frequencies(doc_terms(df, token_array, doc_id))
        # N rows by construction
        joined = terms.join(F.broadcast(self.table), "term")
        factor = F.col("idf") if self.weighting == "tfidf" else F.lit(1.0)
        return joined.select(doc_id, "feature_pos", (F.col("tf") * factor).alias("weight"))

    def vectors(
        self, df: DataFrame, token_array: Column, width: int, doc_id: str = "doc_id"
    ) -> DataFrame:
        """One dense array of ``width`` weights per document, zeros where it has none of the terms.

        Terms are counted inside the row, against the chosen ones only, so nothing is exchanged. A row
        without an id has no terms.
        """
        width = max(width, 1)
        factor = F.col("idf") if self.weighting == "tfidf" else F.lit(1.0)
        # N rows by construction
        chosen = self.table.select("term", "feature_pos", factor.alias("factor")).collect()
        known = pa.array([r.term for r in chosen], pa.string())
        place = np.array([r.feature_pos for r in chosen], dtype=np.int64)
        times = np.zeros(width)
        times[place] = [r.factor for r in chosen]

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size, tokens = batch.column("_size").to_numpy(), batch.column("_tokens")
                at = pc.fill_null(pc.index_in(tokens.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(batch), dtype=np.int64), size)[at >= 0]
                n = np.bincount(row * width + place[at[at >= 0]], minlength=len(batch) * width).reshape(-1, width)
                dense = n / np.maximum(size, 1)[:, None] * times
                yield pa.RecordBatch.from_arrays([batch.column(doc_id), word_blocks.ragged(dense)], names=[doc_id, "features"])

        rows = df.select(doc_id, F.coalesce(F.when(F.col(doc_id).isNotNull(), token_array), F.array()).alias("_tokens"))
        schema = T.StructType([df.schema[doc_id], T.StructField("features", T.ArrayType(T.DoubleType()))])
        return rows.withColumn("_size", F.size("_tokens")).mapInArrow(count, schema)


def fit_features(
    df: DataFrame,
    token_array: Column,
    n_features: int = 100,
    weighting: str = "tf",
    idf: str = "collection",
    doc_id: str = "doc_id",
) -> TermFeatures:
    """Choose the terms with the largest column sum.

    A column sum is IDF times the summed term frequency, so one aggregate over the documents is
    enough and the weight of a single document is not needed. Sums that agree to nine digits are
    ordered by term.
    """
    stats = term_statistics(doc_terms(df, token_array, doc_id))
    stats = stats.withColumn("idf", _idf(idf, document_count(df)))
    factor = F.col("idf") if weighting == "tfidf" else F.lit(1.0)
    order = [F.col("total").desc(), F.col("term")]
    best = (
        stats.withColumn("total", F.round(F.col("tf_sum") * factor, 9))
        .orderBy(*order)
        .limit(n_features)
    )
    numbered = best.withColumn(
        "feature_pos", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int")
    )
    return TermFeatures(persisted(numbered.select("term", "feature_pos", "idf", "total"), "features"), weighting)


def as_vectors(df: DataFrame, array: str = "features", name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(array)))


def normalised_tfidf(
    df: DataFrame,
    token_array: Column | None = None,
    doc_id: str = "doc_id",
) -> DataFrame:
    """Counts times smooth IDF, each document scaled to length 1.

    Rows that repeat an id are scaled together. Terms are counted once; an IDF goes once to each block of
    documents that holds its term.
    """
    array = text.long_words(F.col("text")) if token_array is None else token_array
    blocks = WordBlocks.deal(df, array, F.xxhash64(doc_id), [doc_id])
    frequency = blocks.words().groupBy("word").agg(F.sum("rows").alias("df"), F.collect_list("_block").alias("_blocks"))
    idf = smooth_inverse_frequency(document_count(blocks.rows), F.col("df")).alias("idf")
    used = frequency.select(F.explode("_blocks").alias("_block"), "word", idf)

    def weighted(rows: pa.Table, known: pa.Table) -> pa.Table:
        ids, owner, at, n = word_blocks.entries(rows, doc_id, known["word"])
        raw = n * known["idf"].to_numpy()[at]
        norm = np.sqrt(np.bincount(owner, raw * raw, len(ids)))
        return pa.table(
            {doc_id: ids.take(pa.array(owner)), "term": known["word"].take(pa.array(at)), "weight": raw / norm[owner]}
        )

    weight = T.StructField("weight", T.DoubleType())
    return blocks.meet(used, weighted, T.StructType([df.schema[doc_id], T.StructField("term", T.StringType()), weight]))


def sentiment_by_lexicon(
    df: DataFrame, token_array: Column, lexicon: DataFrame, doc_id: str = "doc_id"
) -> DataFrame:
    """Sign of the summed valence per document, from a stored table (token, valence)."""
    terms = doc_terms(df, token_array, doc_id)
    rated = lexicon.select(F.col("token").alias("term"), "valence")
    if rated.count() > BROADCAST_ROWS:
        frequency = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        rated = persisted(rated.join(frequency, "term"), "rated")
    else:
        rated = rated.withColumn("df", F.lit(1))
    scored = lookup_join(terms, rated, ["term"], "df", [doc_id])
    sums = scored.groupBy(doc_id).agg(F.sum(F.col("n") * F.col("valence")).alias("_v"))
    everyone = df.select(doc_id).join(sums, doc_id, "left")
    return everyone.select(doc_id, text.sentiment(F.col("_v")).alias("sentiment"))
