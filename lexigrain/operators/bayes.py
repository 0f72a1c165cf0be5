"""Multinomial naive Bayes and predictive terms as aggregates and joins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.operators import word_blocks
from lexigrain.operators.joins import lookup_join
from lexigrain.operators.ranking import top_per_group
from lexigrain.operators.word_blocks import WordBlocks
from lexigrain.session import persisted


def label_term_counts(df: DataFrame, label: str, token_array: Column) -> DataFrame:
    rows = df.select(label, F.explode(token_array).alias("term"))
    return rows.groupBy(label, "term").agg(F.count(F.lit(1)).alias("c"))


@dataclass(frozen=True)
class NaiveBayes:
    """``terms``: (term, n, logs: label -> ln(c + 1)). ``classes``: one row per label."""

    terms: DataFrame
    classes: DataFrame

    def predict(self, df: DataFrame, token_array: Column, doc_id: str = "doc_id") -> DataFrame:
        """Best label and its score for every row; terms unknown to the model are left out.

        A label that never had a term adds ln(1) = 0, so only counted pairs are stored. Labels are
        compared on scores of six digits, equal ones go to the first in order.
        """
        docs = df.filter(F.col(doc_id).isNotNull())
        blocks = WordBlocks.deal(docs, token_array, F.xxhash64(doc_id), [doc_id])
        used = blocks.words().drop("rows").join(self.terms.withColumnRenamed("term", "word"), "word")
        used = used.select("_block", "word", F.map_entries("logs").alias("logs"))
        fields = [df.schema[doc_id], T.StructField("_sums", T.MapType(T.StringType(), T.DoubleType())),
                  T.StructField("_len", T.DoubleType())]

        def summed(rows: pa.Table, known: pa.Table) -> pa.Table:
            ids, owner, at, n = word_blocks.entries(rows, doc_id, known["word"])
            logs, starts = word_blocks.flat(known["logs"])
            labels = logs.field("key").dictionary_encode()
            sums = word_blocks.by_label(
                owner, at, n, starts, labels.indices.to_numpy(), logs.field("value").to_numpy(), len(labels.dictionary), len(ids)
            )
            maps = word_blocks.maps(labels.dictionary.to_pylist(), sums)
            return pa.table({doc_id: ids, "_sums": maps, "_len": np.bincount(owner, n, len(ids)).astype(float)})

        sums = blocks.meet(used, summed, T.StructType(fields))
        # one entry per class
        classes = self.classes.agg(
            F.sort_array(F.collect_list(F.struct("label", "log_prior", "log_total")))
        ).scalar()
        everyone = (
            df.select(doc_id)
            .join(sums, doc_id, "left")
            .withColumn("_classes", classes)
        )
        scored = F.transform(
            "_classes",
            lambda c: F.struct(
                F.round(
                    c["log_prior"]
                    + F.coalesce(F.element_at("_sums", c["label"]), F.lit(0.0))
                    - F.coalesce("_len", F.lit(0.0)) * c["log_total"],
                    6,
                ).alias("score"),
                c["label"].alias("label"),
            ),
        )
        best = F.array_max(F.transform("_scores", lambda s: s["score"]))
        return everyone.withColumn("_scores", scored).select(
            doc_id,
            F.filter("_scores", lambda s: s["score"] == best)[0]["label"].alias("predicted"),
            best.alias("score"),
        )


def fit_naive_bayes(df: DataFrame, label: str, token_array: Column) -> NaiveBayes:
    """Laplace-smoothed model, stored as two tables; labels are held as strings."""
    counts = persisted(label_term_counts(df, label, token_array), "label_terms")
    named = F.struct(F.col(label).cast("string"), F.log(F.col("c") + 1.0))
    logs = F.map_from_entries(F.collect_list(named))
    # a term has at most one entry per class
    terms = counts.groupBy("term").agg(logs.alias("logs"), F.sum("c").alias("total"))
    vocabulary = counts.groupBy("term").agg(F.lit(1)).agg(F.count(F.lit(1))).scalar()
    tokens = counts.groupBy(label).agg(F.sum("c").alias("n_tokens"))
    docs = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_docs"))
    total_docs = df.agg(F.count(F.lit(1))).scalar()
    classes = docs.join(tokens, label, "left").select(
        F.col(label).cast("string").alias("label"),
        F.log(F.col("n_docs") / total_docs).alias("log_prior"),
        F.log(F.coalesce("n_tokens", F.lit(0)) + vocabulary).alias("log_total"),
    )
    return NaiveBayes(persisted(terms, "terms"), persisted(classes, "classes"))


def predictive_terms(df: DataFrame, label: str, token_array: Column, n: int = 20) -> DataFrame:
    """Terms with the largest smoothed log-odds of each class against the others."""
    counts = persisted(label_term_counts(df, label, token_array), "label_terms")
    overall = counts.groupBy("term").agg(F.sum("c").alias("all_c"))
    vocabulary = overall.agg(F.count(F.lit(1))).scalar()
    everything = counts.agg(F.sum("c")).scalar()
    sizes = counts.groupBy(label).agg(F.sum("c").alias("n_tokens"), F.count(F.lit(1)).alias("rows"))
    # a term occurs once per class in `counts`, so neither side of this join can be skewed
    joined = counts.join(overall, "term")
    joined = lookup_join(joined, persisted(sizes, "sizes"), [label], "rows")
    inside = F.log((F.col("c") + 1) / (F.col("n_tokens") + vocabulary))
    outside = F.log(
        (F.col("all_c") - F.col("c") + 1) / (everything - F.col("n_tokens") + vocabulary)
    )
    scored = joined.select(label, "term", F.round(inside - outside, 9).alias("score"))
    return top_per_group(scored, [label], [F.col("score").desc(), F.col("term")], n)


def predict_held_out(
    df: DataFrame, label: str, token_array: Column, fold: str = "fold", doc_id: str = "doc_id"
) -> DataFrame:
    """``doc_id, fold, label, predicted, score``: every document judged by the model of the other folds.

    Terms are counted once, per label and fold. The model that holds out a fold has the totals less
    that fold's counts, so all folds cost one count. Terms unknown to the other folds are left out. Labels are
    compared on scores of six digits, equal ones go to the first in order.
    """
    rows = df.select(label, fold, F.explode(token_array).alias("term"))
    counts = persisted(rows.groupBy(label, fold, "term").agg(F.count(F.lit(1)).alias("c")), "fold_terms")
    docs = persisted(df.groupBy(label, fold).agg(F.count(F.lit(1)).alias("n_docs")), "fold_docs")
    folds = docs.select(F.col(fold).alias("held")).distinct()
    # a term has at most one entry per class and fold
    entry = F.struct(F.col(label).cast("string").alias("label"), F.col(fold).alias("fold"), "c")
    terms = persisted(
        counts.filter(F.col(fold).isNotNull()).groupBy("term").agg(
            F.collect_list(entry).alias("entries"), F.min(fold).alias("first"), F.max(fold).alias("last")
        ),
        "entries",
    )
    # a model does not know the terms that only its held-out fold has
    own = terms.filter("first = last").groupBy(F.col("first").alias("held")).agg(F.count(F.lit(1)).alias("own"))
    everything = terms.agg(F.count(F.lit(1)).alias("v"))
    vocabulary = folds.crossJoin(F.broadcast(everything)).join(own, "held", "left").select(
        "held", (F.col("v") - F.coalesce("own", F.lit(0))).alias("v")
    )
    # one row per class and fold from here on
    grid = docs.select(label).distinct().crossJoin(F.broadcast(folds))
    train = (F.col(fold) != F.col("held"))
    docs_in = grid.join(docs, label).filter(train).groupBy("held", label).agg(F.sum("n_docs").alias("n_docs"))
    tokens = counts.groupBy(label, fold).agg(F.sum("c").alias("n"))
    tokens_in = grid.join(tokens, label).filter(train).groupBy("held", label).agg(F.sum("n").alias("n_tokens"))
    all_docs = docs_in.groupBy("held").agg(F.sum("n_docs").alias("all_docs"))
    classes = (
        docs_in.join(tokens_in, ["held", label], "left").join(all_docs, "held").join(vocabulary, "held", "left")
        .select(
            "held",
            F.col(label).cast("string").alias("_label"),
            F.log(F.col("n_docs") / F.col("all_docs")).alias("log_prior"),
            F.log(F.coalesce("n_tokens", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("log_total"),
        )
    )
    blocks = WordBlocks.deal(df.filter(F.col(doc_id).isNotNull()), token_array, F.xxhash64(doc_id), [doc_id, fold])
    used = blocks.words().drop("rows").join(terms.select(F.col("term").alias("word"), "entries"), "word")

    def summed(rows: pa.Table, known: pa.Table) -> pa.Table:
        ids, owner, at, n = word_blocks.entries(rows, doc_id, known["word"])
        found, starts = word_blocks.flat(known["entries"])
        names = found.field("label").dictionary_encode(null_encoding="encode")
        n_labels, word = len(names.dictionary), np.repeat(np.arange(len(known), dtype=np.int64), np.diff(starts))
        pairs, pair = np.unique(word * max(n_labels, 1) + names.indices.to_numpy(), return_inverse=True)
        pair_starts = np.searchsorted(pairs, np.arange(len(known) + 1) * max(n_labels, 1))
        of_fold, c = found.field("fold").to_numpy(), found.field("c").to_numpy()
        # rows that repeat an id are asked for once each
        row_owner, row_held = word_blocks.places(rows[doc_id], pa.chunked_array([ids])), rows[fold].to_numpy()
        sums, lengths = np.zeros((len(ids), n_labels)), np.zeros(len(ids))
        for held in np.unique(row_held[~np.isnan(row_held.astype(float))]):
            times = np.bincount(row_owner[row_held == held], minlength=len(ids))
            others = np.where(of_fold == held, 0, c)
            asked = times[owner] > 0
            who, what, weight = owner[asked], at[asked], (n * times[owner])[asked]
            logs = np.log(np.bincount(pair, others, len(pairs)) + 1)
            sums += word_blocks.by_label(who, what, weight, pair_starts, pairs % max(n_labels, 1), logs, n_labels, len(ids))
            met = np.bincount(word, others, len(known))[what] > 0
            lengths += np.bincount(who[met], weight[met], len(ids))
        labelled = [i for i, name in enumerate(names.dictionary.to_pylist()) if name is not None]
        keys = [names.dictionary[i].as_py() for i in labelled]
        return pa.table({doc_id: ids, "_sums": word_blocks.maps(keys, sums[:, labelled]), "_len": lengths})

    fields = [df.schema[doc_id], T.StructField("_sums", T.MapType(T.StringType(), T.DoubleType())),
              T.StructField("_len", T.DoubleType())]
    scored = (
        df.select(doc_id, label, F.col(fold).alias("held"))
        .join(F.broadcast(classes), "held")
        .join(blocks.meet(used, summed, T.StructType(fields)), doc_id, "left")
        .withColumn("_sum", F.element_at("_sums", F.col("_label")))
    )
    score = F.round(
        F.col("log_prior") + F.coalesce("_sum", F.lit(0.0)) - F.coalesce("_len", F.lit(0)) * F.col("log_total"), 6
    )
    best = F.min(F.struct((-score).alias("score"), F.col("_label").alias("label")))
    return scored.groupBy(doc_id, label, "held").agg(best.alias("best")).select(
        doc_id, F.col("held").alias(fold), label, F.col("best.label").alias("predicted"), (-F.col("best.score")).alias("score")
    )
