"""Scoring texts with a user's model, and measures on the logits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.numeric import negative_log_likelihood
from lexigrain.functions.fixed_values import SPACE, WORD_OR_MARK_PATTERN
from lexigrain.functions.text import words
from lexigrain.operators.joins import lookup_join

Scorer = Callable[[list[str]], np.ndarray]


def score_texts(
    df: DataFrame,
    load_scorer: Callable[[], Scorer],
    text: str = "text",
    key: str = "doc_id",
    batch: int = 32,
    max_tokens: int | None = 512,
) -> DataFrame:
    """Logits per row from a scorer that takes a batch of texts.

    ``load_scorer`` runs once per task. Spark streams Arrow batches through the task, so neither
    the partition nor its results are ever held as a whole. Texts of more than ``max_tokens`` tokens
    are cut after that one before they leave the JVM, shorter ones pass as they are; None passes all
    whole.
    """
    passed = F.col(text)
    if max_tokens is not None:
        head = rf"^(?:[{SPACE}]*+(?:{WORD_OR_MARK_PATTERN})){{{max_tokens}}}+"
        passed = F.when(F.size(words(passed)) <= max_tokens, passed).otherwise(
            F.regexp_extract(passed, head, 0)
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load_scorer()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                logits = np.asarray(scorer(part["text"].tolist()), dtype=float)
                yield pd.DataFrame({key: part[key].to_numpy(), "logits": list(logits)})

    kind = df.schema[key].dataType.simpleString()
    narrow = df.select(key, passed.alias("text"))
    return narrow.mapInPandas(run, f"{key} {kind}, logits array<double>")


def weighted_cross_entropy(
    df: DataFrame, logits: Column, target: str, weights: DataFrame
) -> DataFrame:
    """Mean loss with class weights (target, weight, n) from a stored table."""
    rated = lookup_join(df.withColumn("_logits", logits), weights, [target], "n")
    loss = negative_log_likelihood(F.col("_logits"), F.col(target))
    return rated.agg((F.sum(F.col("weight") * loss) / F.sum("weight")).alias("loss"))
