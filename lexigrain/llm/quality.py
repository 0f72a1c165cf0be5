"""Quality of texts: histogram gradient-boosted trees over statistics of the document."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.llm.common import fold, query, spread, table, within

#: Labelled documents that the trees are fitted on, drawn by a hash of the id (about so many).
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 60, 4, 64, 0.15, 1.0, 2.0
THRESHOLD = 0.3
HELD_OUT_FOLDS, HELD_OUT = 5, 0

SYMBOLS = b"#*$%&|<>"
#: Statistics of a text, in the order of the feature array.
FEATURES = [
    "log_chars", "log_words", "mean_word_bytes", "log_longest_word", "upper_share",
    "digit_share", "symbol_share", "mark_share", "stop_share", "comma_share", "other_ascii_share",
    "beyond_ascii_share", "blank_share", "distinct_word_share", "top_word_share",
    "same_as_previous_share", "log_lines", "dup_line_share", "words_per_line", "top_byte_share",
]


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(members)] = 1
    return out


_CLASSES = np.stack(
    [
        _class(bytes(range(65, 91))),
        _class(b"0123456789"),
        _class(SYMBOLS),
        _class(b"!"),
        _class(b"."),
        _class(b",;:"),
        _class(b"\"'()-/?@[\\]^_`{}~+="),
        _class(bytes(range(128, 256))),
        _class(b"\t\n\x0b\x0c\r "),
    ]
)


def statistics(text: object) -> np.ndarray:
    """The statistics of one whole text; all 0 for a null or empty one."""
    data = text.encode("utf-8", "replace") if isinstance(text, str) else b""
    out = np.zeros(len(FEATURES))
    words = data.split()
    if not words:
        return out
    bytes_of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, size = len(words), len(data)
    counts = Counter(words)
    lines = [s for line in data.split(b"\n") if (s := line.strip())]
    lengths = np.fromiter(map(len, words), np.int64, n)
    out[:4] = np.log1p(size), np.log1p(n), lengths.mean(), np.log1p(lengths.max())
    out[4:13] = _CLASSES @ bytes_of / size
    out[13] = len(counts) / n
    out[14] = max(counts.values()) / n
    out[15] = sum(map(operator.eq, words, words[1:])) / n
    out[16] = np.log1p(len(lines))
    out[17] = 1 - len(set(lines)) / len(lines)
    out[18] = n / len(lines)
    out[19] = bytes_of.max() / size
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(texts: pd.Series) -> pd.Series:
    """The statistics of whole texts as a column."""
    return pd.Series([statistics(t) for t in texts])


@dataclass
class Trees:
    """Complete trees of one depth as arrays: node i has the children 2i + 1 and 2i + 2.

    A row goes right where its feature is above the threshold; a node without a split sends all
    rows left. ``leaf`` are the summands of the log odds.
    """

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1: all rows step down a tree together."""
        odds = np.full(len(rows), self.base)
        inner, each = self.feature.shape[1], np.arange(len(rows))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(rows), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (rows[each, feature[node]] > threshold[node])
            odds += leaf[node - inner]
        return 1 / (1 + np.exp(-odds))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="lower"))
    return (values[:-1] + values[1:]) / 2


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    trees: int = TREES,
    depth: int = DEPTH,
    bins: int = BINS,
    rate: float = RATE,
    ridge: float = RIDGE,
    least_weight: float = LEAST_WEIGHT,
) -> Trees:
    """Boost trees on logistic loss. Splits are found on histograms of gradients over bins.

    Without labels every score is 0.5, with one class it leans to that class.
    """
    n, width = len(rows), rows.shape[1] if len(rows) else len(FEATURES)
    inner = (1 << depth) - 1
    share = (labels.sum() + 1) / (n + 2)
    model = Trees(
        float(np.log(share / (1 - share))),
        np.zeros((trees, inner), np.int32),
        np.full((trees, inner), np.inf),
        np.zeros((trees, inner + 1)),
    )
    if not n:
        return model
    cuts = [_cuts(rows[:, f], bins) for f in range(width)]
    binned = np.stack([np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    place = binned + np.arange(width) * (bins + 1)
    cells = width * (bins + 1)
    odds = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        gradient, weight = labels - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * cells + place).ravel()
            g, h = (
                np.bincount(at, np.repeat(v, width), nodes * cells)
                .reshape(nodes, width, bins + 1)
                .cumsum(axis=2)
                for v in (gradient, weight)
            )
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = (
                g * g / (h + ridge)
                + (g_all - g) ** 2 / (h_all - h + ridge)
                - g_all * g_all / (h_all + ridge)
            )
            gain[(h < least_weight) | (h_all - h < least_weight)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k, cell in enumerate(best):
                f, b = divmod(int(cell), bins + 1)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    model.feature[t, first + k], model.threshold[t, first + k] = f, cuts[f][b]
            each = np.arange(n)
            node = 2 * node + 1 + (
                rows[each, model.feature[t, node]] > model.threshold[t, node]
            )
        leaf = node - inner
        step = rate * np.bincount(leaf, gradient, inner + 1) / (
            np.bincount(leaf, weight, inner + 1) + ridge
        )
        model.leaf[t] = step
        odds += step[leaf]
    return model


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees from labelled documents outside the held-out fold.

    ``labels`` has ``doc_id`` and ``quality``; labels other than 0 and 1 are left out. At most about
    ``train_rows`` of them are drawn, which bounds what is broadcast to the documents and the
    statistics that reach the driver.
    """
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), HELD_OUT_FOLDS) != HELD_OUT))
        .dropDuplicates()
    )
    drawn = within(known, F.col("doc_id"), train_rows)
    train = (
        spread(docs, ["doc_id", "text"])
        .join(F.broadcast(drawn), "doc_id")
        .select("doc_id", "quality", features("text").alias("features"))
        .orderBy("doc_id", "quality")
        .toPandas()
    )
    rows = np.array(train["features"].tolist(), float).reshape(len(train), len(FEATURES))
    return fit(rows, train["quality"].to_numpy(float))


def quality_of(spark: SparkSession, model: Trees) -> Callable:
    """A column function from text to its score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            rows = np.array([statistics(t) for t in batch]).reshape(len(batch), len(FEATURES))
            yield pd.Series(shared.value.score(rows))

    return quality


def score(
    docs: DataFrame, model: Trees, doc_id: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, score, predicted`` of every document, in one pass over whole texts.

    Null and empty texts have statistics like any other and get the score that was learned for
    them. A null id stays null, repeated rows get the same score. Only two columns are read.
    """
    quality = quality_of(docs.sparkSession, model)
    rows = spread(docs, [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")])
    found = rows.select("doc_id", quality("text").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        (fold(F.col("doc_id"), HELD_OUT_FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        "predicted",
    )
