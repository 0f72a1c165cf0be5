"""Language of texts and of their spans: script ranges, then Viterbi over the scores of words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm.common import fold, query, spread, table, within

#: Labelled documents that the model is fitted on, drawn by a hash of the id (about so many).
TRAIN_ROWS = 10_000
#: Buckets for hashed character n-grams of a word with its borders, n from 1 to 3.
BUCKETS = 1 << 15
#: A language is a candidate for a script that holds at least this share of its letters.
CANDIDATE_SHARE = 0.02
#: Cost of a change of language, in the units of a word's score, and a word's largest margin.
SWITCH, MOST_MARGIN = 12.0, 6.0
UNKNOWN = "und"
HELD_OUT_FOLDS, HELD_OUT = 3, 1

#: First code points of script blocks, with the script's name. (Fixed values of Unicode.)
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"),
    (0x0780, "other"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
    (0x32000, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS])

#: A word here is a run of letters (and of numerals such as ½, which alone count as none).
LETTERS = re.compile(r"[^\W\d_]+")
SPANS = "array<struct<lang:string,first_word:int,n_words:int>>"


def words_of(text: object) -> list[str]:
    if not isinstance(text, str):
        return []
    return LETTERS.findall(text.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number and bucket of every n-gram of the words, and the script of each word."""
    joined = "\x02" + "\x02".join(words) + "\x02"
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    border = codes == 2
    word = np.cumsum(border) - 1
    one, two, three = codes, codes[:-1] * 2097169 + codes[1:], None
    three = two[:-1] * 1000003 + codes[2:]
    inner1 = ~border
    inner2 = ~(border[:-1] & border[1:])
    inner3 = ~border[1:-1]
    # a gram belongs to the word that its first letter is in
    owner = [word[inner1], word[:-1][inner2], word[1:-1][inner3]]
    # the border before a word counts for it, the one after it is already the next one's
    value = [one[inner1], two[inner2] ^ (1 << 40), three[inner3] ^ (1 << 50)]
    mixed = np.concatenate(value).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    first = codes[np.flatnonzero(border)[:-1] + 1]
    script = _SCRIPT_OF[np.searchsorted(_STARTS, first, "right") - 1]
    return np.concatenate(owner), bucket, script


@dataclass
class Model:
    """Log probabilities of buckets per language, and the candidate languages of each script."""

    langs: list[str]
    logp: np.ndarray
    candidate: np.ndarray

    def score(self, words: list[str]) -> np.ndarray:
        """A row per word: how far each language is below the best one, at most a fixed margin.

        Words of a script that no language uses score nothing. The last column is 1 for others.
        """
        owner, bucket, script = grams(words)
        rows = np.stack(
            [np.bincount(owner, p[bucket], minlength=len(words))[: len(words)] for p in self.logp],
            axis=1,
        )
        allowed = self.candidate[script]
        rows = np.where(allowed, rows, -np.inf)
        best = rows.max(axis=1, keepdims=True)
        lettered = np.fromiter((any(map(str.isalpha, w)) for w in words), bool, len(words))
        known = np.isfinite(best) & lettered[:, None]
        rows = np.where(known, rows - np.where(known, best, 0.0), 0.0)
        return np.hstack([np.maximum(rows, -MOST_MARGIN), known]).astype(np.float32)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each word on the best path, where a change costs ``switch``."""
    total = scores.sum(axis=0, dtype=np.float64)
    main = int(total.argmax())
    rest = np.delete(scores, main, axis=1)
    if not rest.shape[1]:
        return np.zeros(len(scores), int)
    # leaving the main language gains at most the largest sum over a stretch, and costs a change
    gain = np.cumsum(rest.max(axis=1) - scores[:, main], dtype=np.float64)
    lowest = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))
    if (gain - lowest).max() <= switch:
        return np.full(len(scores), main)
    best = np.zeros(scores.shape[1])
    back = np.empty(scores.shape, np.int32)
    own = np.arange(scores.shape[1])
    for t, row in enumerate(scores):
        top = int(best.argmax())
        moved = best[top] - switch
        stays = best >= moved
        back[t] = np.where(stays, own, top)
        best = np.where(stays, best, moved) + row
    path = np.empty(len(scores), int)
    at = int(best.argmax())
    for t in range(len(scores) - 1, -1, -1):
        path[t] = at
        at = back[t, at]
    return path


def fit(
    docs: DataFrame, lang: str = "lang", text: str = "text", train_rows: int = TRAIN_ROWS,
    doc_id: str = "doc_id",
) -> Model:
    """Count n-grams and scripts per language over about ``train_rows`` labelled documents.

    Only counts per language and bucket reach the driver. Rows without a label teach nothing.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"),
        F.col(text).alias("text"),
    ).filter(F.col("lang").isNotNull())
    drawn = within(rows, F.col("doc_id"), train_rows)

    def counted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, group in batch.groupby("lang"):
                words = [w for t in group["text"] for w in words_of(t)]
                if not words:
                    continue
                _, bucket, script = grams(words)
                size = np.fromiter(map(len, words), np.int64, len(words))
                line = found.setdefault(name, np.zeros(BUCKETS + len(_NAMES), np.int64))
                line[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                line[BUCKETS:] += np.bincount(script, size, minlength=len(_NAMES)).astype(np.int64)
        for name, line in found.items():
            at = np.flatnonzero(line)
            yield pd.DataFrame({"lang": name, "bucket": at, "n": line[at]})

    counts = (
        spread(drawn, ["lang", "text"])
        .mapInPandas(counted, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    langs = sorted(counts["lang"].unique())
    seen = np.zeros((len(langs), BUCKETS + len(_NAMES)))
    seen[[langs.index(x) for x in counts["lang"]], counts["bucket"].astype(int)] = counts["n"]
    grams_seen, letters = seen[:, :BUCKETS], seen[:, BUCKETS:]
    logp = np.log((grams_seen + 0.5) / (grams_seen.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    # overlapping n-grams count a letter about three times
    return Model(langs, (logp / 3).astype(np.float32), share.T >= CANDIDATE_SHARE)


class Labeller:
    """A model with the scores of words seen before, bounded, for one worker."""

    MOST_WORDS = 400_000

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs) + 1), np.float32)

    def _look_up(self, fresh: list[str]) -> None:
        if not fresh:
            return
        if len(self.at) + len(fresh) > len(self.rows):
            more = np.zeros((len(self.at) + 2 * len(fresh), self.rows.shape[1]), np.float32)
            more[: len(self.at)] = self.rows[: len(self.at)]
            self.rows = more
        first = len(self.at)
        self.at.update(zip(fresh, range(first, first + len(fresh))))
        self.rows[first : first + len(fresh)] = self.model.score(fresh)

    def label(self, texts: Iterable[object]) -> pd.DataFrame:
        if len(self.at) > self.MOST_WORDS:
            self.at, self.rows = {}, self.rows[:0]
        lists = [words_of(t) for t in texts]
        langs = self.model.langs
        if langs:
            self._look_up([w for w in set().union(*lists) if w not in self.at])
        out = []
        for words in lists:
            if not words or not langs:
                out.append((UNKNOWN, 0.0, []))
                continue
            scores = self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]
            path = viterbi(scores[:, :-1], self.switch)
            letters = np.fromiter(map(len, words), np.float64, len(words)) * scores[:, -1]
            if not letters.any() and not any(c.isalpha() for w in words for c in w):
                out.append((UNKNOWN, 0.0, []))
                continue
            held = np.bincount(path, letters, minlength=len(langs))
            top = int(held.argmax())
            edges = np.flatnonzero(np.diff(path, prepend=-1, append=-1))
            spans = [
                {"lang": langs[path[a]], "first_word": int(a), "n_words": int(b - a)}
                for a, b in zip(edges[:-1], edges[1:])
            ]
            out.append((langs[top], float(held[top] / max(letters.sum(), 1.0)), spans))
        return pd.DataFrame(out, columns=["lang_pred", "score", "spans"])


def language_of(spark: SparkSession, model: Model, switch: float = SWITCH) -> Callable:
    """A column function from text to the struct ``lang_pred, score, spans``."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(f"lang_pred string, score double, spans {SPANS}")
    def language(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value, switch)
        for batch in texts:
            yield labeller.label(batch)

    return language


def identify(
    docs: DataFrame,
    model: Model,
    doc_id: str = "doc_id",
    text: str = "text",
    switch: float = SWITCH,
) -> DataFrame:
    """Language of every whole text: ``doc_id, lang_pred, score, spans``.

    The script of a word's first letter leaves the languages that use it; each of them scores the
    word's n-grams; Viterbi with a cost for changes labels the words. The language with most letters
    is the text's, ``score`` is its share of them, and ``spans`` are the runs of words by language.

    Null texts and texts without a letter are ``und`` with score 0, as are all texts where nothing
    was learned. Letters of a script that no learned language uses count for nothing. Repeated rows
    get the same answer each; a null id stays null. One pass, no shuffle; a worker's memory of
    scored words is bounded. Only the two named columns are read.
    """
    language = language_of(docs.sparkSession, model, switch)
    rows = spread(docs, [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")])
    return rows.select("doc_id", language("text").alias("found")).select("doc_id", "found.*")


def learn(docs: DataFrame) -> Model:
    """The model of the documents outside the held-out fold."""
    return fit(docs.filter(fold(F.col("doc_id"), HELD_OUT_FOLDS) != HELD_OUT))


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select(
        "doc_id",
        (fold(F.col("doc_id"), HELD_OUT_FOLDS) == HELD_OUT).alias("held_out"),
        "lang_pred", "score",
    )
