"""Sentiment of a text from rated words and where they stand, as array expressions.

Rated words count more in capitals and after a booster, are turned by a negation before them, and
lose or gain weight around a contrast word; exclamation marks add to the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain.functions.fixed_values import SPACE, WORD

# The constants that the published rule set for rated words found by experiment.
CAPITALS = 0.733
BOOST = 0.293
NEGATION = -0.74
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5
NORMALISER = 15

#: What a booster is worth one, two and three words before a rated word, and how far a negation reaches.
FADING = (1.0, 0.95, 0.9)
CONTRAST = "but"

# Common English adverbs of degree and negations; both are parameters.
STRONGER = (
    "absolutely", "completely", "deeply", "especially", "extremely", "highly", "incredibly", "more", "most",
    "particularly", "quite", "really", "remarkably", "so", "totally", "truly", "very",
)
WEAKER = ("almost", "barely", "hardly", "kinda", "less", "little", "partly", "scarcely", "slightly", "somewhat")
NEGATIONS = (
    "ain't", "aren't", "can't", "cannot", "couldn't", "didn't", "doesn't", "don't", "hasn't", "haven't", "isn't",
    "neither", "never", "no", "nobody", "none", "nor", "not", "nothing", "nowhere", "shouldn't", "wasn't", "weren't",
    "without", "won't", "wouldn't",
)


def plain_words(text: Column) -> Column:
    """Words between white space in their case, without the marks around them; none for null."""
    pieces = F.transform(
        F.split(text, f"[{SPACE}]+"), lambda w: F.regexp_replace(w, f"^[^{WORD}]+|[^{WORD}]+$", "")
    )
    return F.coalesce(F.filter(pieces, lambda w: w != ""), F.array().cast("array<string>"))


def in_capitals(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def last_place(words: Column, word: str) -> Column:
    """Place of the last ``word`` counted from 0; null where there is none."""
    return F.when(F.array_contains(words, word), F.size(words) - F.array_position(F.reverse(words), word))


def word_scores(
    stronger: Sequence[str] = STRONGER, weaker: Sequence[str] = WEAKER, negations: Sequence[str] = NEGATIONS
) -> Column:
    """The score of every word, 0 for one that is not rated.

    Reads ``words`` in their case and ``lower``; ``rated``, a map from lower-case words to valences or
    null; ``mixed``, whether some word is not in capitals; and ``contrast``, the place of the last
    contrast word or null. All are read for each word, so they have to be stored columns.
    """
    lower, contrast = F.col("lower"), F.col("contrast")

    def score(value: Column, at: Column) -> Column:
        sign = F.signum(value)
        total = value + F.when(F.col("mixed") & in_capitals(F.get("words", at)), sign * CAPITALS).otherwise(0.0)
        turned = F.lit(False)
        for distance, weight in enumerate(FADING, 1):
            before = F.get(lower, at - distance)
            boost = F.when(before.isin(*stronger), BOOST * weight).when(before.isin(*weaker), -BOOST * weight)
            total = total + sign * F.coalesce(boost, F.lit(0.0))
            turned = turned | F.coalesce(before.isin(*negations), F.lit(False))
        total = F.when(turned, total * NEGATION).otherwise(total)
        side = F.when(at < contrast, BEFORE_CONTRAST).when(at > contrast, AFTER_CONTRAST).otherwise(1.0)
        return F.when(value.isNull(), 0.0).otherwise(F.coalesce(total * side, F.lit(0.0)))

    # a map is searched from end to end, so once a word and not wherever its value is used
    return F.transform(F.transform(lower, lambda w: F.element_at("rated", w)), score)


def compound(scores: Column, marks: Column) -> Column:
    """One number from -1 to 1 out of word scores and exclamation marks; 0 without rated words."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    raised = total + F.signum(total) * EXCLAMATION * F.least(marks, F.lit(MOST_EXCLAMATIONS))
    return raised / F.sqrt(raised * raised + NORMALISER)
