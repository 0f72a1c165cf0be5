"""Text and token-array expressions.

Spark's ``\\w``, ``\\d`` and ``\\s`` are ASCII-only, so the classes are spelled out to cover the
same characters as a Unicode-aware tokeniser.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain.functions.fixed_values import (
    ENGLISH_STOP_WORDS,
    SPACE,
    TOKEN_PATTERN,
    TWO_CHARACTER_PATTERN,
    WORD,
    WORD_OR_MARK_PATTERN,
)


def lowercase(text: Column) -> Column:
    return F.lower(text)


def strip_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Nd}+", "")


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{WORD}{SPACE}]+", "")


def _without(tokens: Column, stop_words: Sequence[str]) -> Column:
    # a long literal list becomes a hash set lookup
    return F.filter(tokens, lambda x: (x != "") & ~F.lower(x).isin(*stop_words))


def strip_stop_words(text: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Drop stop words from a text split on white space; case does not matter."""
    return F.array_join(_without(F.split(text, f"[{SPACE}]+"), stop_words), " ")


def tokens(text: Column) -> Column:
    """Words joined by hyphen, apostrophe or full stop, with an optional leading @ or #."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def clean_tokens(text: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Lowercase, drop digits and punctuation, drop stop words, tokenise.

    One replacement removes digits and punctuation together, and since only word characters and
    white space are left, splitting gives the tokens: two passes over the text in place of five.
    """
    kept = rf"\p{{L}}\p{{Nl}}\p{{No}}_{SPACE}"
    bare = F.regexp_replace(F.lower(text), f"[^{kept}]+", "")
    return F.filter(
        F.split(bare, f"[{SPACE}]+"), lambda x: (x != "") & ~x.isin(*stop_words)
    )


def words(text: Column) -> Column:
    """Words and, one by one, the punctuation marks between them."""
    return F.regexp_extract_all(text, F.lit(WORD_OR_MARK_PATTERN), F.lit(0))


def tidy_words(word_array: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Lowercase words without marks, stop words and all-digit words."""
    return F.filter(
        F.transform(word_array, F.lower),
        lambda x: x.rlike(f"[{WORD}]") & ~x.isin(*stop_words) & ~x.rlike(r"^\p{Nd}+$"),
    )


def alphabetic_words(text: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Lowercase words made of letters only, without stop words."""
    return F.filter(
        words(F.lower(text)), lambda x: x.rlike(r"^\p{L}+$") & ~x.isin(*stop_words)
    )


def long_words(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lowercase tokens of at least two word characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TWO_CHARACTER_PATTERN), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(*stop_words)) if stop_words else found


def join_tokens(token_array: Column) -> Column:
    return F.array_join(token_array, " ")


def token_count(token_array: Column) -> Column:
    return F.size(token_array).cast("bigint")


def sentence_count(text: Column) -> Column:
    """Non-blank pieces between runs of sentence marks."""
    pieces = F.split(text, rf"[.!?]+(?:[{SPACE}]+|$)")
    return F.size(F.filter(pieces, lambda x: x.rlike(f"[^{SPACE}]"))).cast("bigint")


def locale_sentence_count(text: Column, language: str = "en", country: str = "US") -> Column:
    """Sentences found by the locale's break rules."""
    return F.size(F.sentences(text, F.lit(language), F.lit(country))).cast("bigint")


def truncate(token_array: Column, length: int = 512) -> Column:
    return F.slice(token_array, 1, length)


def pad(token_array: Column, width: Column, filler: str = "<pad>") -> Column:
    """Fill an array up to ``width`` entries."""
    missing = F.greatest(width.cast("int") - F.size(token_array), F.lit(0))
    return F.concat(token_array, F.array_repeat(F.lit(filler), missing))


def topic_name(topic: Column, top_words: Column, from_rank: int = 1, n_words: int = 3) -> Column:
    """``Topic i: a, b, c`` from words in descending order, starting at ``from_rank``."""
    shown = F.array_join(F.slice(top_words, from_rank, n_words), ", ")
    return F.concat(F.lit("Topic "), topic.cast("string"), F.lit(": "), shown)


def parse_topic_name(name: Column) -> tuple[Column, Column]:
    """The key and the words of a display name; the words keep their leading blank."""
    parts = F.split(name, ":")
    return parts[0], parts[1]


def sentiment(valence_sum: Column) -> Column:
    """Texts without any rated word count as positive."""
    return F.when(F.coalesce(valence_sum, F.lit(0.0)) >= 0, "positive").otherwise("negative")
