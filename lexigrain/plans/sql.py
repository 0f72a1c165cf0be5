"""SQL fragments shared by the checks. They follow the definitions step by step."""

from __future__ import annotations

from lexigrain.functions.fixed_values import (
    ENGLISH_STOP_WORDS,
    SPACE,
    TOKEN_PATTERN,
    TWO_CHARACTER_PATTERN,
    WORD,
    WORD_OR_MARK_PATTERN,
)


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = "(" + ", ".join(quote(w) for w in ENGLISH_STOP_WORDS) + ")"

NO_DIGITS = r"regexp_replace({0}, '\p{{Nd}}+', '', 'g')"
NO_PUNCTUATION = "regexp_replace({0}, '[^" + f"{WORD}{SPACE}".replace("{", "{{").replace("}", "}}") + "]', '', 'g')"
_SPLIT = "string_split_regex({0}, '[" + SPACE.replace("{", "{{").replace("}", "}}") + "]+')"


def no_digits(x: str) -> str:
    return NO_DIGITS.format(x)


def no_punctuation(x: str) -> str:
    return NO_PUNCTUATION.format(x)


def no_stop_words(x: str) -> str:
    split = _SPLIT.format(x)
    return (
        f"array_to_string(list_filter({split}, "
        f"lambda x: x <> '' AND lower(x) NOT IN {STOP}), ' ')"
    )


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {quote(TOKEN_PATTERN)})"


def clean(x: str) -> str:
    return tokens(no_stop_words(no_punctuation(no_digits(f"lower({x})"))))


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {quote(WORD_OR_MARK_PATTERN)})"


def tidy(x: str) -> str:
    return (
        f"list_filter(list_transform({x}, lambda w: lower(w)), lambda w: "
        f"regexp_matches(w, '[{WORD}]') AND w NOT IN {STOP} "
        rf"AND NOT regexp_full_match(w, '\p{{Nd}}+'))"
    )


def alphabetic(x: str) -> str:
    return (
        f"list_filter({words(f'lower({x})')}, lambda w: "
        rf"regexp_full_match(w, '\p{{L}}+') AND w NOT IN {STOP})"
    )


def long_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {quote(TWO_CHARACTER_PATTERN)})"


def sentences(x: str) -> str:
    return (
        f"len(list_filter(string_split_regex({x}, '[.!?]+([{SPACE}]+|$)'), "
        f"lambda s: regexp_matches(s, '[^{SPACE}]')))"
    )


def round4(x: str) -> str:
    return f"round_even(CAST({x} AS DOUBLE), 4)"


def uniform(key: str, seed: int | str) -> str:
    return (
        f"(CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 13) AS BIGINT)"
        f" / 4503599627370496.0::DOUBLE)"
    )


# Cleaned tokens of all documents, one row each; pos counts from 0.
DOC_TOKENS = f"""
cleaned AS (SELECT doc_id, lang, source, {clean('text')} AS toks FROM documents),
tok AS (SELECT doc_id, lang, source, unnest(toks) AS token,
               generate_subscripts(toks, 1) - 1 AS pos FROM cleaned)
"""
