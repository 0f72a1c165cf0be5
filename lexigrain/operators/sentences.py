"""Sentence borders from statistics of the corpus itself.

A full stop after an abbreviation does not end a sentence. Abbreviations are not listed but found:
they are short, seldom stand without their full stop, and often contain further ones. The measure is
the log-likelihood ratio of a word and its full stop, scaled by length, inner full stops and
occurrences without one (Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection",
2006).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.fixed_values import SPACE, WORD
from lexigrain.operators.joins import lookup_join
from lexigrain.session import colocate, persisted

#: Share of an abbreviation's occurrences that carry a full stop.
STOPPED_SHARE = 0.99
#: Least scaled ratio of an abbreviation.
LEAST_SCORE = 0.3


def marked_words(text: Column) -> Column:
    """The words of a text as an array of (core, mark, upper).

    ``core`` is the lower-case word without outer punctuation and with each run of digits as ``#``;
    ``mark`` the sentence marks behind it, empty if there is none; ``upper`` whether it starts with
    a capital. Marks that stand alone belong to the word before them; what holds no word character
    is left out.
    """
    joined = F.regexp_replace(text, rf"[{SPACE}]+([.!?]+)([{SPACE}]|$)", "$1$2")
    pieces = F.split(joined, f"[{SPACE}]+")

    def cut(piece: Column) -> Column:
        bare = F.regexp_replace(piece, f"^[^{WORD}]+|[^{WORD}]+$", "")
        return F.struct(
            F.regexp_replace(F.lower(bare), r"\p{Nd}+", "#").alias("core"),
            F.regexp_extract(piece, rf"([.!?]+)[^{WORD}.!?]*$", 1).alias("mark"),
            bare.rlike(r"^\p{Lu}").alias("upper"),
        )

    return F.filter(F.transform(pieces, cut), lambda w: w["core"] != "")


def border_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per word of the corpus: ``token, n, n_stopped, score, abbreviation, opener``.

    ``n`` counts occurrences, ``n_stopped`` those before a single full stop. ``score`` is null for
    words that never stand before one and for those without a letter that are no numbers.
    ``opener`` marks words that occur in lower case and never with a capital behind a word without
    a sentence mark: with a capital, such a word begins a sentence.

    Null and empty texts have no words; repeated rows count as often as they occur. An empty table
    gives no row. Counts combine before the shuffle; the corpus totals are two numbers.
    """
    words = df.select(marked_words(F.col(text)).alias("ws"))
    rows = words.select(
        F.explode(
            F.transform(
                "ws",
                lambda w, i: F.struct(
                    w["core"].alias("token"), w["mark"].alias("mark"), w["upper"].alias("upper"),
                    F.get(F.col("ws"), i - 1)["mark"].alias("before"),
                ),
            )
        ).alias("w")
    ).select("w.*")
    counted = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("mark") == ".").alias("n_stopped"),
        F.count_if(~F.col("upper")).alias("n_lower"),
        F.count_if(F.col("upper") & (F.col("before") == "")).alias("n_inside"),
    )
    counted = persisted(counted, "words")
    n_all, n_all_stopped = counted.agg(F.sum("n"), F.sum("n_stopped")).first()

    stopped, other = F.col("n_stopped"), F.col("n") - F.col("n_stopped")
    share = F.lit((n_all_stopped or 0) / (n_all or 1))
    # a logarithm of zero only meets words that have no such occurrence
    rest = F.when(other > 0, other * (F.log(F.lit(1 - STOPPED_SHARE)) - F.log(1 - share)))
    ratio = 2 * (
        stopped * (F.log(F.lit(STOPPED_SHARE)) - F.log(share)) + F.coalesce(rest, F.lit(0.0))
    )
    inner = F.length("token") - F.length(F.replace(F.col("token"), F.lit("."), F.lit("")))
    length = F.length("token") - inner
    scaled = ratio * F.exp(-length) * (inner + 1) * F.pow(length.cast("double"), -other)
    scored = F.when((stopped > 0) & F.col("token").rlike(r"\p{L}|^#$"), scaled)
    return counted.select(
        "token", "n", "n_stopped", F.round(scored, 6).alias("score"),
        F.coalesce(scored >= LEAST_SCORE, F.lit(False)).alias("abbreviation"),
        ((F.col("n_lower") > 0) & (F.col("n_inside") == 0)).alias("opener"),
    )


def _is_border(place: Column, abbreviations: Column, openers: Column) -> Column:
    mark, core = place["mark"], place["core"]
    opened = place["next_upper"] & F.array_contains(openers, place["next"])
    initial = place["upper"] & core.rlike(r"^\p{L}$")
    return (
        F.when(mark.rlike("[!?]"), True)
        .when(F.length(mark) > 1, place["next_upper"])
        .when(initial, False)
        .when(F.array_contains(abbreviations, core), opened)
        .otherwise(True)
    )


def sentence_counts(
    df: DataFrame, statistics: DataFrame, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``doc_id, sentences`` of every row of ``df``; other columns are not read.

    ``statistics`` is a stored table of ``border_statistics``, of this or another corpus; words it
    lacks are neither abbreviations nor openers. Between two words a sentence ends

    * at ``!`` or ``?``;
    * at two or more full stops, if the next word has a capital;
    * at one full stop, unless the word is an initial (one capital letter), or an abbreviation whose
      next word is no opener with a capital.

    A text with a word has at least one sentence, null and empty texts have none; repeated rows each
    give a row. Each text is cut once and stays one row: only its different words beside a full stop
    are looked up, and what is found comes back as two lists.
    """
    cut = colocate(df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_id")
    words = cut.select("_id", marked_words(F.col("_text")).alias("ws"))

    def place(w: Column, i: Column) -> Column:
        after = F.get(F.col("ws"), i + 1)
        return F.struct(
            w["core"].alias("core"), w["mark"].alias("mark"), w["upper"].alias("upper"),
            after["core"].alias("next"), after["upper"].alias("next_upper"),
        )

    marked = F.filter(F.transform("ws", place), lambda p: (p["mark"] != "") & p["next"].isNotNull())
    has_words = (F.coalesce(F.size("ws"), F.lit(0)) > 0).alias("has_words")
    placed = persisted(words.select("_id", has_words, marked.alias("places")), "places")

    stops = F.filter("places", lambda p: p["mark"] == ".")
    sides = F.concat(F.transform(stops, lambda p: p["core"]), F.transform(stops, lambda p: p["next"]))
    asked = placed.select("_id", F.explode(F.array_distinct(sides)).alias("token"))
    telling = statistics.filter("abbreviation OR opener").select("token", "n", "abbreviation", "opener")
    found = lookup_join(asked, persisted(telling, "telling"), ["token"], "n", ["_id"])
    lists = found.groupBy(F.col("_id").alias("_of")).agg(
        F.collect_set(F.when(F.col("abbreviation"), F.col("token"))).alias("abbreviations"),
        F.collect_set(F.when(F.col("opener"), F.col("token"))).alias("openers"),
    )
    none = F.array().cast("array<string>")
    known = placed.join(lists, F.col("_id").eqNullSafe(F.col("_of")), "left").select(
        "_id", "has_words", "places",
        F.coalesce("abbreviations", none).alias("abbreviations"), F.coalesce("openers", none).alias("openers"),
    )
    borders = F.filter("places", lambda p: _is_border(p, F.col("abbreviations"), F.col("openers")))
    counted = F.when(F.col("has_words"), F.size(borders) + 1).otherwise(0)
    return known.select(F.col("_id").alias(doc_id), counted.cast("bigint").alias("sentences"))
