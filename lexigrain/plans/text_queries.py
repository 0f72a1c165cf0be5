"""Text and token-array queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain.functions import sentiment as rules
from lexigrain.functions import text
from lexigrain.functions.fixed_values import SPACE, WORD
from lexigrain.operators import sentences, splits
from lexigrain.operators.features import counted_terms, sentiment_by_lexicon
from lexigrain.operators.labels import category_codes
from lexigrain.operators.sentiment import sentiment_by_rules
from lexigrain.operators.vocab import top_tokens
from lexigrain.plans import sql
from lexigrain.plans.registry import query
from lexigrain.session import colocate, persisted, widen
from lexigrain.sources import read_table


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return widen(read_table(spark, folder, "documents").select("doc_id", "text"))


def _each(spark: SparkSession, folder: str, expression: Column, name: str) -> DataFrame:
    return _texts(spark, folder).select("doc_id", expression.alias(name))


def _joined(array_sql: str) -> str:
    return f"SELECT doc_id, array_to_string({array_sql}, ' ') AS tokens FROM documents"



@query("SELECT doc_id, lower(text) AS text FROM documents")
def c01_lowercase(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, text.lowercase(F.col("text")), "text")


@query(f"SELECT doc_id, {sql.no_digits('text')} AS text FROM documents")
def c02_strip_digits(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, text.strip_digits(F.col("text")), "text")


@query(f"SELECT doc_id, {sql.no_punctuation('text')} AS text FROM documents")
def c03_strip_punctuation(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, text.strip_punctuation(F.col("text")), "text")


@query(f"SELECT doc_id, {sql.no_stop_words('text')} AS text FROM documents")
def c04_strip_stop_words(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, text.strip_stop_words(F.col("text")), "text")


@query(_joined(sql.tokens("text")))
def c05_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, text.join_tokens(text.tokens(F.col("text"))), "tokens")


@query(_joined(sql.clean("text")))
def c06_clean_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, text.join_tokens(text.clean_tokens(F.col("text"))), "tokens")


@query(_joined(sql.words("text")))
def c07_words_and_marks(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, text.join_tokens(text.words(F.col("text"))), "tokens")


@query(_joined(sql.tidy(sql.words("text"))))
def c08_tidy_words(spark: SparkSession, folder: str) -> DataFrame:
    tidy = text.tidy_words(text.words(F.col("text")))
    return _each(spark, folder, text.join_tokens(tidy), "tokens")


@query(
    f"""SELECT conv_id, turn, role, array_to_string({sql.words('text')}, ' ') AS tokens
        FROM conversations"""
)
def c09_join_tokens(spark: SparkSession, folder: str) -> DataFrame:
    turns = widen(read_table(spark, folder, "conversations"))
    joined = text.join_tokens(text.words(F.col("text")))
    return turns.select("conv_id", "turn", "role", joined.alias("tokens"))


@query(_joined(sql.alphabetic("text")))
def c10_alphabetic_words(spark: SparkSession, folder: str) -> DataFrame:
    return _each(
        spark, folder, text.join_tokens(text.alphabetic_words(F.col("text"))), "tokens"
    )


@query(
    f"""SELECT doc_id, CAST(len({sql.words('text')}) AS BIGINT) AS raw_tokens,
               CAST(len({sql.tidy(sql.words('text'))}) AS BIGINT) AS tidy_tokens FROM documents"""
)
def c11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = _texts(spark, folder).select("doc_id", text.words(F.col("text")).alias("w"))
    return found.select(
        "doc_id",
        text.token_count(F.col("w")).alias("raw_tokens"),
        text.token_count(text.tidy_words(F.col("w"))).alias("tidy_tokens"),
    )


@query(f"SELECT doc_id, CAST({sql.sentences('text')} AS BIGINT) AS sentences FROM documents")
def c12_sentence_count(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, text.sentence_count(F.col("text")), "sentences")


@query()
def c12_sentence_count_by_locale(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, text.locale_sentence_count(F.col("text")), "sentences")


_BORDER_SQL = f"""
 pieces AS (SELECT doc_id, string_split_regex(
              regexp_replace(text, '[{SPACE}]+([.!?]+)([{SPACE}]|$)', '\\1\\2', 'g'), '[{SPACE}]+') AS ps FROM documents),
 piece AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM pieces),
 bare AS (SELECT doc_id, i, regexp_replace(p, '^[^{WORD}]+|[^{WORD}]+$', '', 'g') AS b,
                 regexp_extract(p, '([.!?]+)[^{WORD}.!?]*$', 1) AS mark FROM piece),
 w AS (SELECT doc_id, i, regexp_replace(lower(b), '\\p{{Nd}}+', '#', 'g') AS token, mark,
              regexp_matches(b, '^\\p{{Lu}}') AS upper FROM bare WHERE b <> ''),
 seen AS (SELECT *, lag(mark) OVER by_place AS before, lead(token) OVER by_place AS next,
                 lead(upper) OVER by_place AS next_upper FROM w WINDOW by_place AS (PARTITION BY doc_id ORDER BY i)),
 counted AS (SELECT token, count(*) AS n, count(*) FILTER (mark = '.') AS k, count(*) FILTER (NOT upper) AS n_lower,
                    count(*) FILTER (upper AND before = '') AS n_inside FROM seen GROUP BY token),
 shares AS (SELECT *, sum(k) OVER () / sum(n) OVER () AS p, length(token) - length(replace(token, '.', '')) AS dots
            FROM counted),
 scored AS (SELECT *, CASE WHEN k > 0 AND regexp_matches(token, '\\p{{L}}|^#$') THEN
              2 * (k * (ln({sentences.STOPPED_SHARE}::DOUBLE) - ln(p)) + CASE WHEN n > k THEN
                     (n - k) * (ln({1 - sentences.STOPPED_SHARE}::DOUBLE) - ln(1 - p)) ELSE 0 END)
              * exp(-(length(token) - dots)) * (dots + 1) * pow((length(token) - dots)::DOUBLE, k - n) END AS s FROM shares),
 stats AS (SELECT token, n, k AS n_stopped, round(s, 6) AS score,
                  coalesce(s >= {sentences.LEAST_SCORE}, false) AS abbreviation,
                  n_lower > 0 AND n_inside = 0 AS opener FROM scored)"""


@query(f"WITH {_BORDER_SQL} SELECT * FROM stats")
def c12_abbreviations(spark: SparkSession, folder: str) -> DataFrame:
    """Every word with the measure by which abbreviations are found in the corpus."""
    return sentences.border_statistics(_texts(spark, folder))


@query(
    f"""WITH {_BORDER_SQL},
     ends AS (SELECT doc_id, CASE WHEN regexp_matches(mark, '[!?]') THEN true WHEN length(mark) > 1 THEN next_upper
                WHEN upper AND regexp_full_match(seen.token, '\\p{{L}}') THEN false
                WHEN a.abbreviation THEN next_upper AND coalesce(o.opener, false) ELSE true END AS border
              FROM seen JOIN stats a ON seen.token = a.token LEFT JOIN stats o ON next = o.token
              WHERE mark <> '' AND next IS NOT NULL),
     per_doc AS (SELECT doc_id, count(*) FILTER (border) AS n FROM ends GROUP BY doc_id)
     SELECT d.doc_id, CASE WHEN d.doc_id IN (SELECT doc_id FROM w) THEN coalesce(n, 0) + 1 ELSE 0 END AS sentences
     FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id"""
)
def c12_sentence_count_by_borders(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences whose borders respect abbreviations and initials learned from the documents."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return sentences.sentence_counts(docs, persisted(sentences.border_statistics(widen(docs)), "borders"))


@query(f"SELECT doc_id, CAST(len({sql.words('text')}) AS BIGINT) AS words FROM documents")
def c13_word_count(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, text.token_count(text.words(F.col("text"))), "words")


@query(_joined(f"list_slice({sql.words('text')}, 1, 512)"))
def c14_truncate(spark: SparkSession, folder: str) -> DataFrame:
    cut = text.truncate(text.words(F.col("text")), 512)
    return _each(spark, folder, text.join_tokens(cut), "tokens")


@query(
    f"""WITH t AS (SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 16 AS BIGINT) AS batch,
                          list_slice({sql.words('text')}, 1, 512) AS w FROM documents),
             b AS (SELECT *, max(len(w)) OVER (PARTITION BY batch) AS width FROM t)
        SELECT doc_id, batch, array_to_string(
            list_concat(w, list_transform(range(width - len(w)), lambda i: '<pad>')), ' ') AS tokens
        FROM b"""
)
def c15_pad_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Rows are numbered by their id alone, so texts are not carried through the ranking."""
    ids = read_table(spark, folder, "documents").select("doc_id")
    batches = splits.batches(ids, "doc_id", 16)
    cut = _texts(spark, folder).select(
        "doc_id", text.truncate(text.words(F.col("text")), 512).alias("w")
    )
    numbered = cut.join(batches, "doc_id")
    width = F.max(F.size("w")).over(Window.partitionBy("batch"))
    padded = numbered.withColumn("width", width)
    return padded.select(
        "doc_id", "batch", text.join_tokens(text.pad(F.col("w"), F.col("width"))).alias("tokens")
    )


@query(
    f"""WITH {sql.DOC_TOKENS},
         c AS (SELECT lang, token, count(*) AS n, min(doc_id * 16777216 + pos) AS f
               FROM tok GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, f) AS rk FROM c),
         t AS (SELECT lang, list(token ORDER BY rk) AS w FROM r WHERE rk <= 10 GROUP BY lang),
         k AS (SELECT lang, w, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS topic FROM t)
        SELECT topic, 'Topic ' || topic || ': ' || array_to_string(w[1:3], ', ') AS name,
               'Topic ' || topic AS topic_key, ' ' || array_to_string(w[1:3], ', ') AS topic_words,
               'Topic ' || topic || ': ' || array_to_string(w[8:10], ', ') AS name_from_rank_8
        FROM k"""
)
def c16_topic_names(spark: SparkSession, folder: str) -> DataFrame:
    """Display names from the ten strongest words; languages stand in for topics."""
    docs = widen(read_table(spark, folder, "documents").select("doc_id", "lang", "text"))
    top = top_tokens(docs, "lang", text.clean_tokens(F.col("text")), 10)
    ranked = F.array_sort(F.collect_list(F.struct("rk", "token")))
    lists = top.groupBy("lang").agg(F.transform(ranked, lambda x: x["token"]).alias("w"))
    topics = lists.join(category_codes(docs, "lang", "topic"), "lang")
    named = topics.select(
        "topic",
        text.topic_name(F.col("topic"), F.col("w")).alias("name"),
        text.topic_name(F.col("topic"), F.col("w"), from_rank=8).alias("name_from_rank_8"),
    )
    key, words = text.parse_topic_name(F.col("name"))
    return named.withColumn("topic_key", key).withColumn("topic_words", words)


@query(
    f"""SELECT doc_id, string_agg(w || '=' || n, ',' ORDER BY w) AS frequencies FROM (
          SELECT doc_id, w, count(*) AS n FROM
            (SELECT doc_id, unnest({sql.alphabetic('text')}) AS w FROM documents) GROUP BY ALL)
        GROUP BY doc_id"""
)
def c17_word_frequency_maps(spark: SparkSession, folder: str) -> DataFrame:
    """A map per document that has words, counted inside the row."""
    docs = widen(read_table(spark, folder, "documents").select("doc_id", "text"))
    counted = counted_terms(docs, text.alphabetic_words(F.col("text")))
    # a filter on a generated column stays above the tokens, which are then made once
    runs = counted.select("doc_id", F.explode_outer(F.array("runs")).alias("runs")).filter(F.size("runs") > 0)
    maps = runs.select("doc_id", F.map_from_entries("runs").alias("m"))
    shown = F.transform(
        F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return maps.select("doc_id", F.array_join(shown, ",").alias("frequencies"))


# The sentiment lexicon is a user table; here short words are rated by a rule on their letters.
_VALENCE_SQL = """lex AS (SELECT token, CAST(ascii(token) % 7 - 3 AS DOUBLE) AS valence
                          FROM (SELECT DISTINCT token FROM tok) WHERE length(token) <= 4)"""


def rated_words(spark: SparkSession, folder: str) -> DataFrame:
    docs = widen(read_table(spark, folder, "documents").select("text"))
    found = docs.select(F.explode(text.clean_tokens(F.col("text"))).alias("token"))
    valence = (F.ascii("token") % 7 - 3).cast("double").alias("valence")
    return (
        found.filter(F.length("token") <= 4)
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("cf"))
        .select("token", "cf", valence)
    )


@query(
    f"""WITH {sql.DOC_TOKENS}, {_VALENCE_SQL},
          s AS (SELECT doc_id, sum(valence) AS v FROM tok JOIN lex USING (token) GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN coalesce(v, 0) >= 0 THEN 'positive' ELSE 'negative' END AS sentiment
        FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id"""
)
def c18_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    docs = colocate(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    lexicon = persisted(rated_words(spark, folder), "lexicon")
    return sentiment_by_lexicon(docs, text.clean_tokens(F.col("text")), lexicon)


def _rules_sql() -> str:
    def listed(words: Sequence[str]) -> str:
        return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"

    boosts = " + ".join(
        f"CASE WHEN b{i} IN {listed(rules.STRONGER)} THEN sign(valence) * {rules.BOOST * fade}::DOUBLE "
        f"WHEN b{i} IN {listed(rules.WEAKER)} THEN sign(valence) * {-rules.BOOST * fade}::DOUBLE ELSE 0 END"
        for i, fade in enumerate(rules.FADING, 1)
    )
    turned = " OR ".join(f"coalesce(b{i} IN {listed(rules.NEGATIONS)}, false)" for i in (1, 2, 3))
    before = ", ".join(f"lag(lw, {i}) OVER (PARTITION BY doc_id ORDER BY i) AS b{i}" for i in (1, 2, 3))
    return f"""WITH {sql.DOC_TOKENS}, {_VALENCE_SQL},
     cut AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[{SPACE}]+'),
               lambda w: regexp_replace(w, '^[^{WORD}]+|[^{WORD}]+$', '', 'g')), lambda w: w <> '') AS ws FROM documents),
     u AS (SELECT doc_id, w, lower(w) AS lw, i FROM (
             SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM cut)),
     p AS (SELECT *, {before}, max(CASE WHEN lw = '{rules.CONTRAST}' THEN i END) OVER (PARTITION BY doc_id) AS c,
                  bool_or(NOT (w = upper(w) AND w <> lw)) OVER (PARTITION BY doc_id) AS mixed FROM u),
     s AS (SELECT doc_id, i, c, {turned} AS turned,
                  valence + CASE WHEN mixed AND w = upper(w) AND w <> lw THEN sign(valence) * {rules.CAPITALS}::DOUBLE
                            ELSE 0 END + {boosts} AS v
           FROM p JOIN lex ON lw = token),
     d AS (SELECT doc_id, sum(v * CASE WHEN turned THEN {rules.NEGATION}::DOUBLE ELSE 1 END
                  * CASE WHEN i < c THEN {rules.BEFORE_CONTRAST}::DOUBLE WHEN i > c THEN {rules.AFTER_CONTRAST}::DOUBLE
                    ELSE 1 END ORDER BY i) AS v FROM s GROUP BY doc_id),
     e AS (SELECT doc_id, v + sign(v) * {rules.EXCLAMATION}::DOUBLE
                  * least(length(text) - length(replace(text, '!', '')), {rules.MOST_EXCLAMATIONS}) AS v
           FROM (SELECT doc_id, text, coalesce(v, 0)::DOUBLE AS v FROM documents LEFT JOIN d USING (doc_id)))
    SELECT doc_id, round(coalesce(v / sqrt(v * v + {rules.NORMALISER}), 0), 4) AS compound,
           CASE WHEN round(coalesce(v / sqrt(v * v + {rules.NORMALISER}), 0), 4) >= 0
                THEN 'positive' ELSE 'negative' END AS sentiment FROM e"""


@query(_rules_sql())
def c18_sentiment_by_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rated words weighed by capitals, boosters, negations, contrast and exclamation marks."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return sentiment_by_rules(docs, persisted(rated_words(spark, folder), "lexicon"))
