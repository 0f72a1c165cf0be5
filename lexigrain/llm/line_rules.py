"""Quality rules of a text, and lines that too many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.llm.common import WORD, query, spread, table
from lexigrain.session import persisted

LEAST_WORDS, MOST_REPEATED = 10, 20
REPEAT = 5
#: A line is removed from a host when at least so many of its documents, and more than this
#: percentage of them, have it. Copies of one text count as one document.
LEAST_DOCUMENTS, MOST_PERCENT = 10, 5
#: A document is depleted when lines were removed and less than this percentage of its words, or
#: fewer words than the rules ask for, are left.
LEAST_LEFT = 30

_BLANKS, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = T.StructType(
    [
        T.StructField(n, T.LongType())
        for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ]
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in windows of five words found twice or more."""
    n = len(words) - REPEAT + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # numbers of growing windows; made dense again before they could overflow
    key, most = ids[:n], len(number)
    for step in range(1, REPEAT):
        if most > (1 << 62) // len(number):
            distinct, key = np.unique(key, return_inverse=True)
            most = len(distinct)
        key = key * len(number) + ids[step : step + n]
        most *= len(number)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    ends = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + REPEAT, -1)
    return int((np.cumsum(ends[:-1]) > 0).sum())


def base_counts(text: object) -> tuple[int, int, int, int, int]:
    if not isinstance(text, str):
        return (0, 0, 0, 0, 0)
    data = text.encode("utf-8", "replace")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip(_BLANKS)]
    blanks = len(data) - len(data.translate(None, _BLANKS))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    return (
        len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words),
    )


@F.pandas_udf(BASE)
def base(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The counts of whole texts as a struct column."""
    for batch in texts:
        yield pd.DataFrame([base_counts(t) for t in batch], columns=BASE.names)


def normalised(line: Column) -> Column:
    """A line with small letters, single blanks and every number as 0."""
    one = F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))
    return F.regexp_replace(F.translate(one, _UPPER, _LOWER), "[0-9]+", "0")


def line_hashes(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.xxhash64(normalised(x)))


def _measured(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """A stored row per document without its text: counts, hashes and sizes of its lines."""
    rows = spread(docs, [F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text")])
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return persisted(
        rows.select(
            "doc_id",
            "host",
            F.xxhash64("text").alias("text_hash"),
            base("text").alias("base"),
            line_hashes(F.col("text")).alias("lines"),
            F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))).alias("line_words"),
        ),
        "lines",
    )


def frequent_lines(measured: DataFrame) -> DataFrame:
    """``host, frequent``: hashes of the lines above the limits, a row per host that has any.

    Every document is counted. A host's list is short whatever its size: a line has to be in a
    twentieth of its documents, so there are at most twenty times their mean number of lines.
    """
    lines = measured.select(
        "host", "text_hash", F.explode(F.array_distinct(F.zip_with("lines", "line_words", lambda h, n: F.when(n > 0, h)))).alias("line")
    ).filter("line IS NOT NULL")
    documents = (
        measured.select("host", "text_hash").distinct()
        .groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    )
    counts = lines.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.filter(F.col("n") >= LEAST_DOCUMENTS)
        .alias("c")
        .join(documents.alias("d"), F.col("c.host").eqNullSafe(F.col("d.host")))
        .filter(F.col("n") * 100 > F.col("documents") * MOST_PERCENT)
        .groupBy("c.host")
        .agg(F.collect_list("line").alias("frequent"))
    )


def quality_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source"
) -> DataFrame:
    """Counts and verdict of every document.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    left_words, kept``. The base rules fail short texts and texts of repeated windows. Then lines
    that many documents of the host share are taken away, and a document with too little left is
    rejected as well.

    Null text has no words and fails. Null hosts are one host. Lines without a word are not counted.
    Ties need no order: a line is above the limits or not. Repeated rows are one document in the
    counts and a row each in the result; a null id stays null. An empty table gives no rows. Texts
    are read once and not shuffled; counts combine before their shuffles.
    """
    measured = _measured(docs, doc_id, text, host)
    found = frequent_lines(measured)
    removed = F.aggregate(
        F.zip_with("lines", "line_words", lambda h, n: F.when(F.array_contains("frequent", h), n)),
        F.lit(0).cast("bigint"),
        lambda total, n: total + F.coalesce(n, F.lit(0)),
    )
    n_words = F.col("n_words")
    failed = (n_words < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n_words)
    left = F.col("left_words")
    depleted = (left < n_words) & ((left < LEAST_WORDS) | (100 * left < LEAST_LEFT * n_words))
    return (
        measured.alias("m")
        .join(found.alias("f"), F.col("m.host").eqNullSafe(F.col("f.host")), "left")
        .select("doc_id", "base.*", F.coalesce(F.when(F.col("frequent").isNotNull(), removed), F.lit(0)).alias("removed"))
        .withColumn("left_words", n_words - F.col("removed"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~depleted)
        .drop("removed")
    )


def without_frequent_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source"
) -> DataFrame:
    """The documents with the lines above the limits taken out of their texts."""
    found = frequent_lines(_measured(docs, doc_id, text, host)).withColumnRenamed("host", "of_host")
    rows = docs.select(F.struct("*").alias("doc")).join(
        found, F.col(f"doc.{host}").eqNullSafe(F.col("of_host")), "left"
    )
    whole = F.col(f"doc.{text}")
    keep = F.filter(F.split(whole, "\n"), lambda x: ~F.array_contains("frequent", F.xxhash64(normalised(x))))
    cleaned = F.when(F.col("frequent").isNull(), whole).otherwise(F.array_join(keep, "\n"))
    return rows.select(*[cleaned.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])


@query(
    rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
line AS (
  SELECT doc_id, source, text,
         len(regexp_extract_all(x, '{WORD}')) AS n,
         regexp_replace(translate(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')),
           '{_UPPER}', '{_LOWER}'), '[0-9]+', '0', 'g') AS x
  FROM (SELECT doc_id, source, text, unnest(lines) AS x FROM d)),
host AS (SELECT source, count(DISTINCT text) AS documents FROM d GROUP BY source),
frequent AS (
  SELECT l.source, l.x
  FROM line l JOIN host h ON l.source IS NOT DISTINCT FROM h.source
  WHERE l.n > 0 GROUP BY l.source, l.x, h.documents
  HAVING count(DISTINCT text) >= {LEAST_DOCUMENTS}
     AND count(DISTINCT text) * 100 > h.documents * {MOST_PERCENT}),
removed AS (
  SELECT doc_id, sum(n) AS n FROM line l JOIN frequent f
  ON l.source IS NOT DISTINCT FROM f.source AND l.x = f.x GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len([x for x in lines if regexp_matches(x, '{WORD}')])
              - len(list_distinct([x for x in lines if regexp_matches(x, '{WORD}')])) AS BIGINT)
           AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(w) - coalesce(r.n, 0) AS BIGINT) AS left_words
  FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN removed r ON d.doc_id = r.doc_id)
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)
       AND NOT (left_words < n_words AND (left_words < {LEAST_WORDS}
                OR 100 * left_words < {LEAST_LEFT} * n_words)) AS kept
FROM counts
"""
)
def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules and line frequencies of all documents."""
    return quality_rules(table(spark, sf_dir, "documents"))
