"""Ranked lexical search: impact-sorted lists read from the top until no interval is open."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain.llm.common import query, spread, table
from lexigrain.session import persisted

#: Bytes that are part of a term: digits, letters, and everything beyond ASCII. (Fixed value.)
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(
    c if c > 127 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32
    for c in range(256)
)
BEST = 50
#: Text of queries that is searched for in one pass; more are searched in blocks of this size.
QUERY_BYTES = 1 << 22
#: Postings of the documents that one task searches at a time.
SHARD = 1 << 21
#: Entries read from each list in the first round; every further round reads four times as deep.
FIRST_READ = 256


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order, ASCII letters in lower case; none for null."""
    return text.translate(_FOLD).split() if text else []


def resolve(
    lists: Sequence[tuple[np.ndarray, np.ndarray]], n_docs: int, best: int, first: int = FIRST_READ
) -> tuple[np.ndarray, np.ndarray]:
    """The ``best`` documents of impact-sorted lists, those tied with the last one, and their scores.

    Each list holds documents and positive impacts, highest first. All lists are read downwards; an
    unread entry is at most the next impact of its list. A document's score lies between the sum of
    what was read (lower) and that plus the next impacts of the lists it was not met in (upper).
    Reading goes on until no unmet document can reach the ``best``-th lower bound and every
    document that can has equal bounds, so members, ties and scores are final.
    """
    depth = first
    while True:
        frontier = np.array([s[depth] if depth < len(s) else 0 for _, s in lists], float)
        at = np.concatenate([d[:depth] for d, _ in lists])
        # sums of integers below 2^53 are exact
        lower = np.bincount(at, np.concatenate([s[:depth] for _, s in lists]), n_docs)
        met_in = np.repeat(frontier, [min(depth, len(s)) for _, s in lists])
        unmet = frontier.sum()
        met = np.flatnonzero(lower)
        bar = np.partition(lower[met], -best)[-best] if len(met) >= best else 0
        if unmet == 0 or unmet < bar:
            upper = lower + unmet - np.bincount(at, met_in, n_docs)
            close = met[upper[met] >= bar]
            if (upper[close] == lower[close]).all():
                return close, lower[close].astype(np.int64)
        depth *= 4


def _queries(items: list[tuple[int, list[bytes]]]) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """Numbers of all terms, and the term numbers of each query."""
    numbers: dict[bytes, int] = {}
    return numbers, [
        np.array([numbers.setdefault(t, len(numbers)) for t in dict.fromkeys(terms)], np.int64)
        for _, terms in items
    ]


def _counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with a term, terms of the queries only."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.get
        for batch in batches:
            sizes, found, owner = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                words = terms_of(text)
                sizes.append(len(words))
                known = [i for i in map(number, words) if i is not None]
                found += known
                owner.append(len(known))
            key = np.repeat(np.arange(len(sizes)), owner) * max(len(numbers), 1)
            key, tf = np.unique(key + np.array(found, np.int64), return_counts=True)
            row, term = np.divmod(key, max(len(numbers), 1))
            offsets = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
            columns = [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
            ]
            out = pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.array(sizes) > 0))

    return docs.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def _search(
    counted: DataFrame, wanted: list[np.ndarray], weights: np.ndarray, docs: int, length: int, best: int
) -> DataFrame:
    """``query, doc_id, score``: the best documents of each shard for each query."""

    def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = rows.column("terms").combine_chunks()
        term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = rows.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy(zero_copy_only=False))
        n = rows.column("n").to_numpy()
        if 50 * int(n.max(initial=0)) * docs >= 1 << 63:
            n = n.astype(object)
        m = (50 + 50 * n * docs // length).astype(np.int64)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[at]))
        order = np.lexsort((-impact, term))
        order = order[impact[order] > 0]
        term, at, impact = term[order], at[order], impact[order]
        starts = np.searchsorted(term, np.arange(len(weights) + 1))
        ids = rows.column("doc_id").combine_chunks()
        # null ids come last among equal scores
        place = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        for number, terms in enumerate(wanted):
            spans = [slice(starts[t], starts[t + 1]) for t in terms if starts[t] < starts[t + 1]]
            if not spans:
                continue
            found, score = resolve([(at[s], impact[s]) for s in spans], len(rows), best)
            first = np.lexsort((place[found], -score))[:best]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(first), number, np.int32)),
                    ids.take(pa.array(found[first])),
                    pa.array(score[first]),
                ],
                names=["query", "doc_id", "score"],
            )

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings = [], 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column("terms").flatten())
            if postings >= SHARD:
                yield from shard(held)
                held, postings = [], 0
        if held:
            yield from shard(held)

    return counted.mapInArrow(searched, "query int, doc_id long, score long")


def ranked(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The ``best`` documents for each item: ``item_id, rank, doc_id, score``, scores above 0.

    Documents are searched in shards of bounded size, each with its own lists sorted by impact, and
    each shard's best for a query meet in one ranking (at most ``best`` a shard, and a task keeps
    ``best`` of its own before the shuffle). A frequent term is spread over all shards. Queries are
    taken in blocks of a bounded size; only their terms, weights and numbers are sent to tasks.

    Null and empty texts, documents or items, have no term and no row. An item is what shares an
    item id (null too): its terms are those of all its rows, each once. Every document row is a
    document of its own, repeated or not; a null doc_id comes last among equal scores. An empty
    table of either kind gives no row. Other columns of both tables are not read.
    """
    spark = docs.sparkSession
    asked = items.select(
        F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("text")
    ).filter("text IS NOT NULL")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // query_bytes) or 1
    schema = f"query int, item_id {items.schema[item_id].dataType.simpleString()}"
    # no pass is an empty result of the right type
    parts = [spark.createDataFrame([], f"item_id {schema.split()[-1]}, rank int, doc_id long, score long")]
    for block in range(blocks):
        in_block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block
        texts: dict[object, list[bytes]] = {}
        for row in asked.filter(in_block).collect():
            texts.setdefault(row.item_id, []).extend(terms_of(bytes(row.text)))
        named = list(texts.items())
        numbers, wanted = _queries(named)
        if not numbers:
            continue
        rows = spread(docs, [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")])
        counted = persisted(_counted(rows, numbers), "counted")
        n_docs, length, postings = counted.agg(
            F.count(F.lit(1)), F.sum("n"), F.sum(F.size("terms"))
        ).first()
        if not postings:
            continue
        held_by = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = np.zeros(len(numbers), np.int64)
        for term, df in held_by:
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        shards = max(spark.sparkContext.defaultParallelism, -(-postings // SHARD))
        found = _search(counted.coalesce(shards), wanted, weights, n_docs, length, best)
        names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(named)], schema)
        order: list[Column] = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
        top = found.withColumn("rank", place).filter(F.col("rank") <= best)
        parts.append(top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, parts[1:] or parts)


_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}')"


@query(
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
    sized AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
    totals AS (SELECT count(*) AS docs, cast(sum(n) AS BIGINT) AS length FROM sized),
    q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
    p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d)
          WHERE term IN (SELECT term FROM q) GROUP BY r, term),
    held AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    scored AS (
        SELECT q.item_id, sized.r, sized.doc_id,
            cast(sum(cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
                * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) AS BIGINT) AS score
        FROM q JOIN p USING (term) JOIN held USING (term) JOIN sized USING (r) CROSS JOIN totals
        GROUP BY q.item_id, sized.r, sized.doc_id),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place
        FROM scored WHERE score > 0)
    SELECT item_id, cast(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= {BEST}
    """
)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
