"""Mix sources to target weights: random order, distributed prefix sums, an exact cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain.llm.common import WORD, query, random_key, table, word_count
from lexigrain.session import persisted

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = "mix"
#: Rows of a source that one window task sorts; larger sources are cut into more key ranges.
ROWS_PER_RANGE = 4_000


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS
) -> DataFrame:
    """Target of each source: its weight's share of all words, at most ``most_epochs`` its size.

    Sources get the weights by code point, null last, in turn. What sources at their limit leave
    is shared by the others by weight (filled like water): with sources by rising limit per weight,
    the first that stays below its limit sets the level of all later ones. One row per source is
    sorted in one task; sources are names that people weigh, far fewer than documents.
    """
    per_source = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")
    )
    ranked = per_source.withColumn(
        "source_rank",
        F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1,
    )
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.col("source_rank") % len(weights) + 1).cast("int"),
    )
    weighed = ranked.withColumn("weight", weight).withColumn(
        "limit", F.col("source_size") * F.lit(float(most_epochs))
    )
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "source_rank")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = weighed.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / F.sum("weight").over(onward),
    ).withColumn("below", F.col("limit") / F.col("weight") > F.col("level"))
    found = level.withColumn(
        "shared", F.min(F.when(F.col("below"), F.struct(F.col("limit") / F.col("weight"), "source_rank", "level"))).over(everything)["level"]
    )
    target = F.when(F.col("below"), F.col("shared") * F.col("weight")).otherwise(F.col("limit"))
    return found.select(
        "source", "source_rank", "source_size", "source_rows", target.alias("target")
    )


def source_cuts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    seed: str = SEED,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """What the mix takes of each source, one row per source as a stored table.

    A source takes its documents in the order of a hash of the id: ``epochs`` times all, and once
    more those before the cut document, of which it takes ``cut_words``. So the budget, the target
    rounded to a word, is met exactly.

    The order inside a source is a sort by key ranges. A range holds about ``rows_per_range`` rows
    whatever the source's size, sums per range give each range its start, and a window inside the
    range gives the rest, so a source with a third of all rows is many tasks.
    """
    sizes = persisted(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            random_key(seed, F.col(doc_id)).alias("key"),
        ),
        "mix-sizes",
    )
    whole = F.when(
        F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))
    ).otherwise(0)
    targets = persisted(
        source_targets(sizes, weights, most_epochs)
        .withColumn(
            "budget",
            F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most_epochs).cast("bigint"),
        )
        .withColumn("epochs", whole.cast("bigint"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")),
        "mix-targets",
    )
    ranges = F.ceil(F.col("source_rows") / rows_per_range)
    keyed = (
        sizes.alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select(
            "d.doc_id", "d.size", "d.key", "t.source_rank", "t.rest",
            F.floor(F.col("d.key") / F.lit(float(1 << 60)) * ranges).cast("int").alias("range"),
        )
    )
    earlier = Window.partitionBy("source_rank").orderBy("range")
    starts = (
        keyed.groupBy("source_rank", "range")
        .agg(F.sum("size").alias("range_size"))
        .select(
            "source_rank", "range",
            (F.sum("range_size").over(earlier) - F.col("range_size")).alias("range_start"),
        )
    )
    inside = (
        Window.partitionBy("source_rank", "range")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    end = F.col("range_start") + F.col("within")
    cut = (
        keyed.withColumn("within", F.sum("size").over(inside))
        .join(starts, ["source_rank", "range"])
        .filter(end > F.col("rest"))
        .groupBy("source_rank")
        .agg(F.min(F.struct("key", "doc_id", (F.col("rest") - end + F.col("size")).alias("words"))).alias("cut"))
    )
    return persisted(
        targets.join(cut, "source_rank", "left").select(
            "source", "source_size", "target", "epochs",
            F.col("cut.key").alias("cut_key"), F.col("cut.doc_id").alias("cut_id"),
            F.coalesce("cut.words", F.lit(0)).alias("cut_words"),
        ),
        "mix-cuts",
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    seed: str = SEED,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """All input columns in ``doc``, and how many words the mix takes of each document.

    Returns ``doc, size, source_size, target, taken``, one row per input row; ``doc`` is a struct,
    so input columns may have any names. Documents meet their source's row of ``source_cuts``, a
    table with a row per source, so texts are not shuffled.

    Null text has size 0 and is never taken. A null source is a source of its own, the last one. A
    null id is an id. Repeated rows are separate documents that are taken alike; at the cut each
    takes the cut's words. An empty table gives an empty result.
    """
    cuts = source_cuts(docs, doc_id, text, source, weights, most_epochs, seed, rows_per_range)
    rows = docs.select(
        F.struct("*").alias("doc"),
        F.col(source).alias("of"),
        F.col(doc_id).alias("id"),
        word_count(F.col(text)).alias("size"),
        random_key(seed, F.col(doc_id)).alias("key"),
    )
    before = (F.col("key") < F.col("cut_key")) | (
        (F.col("key") == F.col("cut_key"))
        & F.coalesce(F.col("id") < F.col("cut_id"), F.col("id").isNull() & F.col("cut_id").isNotNull())
    )
    at = (F.col("key") == F.col("cut_key")) & F.col("id").eqNullSafe(F.col("cut_id"))
    more = F.when(before, F.col("size")).when(at, F.least("size", "cut_words")).otherwise(0)
    return rows.join(cuts, F.col("of").eqNullSafe(F.col("source"))).select(
        "doc", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + more).cast("bigint").alias("taken"),
    )


def mixed(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The mix itself with the columns of ``docs``: a row for each time a document is taken.

    The document at a source's cut is shortened to the words that are taken of it.
    """
    taken = mix(docs, text=text, **settings).filter("taken > 0")
    once = taken.withColumn("nth", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("nth") - 1) * F.col("size")).cast("int")
    head = F.concat_ws(" ", F.slice(F.regexp_extract_all(f"doc.{text}", F.lit(WORD), F.lit(0)), 1, words))
    kept = F.when(words < F.col("size"), head).otherwise(F.col(f"doc.{text}"))
    return once.select(
        *[kept.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns]
    )


@query(
    rf"""
WITH sizes AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)
              AS BIGINT) AS key
  FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r
  FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CAST(r % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS lim FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(lim) OVER (ORDER BY lim / w, r
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY lim / w, r
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size,
         CASE WHEN lim / w > level THEN w * (
           SELECT level FROM levels WHERE lim / w > level ORDER BY lim / w, r LIMIT 1)
         ELSE lim END AS target
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CAST(least(floor(t.target + 0.5), t.source_size * 3) AS BIGINT) AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN
         budget // source_size * size
         + greatest(0, least(size, budget % source_size - start)) ELSE 0 END AS BIGINT) AS taken
FROM placed
"""
)
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc.doc_id", "size", "source_size", "target", "taken")
