"""Lookups whose hot keys are split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.session import persisted

BROADCAST_ROWS = 200_000
HOT_KEYS = 1_000


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    size: str,
    spread_by: Sequence[str] | None = None,
    how: str = "inner",
    lookup_rows: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Inner or left join of ``rows`` with one ``lookup`` row per key.

    ``size`` is the lookup column that says how many rows carry the key. ``lookup`` is broadcast
    only when it has at most ``broadcast_rows`` rows: it should be a stored table that is counted
    here, or come with an upper bound ``lookup_rows``. A larger one is shuffled, and keys with more than 1/``hot_keys`` of all rows are split
    over several tasks. At most ``hot_keys`` keys can be that frequent, which bounds the list of
    hot keys that is broadcast. The salt is a hash of ``spread_by`` (the whole row by default), so
    a recomputed task assigns the same one.
    """
    on = list(on)
    if (lookup.count() if lookup_rows is None else lookup_rows) <= broadcast_rows:
        return rows.join(F.broadcast(lookup), on, how)

    if lookup_rows is not None:
        lookup = persisted(lookup, "lookup")
    total = lookup.agg(F.sum(size)).first()[0] or 0
    part = max(total / hot_keys, 1.0)
    hot = lookup.filter(F.col(size) > part).select(
        *on, F.ceil(F.col(size) / part).cast("int").alias("_parts")
    )
    parts: Column = F.coalesce(F.col("_parts"), F.lit(1))
    salted_rows = (
        rows.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*(spread_by or rows.columns)), parts).cast("int"))
        .drop("_parts")
    )
    salted_lookup = (
        lookup.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    return salted_rows.join(salted_lookup, [*on, "_salt"], how).drop("_salt")
