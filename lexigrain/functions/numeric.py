"""Numeric expressions on columns and on per-row arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round4(x: Column) -> Column:
    """Four digits, exact halves to the even neighbour."""
    return F.rint(x * 10000) / 10000


def argmax(values: Column) -> Column:
    """Zero-based position of the first largest entry."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def entropy(counts: str) -> Column:
    """Entropy in bits of an array column of class counts; empty classes add nothing."""
    total = f"aggregate({counts}, 0D, (acc_, item_) -> acc_ + item_)"
    return F.expr(
        f"aggregate({counts}, 0D, (acc_, item_) -> acc_ - "
        f"CASE WHEN item_ > 0 THEN item_ / {total} * log2(item_ / {total}) ELSE 0D END)"
    )


def negative_log_likelihood(logits: Column, target: Column) -> Column:
    """Cross-entropy of one row; the largest logit is subtracted first."""
    top = F.array_max(logits)
    log_sum = F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return log_sum + top - F.element_at(logits, target.cast("int") + 1)


def uniform(key: Column, seed: int | str) -> Column:
    """A reproducible number in [0, 1) for a row key, the same on every run and partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_one(u: Column, largest: int = 12) -> Column:
    """Poisson(1) counts from uniform numbers by the inverse distribution function."""
    total, term, result = 0.0, 2.718281828459045**-1, F.lit(0)
    for k in range(largest):
        total += term
        term /= k + 1
        result = result + (u >= F.lit(total)).cast("int")
    return result
