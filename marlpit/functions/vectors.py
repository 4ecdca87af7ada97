"""Columns over embedding vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Scores are compared at this many decimals, so that a last-bit difference
# between two ways of summing cannot change an order.
SCORE_DECIMALS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, item: total + item)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double arithmetic; 0.0 when either vector has no length.

    Both vectors must have one size: check with `dimension_check` first.
    """
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)
