"""Labelled rows for the classifiers: splits and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % of).cast("int")


def held_out(doc_id: Column, of: int, which: int) -> Column:
    return F.coalesce(remainder(doc_id, of) == which, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int) -> list[tuple[str, int]]:
    """Texts and labels of a bounded sample of the training rows, in a fixed order.

    For each class the `per_class` labelled ids of lowest hash are drawn from the
    rows that are not held out; texts of more than `max_bytes` bytes are passed
    over in training only. An id of two labels, or of none, is not used.
    """
    usable = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), 3) != 1))
        .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("high"))
        .filter(F.col("label") == F.col("high")).select(F.col("doc_id").alias("id"), "label")
    )
    order = [F.xxhash64("id"), F.col("id")]
    drawn = [usable.filter(F.col("label") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    # At most 2 per_class rows, so the broadcast is bounded.
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn[0].union(drawn[1])), F.col("doc_id") == F.col("id"))
    rows = (
        chosen.filter(F.octet_length("text") <= max_bytes).groupBy("id", "label").agg(F.min("text").alias("text"))
        .orderBy(*order).collect()
    )
    return [(row.text, row.label) for row in rows]
