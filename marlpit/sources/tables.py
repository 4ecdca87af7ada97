"""Documents kept in tables, and their selection by registry globs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlpit.functions.paths import in_skipped_folder, slashed
from marlpit.sources.registry import compiled_globs


def documents_from_table(
    table: DataFrame, source_id: Column, path: Column, content: Column
) -> DataFrame:
    """Project any table to the `documents` shape."""
    return table.select(
        source_id.cast("string").alias("source_id"),
        path.cast("string").alias("path"),
        content.cast("binary").alias("content"),
        F.lit(None).cast("string").alias("error"),
    )


def select_documents(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of registered sources whose path an include and no exclude matches.

    Documents stay where they are when the registry is broadcast: pass it
    through `broadcast_if_small`.
    """
    path = slashed(F.col("path"))
    return (
        documents.where(~in_skipped_folder(F.col("path")))
        .join(compiled_globs(registry), "source_id")
        .where(
            F.rlike(path, F.col("include_regex")) & ~F.rlike(path, F.col("exclude_regex"))
        )
        .drop("include_regex", "exclude_regex")
    )
