"""What a crawl has to do, and the table states that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlpit.functions.paths import parts
from marlpit.functions.text import content_hash, decoded, redact_credentials

KEYS = ["source_id", "path"]
REINDEX = ("new", "edited", "remodel")
SKIPPED = ("skip", "skip_binary")


def fingerprint(documents: DataFrame) -> DataFrame:
    """Key, hash and state of every document, without its content."""
    content = F.col("content")
    return documents.select(
        *KEYS,
        content_hash(content).alias("content_hash"),
        decoded(content).isNotNull().alias("decodable"),
        "error",
    )


def unique_scan(scan: DataFrame) -> DataFrame:
    """One row per key: copies with one content are one document, others an error.

    A copy that could not be read makes its key an error too. `copies` counts them.
    Copies are folded
    before the shuffle, and the change plan's join reuses the partitioning of this
    aggregate.
    """
    differs = F.min("content_hash") != F.max("content_hash")
    return (
        scan.groupBy(*KEYS)
        .agg(
            F.min("content_hash").alias("content_hash"),
            F.min("decodable").alias("decodable"),
            F.min("error").alias("error"),
            F.count("*").alias("copies"),
            F.coalesce(differs, F.lit(False)).alias("differs"),
        )
        .withColumn(
            "error",
            F.coalesce(
                "error",
                F.when(
                    F.col("differs"),
                    F.concat(F.col("copies"), F.lit(" documents share the path "), "path"),
                ),
            ),
        )
        .drop("differs")
    )


def action_for(model: Column) -> Column:
    """The crawl's decision on a joined row (`seen` and `stored` mark the sides)."""
    return (
        F.when(F.col("seen").isNull(), "remove")
        .when(F.col("error").isNotNull(), "fail")
        .when(~F.col("decodable"), "skip_binary")
        .when(F.col("stored").isNull(), "new")
        .when(F.col("content_hash") != F.col("stored_hash"), "edited")
        .when(F.col("stored_model") != model, "remodel")
        .otherwise("skip")
    )


def stored_side(files: DataFrame) -> DataFrame:
    extra = [name for name in ("n_chunks", "run") if name in files.columns]
    return files.select(
        *KEYS,
        F.lit(True).alias("stored"),
        F.col("content_hash").alias("stored_hash"),
        F.col("embed_model").alias("stored_model"),
        *[F.col(name).alias(f"stored_{name}") for name in extra],
    )


def change_plan(scan: DataFrame, files: DataFrame, model: str) -> DataFrame:
    """Compare a full listing with the stored files of the same sources.

    Moves keys, hashes and model names only, never content.
    """
    seen = scan.withColumn("seen", F.lit(True))
    return (
        seen.join(stored_side(files), KEYS, "full_outer")
        .withColumn("action", action_for(F.lit(model)))
        .drop("seen", "stored", "decodable")
    )


def removed_paths(files: DataFrame, scan: DataFrame) -> DataFrame:
    """Stored keys that the listing no longer has."""
    return files.select(*KEYS).join(scan.select(*KEYS), KEYS, "left_anti")


def delete_rows(table: DataFrame, keys: DataFrame, on: list[str] = KEYS) -> DataFrame:
    return table.join(keys.select(*on), on, "left_anti")


def replace_rows(
    table: DataFrame, touched: DataFrame, fresh: DataFrame, on: list[str] = KEYS
) -> DataFrame:
    """Rows of untouched keys plus the fresh rows."""
    return delete_rows(table, touched, on).unionByName(fresh.select(*table.columns))


def upsert_status(status: DataFrame, fresh: DataFrame) -> DataFrame:
    """Every column of a crawled source is overwritten, also with nulls."""
    return replace_rows(status, fresh, fresh, ["id"])


def source_gates(failing: DataFrame, source_errors: DataFrame | None = None) -> DataFrame:
    """First failure per source: its position (path components) and message.

    An error of the source itself stands before every file; credentials in its
    message, as version control tools print them, are not kept.
    """
    failures = failing.where(F.col("error").isNotNull()).select(
        "source_id", parts(F.col("path")).alias("gate"), "error"
    )
    if source_errors is not None:
        failures = failures.unionByName(
            source_errors.select(
                "source_id",
                F.array().cast("array<string>").alias("gate"),
                redact_credentials(F.col("error")).alias("error"),
            )
        )
    return (
        failures.groupBy("source_id")
        .agg(F.min(F.struct("gate", "error")).alias("first"))
        .select("source_id", "first.gate", F.col("first.error").alias("gate_error"))
    )


def apply_gates(rows: DataFrame, gates: DataFrame) -> DataFrame:
    """Add `applied`: earlier than the first failure; removals need no failure at all."""
    before = (F.col("action") != "remove") & (parts(F.col("path")) < F.col("gate"))
    return rows.join(gates, "source_id", "left").withColumn(
        "applied", F.col("gate").isNull() | before
    )


def crawl_tally(applied: DataFrame, *more: Column) -> DataFrame:
    """Counts per source; rows that were not applied count nowhere."""

    def counted(*actions: str) -> Column:
        return F.count_if(F.col("applied") & F.col("action").isin(*actions))

    return applied.groupBy("source_id").agg(
        counted(*REINDEX).alias("indexed_files"),
        counted(*SKIPPED).alias("skipped_files"),
        counted("remove").alias("removed_files"),
        *more,
    )
