"""Source listings, and documents or line ranges for tables of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marlpit.functions.paths import is_safe_path
from marlpit.functions.text import decoded, line_range
from marlpit.runtime import broadcast_if_small

REQUEST_BROADCAST_ROWS = 200_000


def list_sources(registry: DataFrame, status: DataFrame, counts: DataFrame) -> DataFrame:
    """Registered sources with their last crawl and live chunk count."""
    return (
        registry.select("ordinal", F.col("source_id").alias("id"), "kind")
        .join(status.drop("kind", "chunk_count"), "id", "left")
        .join(counts.withColumnRenamed("source_id", "id"), "id", "left")
        .select(
            "ordinal", "id", "kind", "last_crawl_at", "last_commit", "last_error",
            F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        )
        .orderBy("ordinal")
    )


def read_requests(requests: DataFrame, registry: DataFrame, documents: DataFrame) -> DataFrame:
    """Answer each request with `text`, or say in `error` why there is none.

    A request table of checked size goes to the documents, which then stay
    where they are; a larger one is joined by key, and adaptive execution
    splits a key that many requests share.
    """
    keys = ["source_id", "path"]
    sources = registry.select("source_id", F.lit(True).alias("known"))
    judged = requests.join(broadcast_if_small(sources), "source_id", "left").withColumn(
        "error",
        F.when(F.col("known").isNull(), "unknown_source")
        .when(~is_safe_path(F.col("path")), "unsafe_path"),
    ).drop("known")
    allowed = judged.where("error is null").drop("error")
    allowed = broadcast_if_small(allowed, REQUEST_BROADCAST_ROWS)
    text = decoded(F.col("content"))
    problem = F.col("error") if "error" in documents.columns else F.lit(None).cast("string")
    answers = documents.select(*keys, "content", problem.alias("problem")).join(allowed, keys).select(
        "request_id",
        F.lit(True).alias("found"),
        "problem",
        line_range(text, F.col("start_line"), F.col("end_line")).alias("text"),
    )
    return judged.join(answers, "request_id", "left").select(
        "request_id",
        *keys,
        "text",
        F.coalesce(
            "error",
            "problem",
            F.when(F.col("found").isNull(), "missing_document")
            .when(F.col("text").isNull(), "undecodable_document"),
        ).alias("error"),
    )
