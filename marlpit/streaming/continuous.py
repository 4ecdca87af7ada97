"""The index kept current from a stream of document versions."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from marlpit.model import DOCUMENTS
from marlpit.operators.changes import KEYS, action_for, fingerprint, stored_side
from marlpit.plans.crawl import Contents, Indexing, Plan, apply_plan
from marlpit.runtime import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, discard, held_bytes, stage_observed
from marlpit.sources.store import IndexStore
from marlpit.sources.tables import select_documents


def latest_versions(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The highest version per document, whose keys are not null.

    Of equal versions a deletion counts before contents, then the greater content, so
    that every order of arrival ends in the same. Also returns the staged keys it reads.
    """
    once = versions.select(*KEYS, "content", "deleted", "version")
    repeated, size = _staged_keys(versions.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    if not size["rows"]:
        return once, repeated
    if not _small(size):
        return _last(versions), repeated
    # Only the documents that come several times are moved.
    keys = F.broadcast(repeated)
    return once.join(keys, KEYS, "left_anti").unionByName(_last(versions.join(keys, KEYS, "left_semi"))), repeated


def _last(versions: DataFrame) -> DataFrame:
    last = F.max(F.struct("version", "deleted", "content")).alias("last")
    return versions.groupBy(*KEYS).agg(last).select(*KEYS, "last.content", "last.deleted", "last.version")


def _staged_keys(rows: DataFrame) -> tuple[DataFrame, dict]:
    keys = rows.select(*KEYS)
    return stage_observed(keys, "keys", rows=F.count(F.lit(1)), bytes=held_bytes(keys))


def _small(size: dict) -> bool:
    return size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES


def newer_versions(latest: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents whose version the index has not reached yet; a null version counts always.

    Those that come late are found by their keys and taken out, so contents stay where
    they are while these keys are few. Also returns the staged keys it reads.
    """
    asked = latest.where("version is not null").select(*KEYS, F.col("version").alias("_version"))
    late, size = _staged_keys(known.join(asked, KEYS).where("_version <= version"))
    if not size["rows"]:
        return latest, late
    return latest.join(F.broadcast(late) if _small(size) else late, KEYS, "left_anti"), late


def feed_plan(latest: DataFrame, files: DataFrame, model: str) -> DataFrame:
    """Actions for the documents of one micro-batch.

    A micro-batch is no full listing: only its own keys are looked up, and
    only a deletion in the feed removes a file.
    """
    keys = broadcast_if_small(latest.select(*KEYS))
    stored = files.join(keys, KEYS, "left_semi")
    present = latest.where(~F.col("deleted")).withColumn("error", F.lit(None).cast("string"))
    gone = latest.where("deleted").select(
        *KEYS,
        F.lit(None).cast("string").alias("content_hash"),
        F.lit(None).cast("boolean").alias("decodable"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("boolean").alias("seen"),
    )
    listed = fingerprint(present).withColumn("seen", F.lit(True)).unionByName(gone)
    return (
        listed.join(stored_side(stored), KEYS, "left")
        .where("seen or stored")
        .withColumn("action", action_for(F.lit(model)))
        .drop("seen", "stored", "decodable")
    )


def index_batch(
    store: IndexStore, registry: DataFrame, versions: DataFrame, indexing: Indexing
) -> DataFrame | None:
    """Index one micro-batch; returns its report, or null when it changed nothing.

    A failing document fails the batch before anything becomes visible, so the
    stream replays it: a feed, unlike a listing, does not offer a skipped
    document again. What the index took in is kept by version, deletions too, in the
    same commit: older versions that come late, and replays, change nothing.
    """
    small = broadcast_if_small(registry)
    version = store.version()
    arrived, repeated = latest_versions(select_documents(versions, small))
    newer, late = newer_versions(arrived, store.versions(version))
    latest, seen = stage_observed(newer, "feed", taken=F.count("version"), rows=F.count(F.lit(1)))
    discard(repeated, late)
    report = None
    if not seen["rows"]:
        discard(latest)
        return report
    plan = Plan.of(feed_plan(latest, store.files(version), indexing.model))
    taken = latest.where("version is not null").select(*KEYS, "version")
    if plan.todo or plan.gone or seen["taken"]:
        touched = registry.join(
            broadcast_if_small(latest.select("source_id").distinct()), "source_id", "left_semi"
        )
        documents = latest.where(~F.col("deleted")).withColumn(
            "error", F.lit(None).cast("string")
        )
        report = apply_plan(
            store,
            version,
            touched,
            plan,
            Contents(documents.select(*DOCUMENTS.names)),
            indexing,
            crawled_at=datetime.now(timezone.utc),
            all_or_nothing=True,
            versions=taken,
        )
    discard(latest, plan.rows)
    return report


def index_stream(
    store: IndexStore,
    registry: DataFrame,
    versions: DataFrame,
    indexing: Indexing,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Start indexing a stream of (source_id, path, content, version, deleted).

    The highest version of a document counts, in whatever order and micro-batch it comes.
    """
    return (
        versions.writeStream.foreachBatch(
            lambda batch, _: index_batch(store, registry, batch, indexing) and None
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
