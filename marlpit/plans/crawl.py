"""Incremental crawl: index what is new, edited or of another model; drop what is gone."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from marlpit.functions.text import decoded
from marlpit.operators.changes import (
    KEYS,
    REINDEX,
    apply_gates,
    change_plan,
    crawl_tally,
    fingerprint,
    source_gates,
    unique_scan,
    upsert_status,
)
from marlpit.operators.chunking import chunk_documents
from marlpit.operators.embedding import ColumnEmbedder, Embedder, embed_chunks
from marlpit.operators.key_filter import key_filter
from marlpit.runtime import (
    BROADCAST_ROWS,
    broadcast_counted,
    broadcast_if_small,
    discard,
    held_bytes,
    stage,
    stage_observed,
    together,
)
from marlpit.sources.store import IndexStore, Version
from marlpit.sources.tables import select_documents
from marlpit.sources.tree import TreeScan


class Indexing(NamedTuple):
    """How documents become vectors."""

    embedder: Embedder | ColumnEmbedder
    model: str
    context_tokens: int | None = None


class Plan(NamedTuple):
    """A staged change plan, and how many of its rows are to index, to leave, to remove, and copies to index."""

    rows: DataFrame
    todo: int
    rest: int
    gone: int
    copied: int

    @staticmethod
    def of(rows: DataFrame) -> Plan:
        reindex, gone = F.col("action").isin(*REINDEX), F.col("action") == "remove"
        copied = reindex & (F.col("copies") > 1) if "copies" in rows.columns else F.lit(False)
        counts = {"todo": reindex, "rest": ~reindex & ~gone, "gone": gone, "copied": copied}
        staged, seen = stage_observed(rows, "plan", **{name: F.count_if(test) for name, test in counts.items()})
        return Plan(staged, **{name: seen[name] or 0 for name in counts})


class Contents(NamedTuple):
    """Documents by key; `read` turns rows of the listing into their bytes."""

    listing: DataFrame
    read: Callable[[DataFrame], DataFrame] = lambda rows: rows


def crawl(
    store: IndexStore,
    registry: DataFrame,
    documents: DataFrame | TreeScan,
    indexing: Indexing,
    *,
    source_errors: DataFrame | None = None,
    commits: DataFrame | None = None,
    crawled_at: datetime | None = None,
) -> DataFrame:
    """Bring the index to the state of `documents`, a full listing of the sources.

    `commits` (source_id, commit_sha) are the versions listed, `source_errors`
    (source_id, error) the sources that could not be listed at all; a tree scan
    brings its own. Returns the report, one row per registered source.
    """
    version = store.version()
    # Read several times below, and it may be a query.
    registry, size = stage_observed(registry, "registry", rows=F.count(F.lit(1)), bytes=held_bytes(registry))
    small = broadcast_counted(registry, size)
    if isinstance(documents, TreeScan):
        contents = Contents(documents.files, documents.read)
        scan = unique_scan(fingerprint(documents.documents))
        source_errors = _both(source_errors, documents.source_errors)
    else:
        contents = Contents(select_documents(documents, small))
        scan = unique_scan(fingerprint(contents.listing))
    stored = store.files(version).join(small.select("source_id"), "source_id", "left_semi")
    plan = Plan.of(change_plan(scan, stored, indexing.model))
    report = apply_plan(
        store,
        version,
        registry,
        plan,
        contents,
        indexing,
        source_errors=source_errors,
        commits=commits,
        crawled_at=crawled_at,
    )
    discard(registry)
    return report


def _both(some: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if some is None else some.unionByName(more)


def apply_plan(
    store: IndexStore,
    version: Version,
    registry: DataFrame,
    plan: Plan,
    contents: Contents,
    indexing: Indexing,
    *,
    source_errors: DataFrame | None = None,
    commits: DataFrame | None = None,
    crawled_at: datetime | None = None,
    all_or_nothing: bool = False,
    versions: DataFrame | None = None,
) -> DataFrame:
    """Carry out a staged change plan as one run of the store.

    A failing file stops its source there, or, with `all_or_nothing`, the run.
    `versions` (source_id, path, version) become visible with it.
    """
    run = store.begin(version)
    crawled_at = crawled_at or datetime.now(timezone.utc)
    wrote_chunks = _write_chunks(store, run, plan, contents, indexing)
    judged, seen = stage_observed(
        _judge(store, run, plan.rows, wrote_chunks), "judged", failures=F.count_if(F.col("error").isNotNull())
    )
    applied, gates = _gated(judged, seen["failures"] or 0, source_errors)
    if all_or_nothing and gates is not None:
        failure = gates.first()
        raise RuntimeError(f"source {failure.source_id}: {failure.gate_error}")

    # Chunk versions nobody may see again: those replaced or removed, and those
    # this run wrote for files from the first failure of their source on.
    replaced = F.when(_changes() & (F.col("stored_n_chunks") > 0), F.col("stored_run"))
    unwanted = F.when(~F.col("applied") & (F.col("written") > 0), F.lit(run))
    applied = applied.withColumn("dead_run", F.coalesce(replaced, unwanted)).withColumn(
        "embed_model",
        F.when(replaced.isNotNull(), F.col("stored_model")).otherwise(F.lit(indexing.model)),
    )

    report, size = stage_observed(
        _report(registry, applied, gates, store, version), "report",
        changed=F.sum(F.col("indexed_files") + F.col("removed_files")), dead=F.sum("dead_rows"),
    )
    status = upsert_status(store.status(version), _status(report, commits, crawled_at))
    writes = [partial(store.write, "status", run, status)]
    if size["changed"]:
        files = _file_rows(applied, indexing.model, commits)
        writes.append(partial(store.write, "files", run, files))
    if size["dead"]:
        dead = applied.where("dead_run is not null")
        writes.append(partial(store.write, "dead", run, dead))
    if versions is not None:
        writes.append(partial(store.write, "versions", run, versions.hint("rebalance", "source_id")))
    together(*writes)
    store.commit(run, version.base_run, version.dead_rows + (size["dead"] or 0))
    discard(plan.rows, judged, *([gates] if gates is not None else []))
    return report.drop("dead_rows")


def _changes() -> Column:
    return F.col("applied") & F.col("action").isin(*REINDEX, "remove")


def _gated(
    judged: DataFrame, failures: int, source_errors: DataFrame | None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows with `applied`, and the gates, or none in the usual case without failures."""
    if not failures and (source_errors is None or source_errors.isEmpty()):
        return judged.withColumn("applied", F.lit(True)), None
    gates = stage(source_gates(judged.where("error is not null"), source_errors), "gates")
    return apply_gates(judged, broadcast_if_small(gates)), gates


def _file_rows(applied: DataFrame, model: str, commits: DataFrame | None) -> DataFrame:
    """The file log of this run: replaced and new files, and deletions."""
    gone = F.col("action") == "remove"
    return (
        _with_commits(applied.where(_changes()), commits)
        .select(
            *KEYS,
            F.when(gone, F.col("stored_hash"))
            .otherwise(F.col("content_hash"))
            .alias("content_hash"),
            F.when(gone, F.col("stored_model")).otherwise(F.lit(model)).alias("embed_model"),
            F.col("dim").alias("embed_dim"),
            F.when(~gone, F.col("commit_sha")).alias("commit_sha"),
            "n_chunks",
            gone.alias("deleted"),
        )
        .hint("rebalance", "source_id")
    )


def _with_commits(rows: DataFrame, commits: DataFrame | None) -> DataFrame:
    if commits is None:
        return rows.withColumn("commit_sha", F.lit(None).cast("string"))
    return rows.join(broadcast_if_small(commits), "source_id", "left")


def _write_chunks(
    store: IndexStore, run: int, plan: Plan, contents: Contents, indexing: Indexing
) -> bool:
    wanted = _to_reindex(plan, contents.listing)
    if wanted is None:
        return False
    # Texts are spread before they grow into vectors; adaptive execution splits
    # a source that holds much and joins small ones, which also keeps the
    # number of files per source down.
    texts = (
        contents.read(wanted)
        .select(*KEYS, decoded(F.col("content")).alias("text"))
        .where("text is not null")
        .hint("rebalance", "source_id")
    )
    chunks = chunk_documents(texts, indexing.context_tokens)
    embedded = embed_chunks(chunks, indexing.embedder, indexing.model)
    store.write("chunks", run, embedded.withColumn("embed_dim", F.size("embedding")))
    return True


def _to_reindex(plan: Plan, listing: DataFrame) -> DataFrame | None:
    """The planned documents, without moving the others; null when there are none.

    The smaller of "to index" and "to leave" decides, so a first crawl and a quiet one
    both get by with few keys. As long as their counted number allows, these are
    broadcast. Beyond it a key filter of bounded size parts the listing below the
    shuffle: what it does not hold is decided there, and only the rest is joined.
    """
    if plan.todo == 0:
        return None
    picked = _picked(plan, listing)
    if not plan.copied:
        return picked
    # Copies have one content, so any of them will do; only they are moved for it.
    copied = F.col("action").isin(*REINDEX) & (F.col("copies") > 1)
    keys = broadcast_if_small(plan.rows.where(copied).select(*KEYS))
    once = picked.join(keys, KEYS, "left_semi").dropDuplicates(KEYS)
    return picked.join(keys, KEYS, "left_anti").unionByName(once)


def _picked(plan: Plan, listing: DataFrame) -> DataFrame:
    if plan.rest == 0:
        return listing
    reindex, smaller = F.col("action").isin(*REINDEX), min(plan.todo, plan.rest)
    few, how = (reindex, "left_semi") if plan.todo <= plan.rest else (~reindex, "left_anti")
    keys = plan.rows.where(few & (F.col("action") != "remove")).select(*KEYS)
    if smaller <= BROADCAST_ROWS:
        return listing.join(F.broadcast(keys), KEYS, how)
    may_hold = key_filter(keys, KEYS, smaller)
    unclear = listing.where(may_hold).join(keys, KEYS, how)
    if how == "left_semi":
        return unclear
    return unclear.unionByName(listing.where(~may_hold))


def _judge(store: IndexStore, run: int, plan: DataFrame, wrote_chunks: bool) -> DataFrame:
    """The plan with what indexing came to: dimension, chunk count, error per file."""
    if wrote_chunks:
        first_error = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("chunk_index")))
        per_file = (
            store.written("chunks", run)
            .groupBy(*KEYS)
            .agg(
                F.count("*").alias("written"),
                F.min("embed_dim").alias("min_dim"),
                F.max("embed_dim").alias("max_dim"),
                first_error.alias("chunk_error"),
            )
        )
        plan = plan.join(per_file, KEYS, "left")
    else:
        nothing = {"written": "long", "min_dim": "int", "max_dim": "int", "chunk_error": "string"}
        for name, kind in nothing.items():
            plan = plan.withColumn(name, F.lit(None).cast(kind))
    mixed = F.when(
        F.col("min_dim") != F.col("max_dim"),
        F.concat(F.lit("mixed dimensions in "), "source_id", F.lit(":"), "path"),
    )
    return plan.select(
        *KEYS,
        "action",
        "content_hash",
        "stored_hash",
        "stored_model",
        "stored_n_chunks",
        "stored_run",
        F.coalesce("written", F.lit(0)).alias("written"),
        F.when(F.col("action").isin(*REINDEX), F.coalesce("written", F.lit(0)))
        .otherwise(0)
        .alias("n_chunks"),
        F.coalesce("max_dim", F.lit(0)).alias("dim"),
        F.coalesce("error", "chunk_error", mixed).alias("error"),
    )


def _report(
    registry: DataFrame,
    applied: DataFrame,
    gates: DataFrame | None,
    store: IndexStore,
    version: Version,
) -> DataFrame:
    growth = F.when(_changes(), F.col("n_chunks") - F.coalesce("stored_n_chunks", F.lit(0)))
    tally = crawl_tally(
        applied,
        F.sum(growth).alias("growth"),
        F.count("dead_run").alias("dead_rows"),
    )
    before = store.status(version).select(
        F.col("id").alias("source_id"), F.col("chunk_count").alias("before")
    )
    report = (
        registry.select("ordinal", "source_id", "kind")
        .join(tally, "source_id", "left")
        .join(before, "source_id", "left")
    )
    if gates is None:
        report = report.withColumn("gate_error", F.lit(None).cast("string"))
    else:
        report = report.join(gates, "source_id", "left")
    zero = F.lit(0).cast("long")
    counts = ("indexed_files", "skipped_files", "removed_files", "dead_rows")
    return report.select(
        "ordinal",
        "source_id",
        "kind",
        *[F.coalesce(name, zero).alias(name) for name in counts],
        (F.coalesce("before", zero) + F.coalesce("growth", zero)).alias("chunk_count"),
        F.col("gate_error").alias("error"),
    )


def _status(report: DataFrame, commits: DataFrame | None, crawled_at: datetime) -> DataFrame:
    return _with_commits(report, commits).select(
        F.col("source_id").alias("id"),
        "kind",
        F.lit(crawled_at).cast("timestamp").alias("last_crawl_at"),
        F.col("commit_sha").alias("last_commit"),
        F.col("error").alias("last_error"),
        "chunk_count",
    )
