"""Scan of document trees: of folders that every executor mounts, and of URIs that Spark reads."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marlpit.functions.paths import SKIPPED_FOLDERS
from marlpit.model import DOCUMENTS
from marlpit.runtime import broadcast_if_small, stage
from marlpit.sources.hadoop_tree import LISTING, Root, StoreListing, hidden, is_uri, list_roots, open_listed, read_listed
from marlpit.sources.tables import select_documents

ENTRIES_PER_TASK = 50_000
ROWS_PER_BATCH = 5_000
BYTES_PER_BATCH = 32 << 20
BYTES_PER_TASK = 128 << 20
FILES_PER_TASK = 5_000


class TreeScan(NamedTuple):
    """`files` is the listing of selected files, `documents` the same with bytes; `read` turns one into the other."""

    files: DataFrame
    documents: DataFrame
    source_errors: DataFrame
    read: Callable[[DataFrame], DataFrame]


def _root(data_dir: str):
    return F.coalesce("path", F.concat(F.lit(f"{data_dir}/sources/"), "source_id"))


def _on_stores(registry: DataFrame, data_dir: str) -> tuple[list[Root], DataFrame]:
    """Roots that are URIs, as few as the registry has, and the registry of the others."""
    uri = is_uri(_root(data_dir))
    rows = registry.where(uri).select("source_id", _root(data_dir).alias("uri")).collect()
    return [Root(*row) for row in rows], registry.where(~uri) if rows else registry


def scan_tree(registry: DataFrame, data_dir: str = "data") -> TreeScan:
    """Read the selected files of every source root.

    Missing roots and folders that cannot be listed come back as source errors,
    since what lies below them is unknown; unreadable files as document errors.
    Only listed and selected files are opened.
    """
    roots, mounted = _on_stores(registry, data_dir)
    listing = list_tree(mounted, data_dir)
    read = read_files
    if roots:
        on_stores = list_roots(registry.sparkSession, roots, _walk_store)
        listing = listing.unionByName(on_stores.rows)
        read = partial(_read_both, on_stores)
    missing = (
        listing.where("state IN ('missing', 'failed')")
        .select(
            "source_id",
            F.when(F.col("state") == "missing", F.concat(F.lit("source folder not found: "), "root"))
            .otherwise(F.concat(F.lit("folder cannot be listed: "), "root", F.lit("/"), "path")).alias("error"),
        )
        .groupBy("source_id").agg(F.min("error").alias("error"))
    )
    small = broadcast_if_small(registry)
    files = select_documents(listing.where("state = 'file'"), small)
    return TreeScan(files, read(files), missing, read)


def _read_both(on_stores: StoreListing, files: DataFrame) -> DataFrame:
    uri = is_uri(F.col("root"))
    return read_files(files.where(~uri)).unionByName(_read_stores(on_stores, files.where(uri)))


def _read_stores(on_stores: StoreListing, files: DataFrame) -> DataFrame:
    """Bytes of listed files of stores; those that tasks have listed are opened by tasks."""
    if not on_stores.walked:
        return read_listed(files, on_stores)
    tops = F.create_map(*[F.lit(x) for pair in on_stores.walked.items() for x in pair])
    walked = F.col("root").isin(list(on_stores.walked))
    opened = read_files(files.where(walked).withColumn("root", F.element_at(tops, F.col("root")))).withColumn(
        "error", F.when(F.col("error").isNotNull(), "file cannot be read"))
    return opened.unionByName(read_listed(files.where(~walked), on_stores))


def _walk_store(folders: DataFrame) -> DataFrame:
    """The listing of mounted folders (source_id, root, path) as Spark's file sources see them."""
    return _list_folders(folders, partial(_walk, entries=_entries_of_store))


def list_tree(registry: DataFrame, data_dir: str = "data") -> DataFrame:
    """List all roots, many folders at a time.

    Each round walks the open folders in parallel; a task that has listed its
    share hands the folders it did not reach to the next round, so wide and
    deep trees spread over the cluster. The driver only counts open folders.
    """
    return _list_folders(registry.select("source_id", _root(data_dir).alias("root"), F.lit("").alias("path")), _walk)


def _list_folders(open_folders: DataFrame, walk: Callable) -> DataFrame:
    spark = open_folders.sparkSession
    levels = spark.createDataFrame([], LISTING)
    while True:
        waiting = open_folders.count()
        if waiting == 0:
            return levels
        tasks = min(waiting, 4 * spark.sparkContext.defaultParallelism)
        level = stage(
            open_folders.repartition(tasks).mapInPandas(walk, LISTING), "tree-level"
        )
        levels = levels.unionByName(level)
        open_folders = level.where("state = 'folder'").select("source_id", "root", "path")


def read_files(files: DataFrame) -> DataFrame:
    """Bytes of listed files, in tasks of about equal size."""
    size = files.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).first()
    tasks = max(
        files.sparkSession.sparkContext.defaultParallelism,
        size["files"] // FILES_PER_TASK,
        (size["bytes"] or 0) // BYTES_PER_TASK,
    )
    return (
        files.select("source_id", "root", "path")
        .repartition(tasks)
        .mapInPandas(_read, DOCUMENTS)
    )


def open_paths(wanted: DataFrame, registry: DataFrame, data_dir: str = "data") -> DataFrame:
    """Bytes of the files that (source_id, path) rows name, without any listing.

    Paths are taken below their source's root, links followed; what leads out of
    the root is not opened. `error` says so, or that the source is not on disk;
    a path that is no file gives no row.
    """
    roots, mounted = _on_stores(registry, data_dir)
    tops = broadcast_if_small(mounted.select(F.col("source_id").alias("of"), _root(data_dir).alias("root")))
    placed = wanted.join(tops, F.col("source_id") == F.col("of")).select("source_id", "root", "path")
    opened = placed.mapInPandas(_open, DOCUMENTS)
    if not roots:
        return opened
    return opened.unionByName(open_listed(wanted, roots, _walk_store, _read_stores))


def _open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for source_id, root, path in batch.itertuples(index=False):
            content, error = None, None
            top, target = os.path.realpath(root), os.path.realpath(os.path.join(root, path or ""))
            if not os.path.isdir(root):
                error = "source_not_on_disk"
            elif not target.startswith(top.rstrip(os.sep) + os.sep):
                error = "unsafe_path"
            elif not os.path.isfile(target):
                continue
            else:
                try:
                    with open(target, "rb") as file:
                        content = file.read()
                except OSError as problem:
                    error = str(problem)
            yield pd.DataFrame([(source_id, path, content, error)], columns=DOCUMENTS.names)


def _walk(batches: Iterator[pd.DataFrame], entries: Callable | None = None) -> Iterator[pd.DataFrame]:
    entries = entries or _entries
    rows: list[tuple] = []
    budget = ENTRIES_PER_TASK
    for batch in batches:
        folders = deque(batch.itertuples(index=False))
        while folders:
            source_id, root, folder = folders.popleft()
            if folder and budget <= 0:
                rows.append((source_id, root, folder, 0, "folder"))
                continue
            for row in entries(source_id, root, folder):
                budget -= 1
                if row[-1] == "folder":
                    folders.append(row[:3])
                else:
                    rows.append(row)
                if len(rows) >= ROWS_PER_BATCH:
                    yield _listing(rows)
                    rows = []
            if len(rows) >= ROWS_PER_BATCH:
                yield _listing(rows)
                rows = []
    yield _listing(rows)


def _entries(source_id: str, root: str, folder: str) -> Iterator[tuple]:
    here = os.path.join(root, folder)
    if not folder and not os.path.isdir(here):
        yield source_id, root, "", 0, "missing"
        return
    try:
        entries = os.scandir(here)
    except OSError:
        yield source_id, root, folder, 0, "failed"
        return
    with entries:
        for entry in entries:
            name = entry.name.encode("utf-8", "replace").decode("utf-8")
            path = f"{folder}/{name}" if folder else name
            if entry.is_dir():
                if name not in SKIPPED_FOLDERS and not entry.is_symlink():
                    yield source_id, root, path, 0, "folder"
            else:
                yield source_id, root, path, _bytes(entry), "file"


def _entries_of_store(source_id: str, root: str, folder: str) -> Iterator[tuple]:
    """As Spark's file sources list: links are followed, names they pass over and lost links are not seen."""
    here = os.path.join(root, folder)
    try:
        entries = os.scandir(here)
    except OSError:
        yield source_id, root, folder, 0, "failed"
        return
    with entries:
        for entry in entries:
            name = entry.name.encode("utf-8", "replace").decode("utf-8")
            path = f"{folder}/{name}" if folder else name
            if hidden(name) or not os.path.exists(entry.path):
                continue
            if not entry.is_dir():
                yield source_id, root, path, _bytes(entry), "file"
            elif not entry.is_symlink() or not _leads_back(entry.path, here):
                yield source_id, root, path, 0, "folder"


def _leads_back(link: str, here: str) -> bool:
    target, here = os.path.realpath(link), os.path.realpath(here)
    return here == target or here.startswith(target.rstrip(os.sep) + os.sep)


def _bytes(entry: os.DirEntry) -> int:
    try:
        return entry.stat().st_size
    except OSError:
        return 0


def _listing(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["source_id", "root", "path", "bytes", "state"])


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for source_id, root, path in batch.itertuples(index=False):
            content, error = None, None
            try:
                with open(os.path.join(root, path), "rb") as file:
                    content = file.read()
            except OSError as problem:
                error = str(problem)
            rows.append((source_id, path, content, error))
            held += len(content or b"")
            if held >= BYTES_PER_BATCH or len(rows) >= ROWS_PER_BATCH:
                yield pd.DataFrame(rows, columns=DOCUMENTS.names)
                rows, held = [], 0
    yield pd.DataFrame(rows, columns=DOCUMENTS.names)
