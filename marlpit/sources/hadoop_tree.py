"""Document trees on any store that Spark reads, through its `binaryFile` source.

Roots are URIs. Spark lists them, many folders at a time for wide trees, and packs the
files into tasks by size; executors need no mount. As in all of Spark's file sources,
names that begin with `_` or `.` are not seen.

Spark keeps what it lists on the driver. Large trees on a file system that executors
mount are therefore walked and opened by tasks, with the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marlpit.model import DOCUMENTS
from marlpit.runtime import broadcast_if_small, discard, folder_at, stage, stage_observed

LISTING = "source_id string, root string, path string, bytes long, state string"
# Up to so many files are named to the reader, which then opens no other; more are joined with all.
FILES_PER_READER = 20_000
# Spark deals small files out a few to a task, thousands of tasks for a wide tree; these bound them.
FILES_PER_TASK = 5_000
BYTES_PER_TASK = 128 << 20
STORE = "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


class Root(NamedTuple):
    source_id: str
    uri: str


class StoreListing(NamedTuple):
    """`rows` as in a walk, the reader whose files Spark has listed, and the folder of each root.

    `walked` are the folders of roots that tasks have listed, which no reader has.
    """

    rows: DataFrame
    reader: DataFrame | None
    tops: dict[str, str]
    walked: dict[str, str]


def is_uri(column: Column) -> Column:
    """Whether a root names its store."""
    return column.rlike(STORE + "/")


def _within(column: Column) -> Column:
    """A path without its store, which is spelled in more than one way."""
    return F.regexp_replace(column, STORE, "")


def list_roots(spark: SparkSession, roots: list[Root], walk: Callable[[DataFrame], DataFrame]) -> StoreListing:
    """Files below each root: source_id, root, path, bytes, state.

    A root that is not there gives one row `missing`; one that is no folder or that
    cannot be listed as a whole, `failed`. All others are listed together, those that
    are mounted (`file:`) by `walk` if they have more files than a reader is given names of.
    """
    tops, lost = {}, {}
    for root in roots:
        try:
            tops[root.uri] = folder_at(spark, root.uri)
            if tops[root.uri] is None:
                lost[root.uri] = "missing"
        except (PySparkException, Py4JJavaError):
            lost[root.uri] = "failed"
    good = {uri: top for uri, top in tops.items() if top}
    walked, walked_rows = _walked(spark, [r for r in roots if good.get(r.uri, "").startswith("file:")], good, walk)
    lost |= {uri: "failed" for uri, top in walked.items() if top is None}
    good = {uri: top for uri, top in good.items() if uri not in walked}
    walked = {uri: top for uri, top in walked.items() if top is not None}
    try:
        reader = _reader(spark, good.values())
    except (PySparkException, Py4JJavaError):
        for uri, top in good.items():
            try:
                _reader(spark, [top])
            except (PySparkException, Py4JJavaError):
                lost[uri] = "failed"
        good = {uri: top for uri, top in good.items() if uri not in lost}
        reader = _reader(spark, good.values())
    rows = spark.createDataFrame([(r.source_id, r.uri, "", 0, lost[r.uri]) for r in roots if r.uri in lost], LISTING)
    if reader is not None:
        rows = rows.unionByName(_listed([r for r in roots if r.uri in good], good, reader))
    if walked:
        rows = rows.unionByName(walked_rows)
    return StoreListing(rows, reader, {uri: _plain(top) for uri, top in good.items()}, walked)


def _walked(
    spark: SparkSession, roots: list[Root], tops: dict[str, str], walk: Callable[[DataFrame], DataFrame]
) -> tuple[dict[str, str | None], DataFrame | None]:
    """The folder of each root that tasks have listed, none where they could not, and its files; no root if files are few."""
    if not roots:
        return {}, None
    folders = spark.createDataFrame([(uri, _plain(tops[uri]), "") for uri in sorted({r.uri for r in roots})], "source_id string, root string, path string")
    listed = walk(folders)
    listed, seen = stage_observed(listed.withColumnRenamed("source_id", "uri"), "walked", files=F.count(F.when(F.col("state") == "file", 1)))
    if (seen["files"] or 0) <= FILES_PER_READER:
        discard(listed)
        return {}, None
    failed = {row.uri for row in listed.where("state IN ('missing', 'failed')").select("uri").distinct().collect()}
    names = spark.createDataFrame([tuple(r) for r in roots if r.uri not in failed], "source_id string, uri string")
    rows = listed.where("state = 'file'").join(F.broadcast(names), "uri").select("source_id", F.col("uri").alias("root"), "path", "bytes", "state")
    return {r.uri: None if r.uri in failed else _plain(tops[r.uri]) for r in roots}, rows


def hidden(name: str) -> bool:
    """Whether Spark's file sources pass over a file or folder of this name."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _listed(roots: list[Root], tops: dict[str, str], files: DataFrame) -> DataFrame:
    sizes = files.select(_within(F.col("path")).alias("full"), F.col("length").alias("bytes"))
    count = len(files._jdf.inputFiles())  # names stay in the JVM
    listed, seen = stage_observed(sizes.coalesce(_tasks(files, count)), "store-listing", files=F.count(F.lit(1)))
    # Readers pass over empty files, the listing does not.
    if count > (seen["files"] or 0):
        names = pa.table({"full": pa.array([_plain(unquote(name)) for name in _names(files)], pa.string())})
        every = files.sparkSession.createDataFrame(names)
        listed = listed.unionByName(every.join(listed, "full", "left_anti").withColumn("bytes", F.lit(0).cast("long")))
    # A file lies below each root that it lies below.
    folders = F.array(*[F.struct(F.lit(r.source_id).alias("source_id"), F.lit(r.uri).alias("root"), F.lit(_plain(tops[r.uri]) + "/").alias("top")) for r in roots])
    held = F.explode(F.filter(folders, lambda folder: F.startswith(F.col("full"), folder["top"]))).alias("of")
    return listed.select("full", "bytes", held).select(
        "of.source_id", "of.root", F.substring(F.col("full"), F.length("of.top") + 1, F.length("full")).alias("path"),
        "bytes", F.lit("file").alias("state"),
    )


def read_listed(files: DataFrame, listing: StoreListing) -> DataFrame:
    """Bytes of listed files (source_id, root, path, bytes).

    Spark keeps the listing on the driver, as for all its file sources. Few files are
    named to the reader: a filter on their names prunes the others before any is opened.
    Many are joined with what the reader has, and no name passes the driver. A file that
    is gone or torn by now is an error row.
    """
    spark = files.sparkSession
    if listing.reader is None:
        return spark.createDataFrame([], DOCUMENTS)
    top = F.element_at(F.create_map(*[F.lit(x) for pair in listing.tops.items() for x in pair]), F.col("root"))
    keys = files.select("source_id", "path", F.concat(top, F.lit("/"), "path").alias("full"), (F.col("bytes") == 0).alias("empty"))
    size = files.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).first()
    reader, tasks = listing.reader, _tasks(files, size["files"], size["bytes"] or 0)
    if size["files"] <= FILES_PER_READER:
        wanted = set(keys.where(~F.col("empty")).select("full").toArrow()["full"].to_pylist())
        names = [name for name in _names(reader) if _plain(unquote(name)) in wanted] if wanted else []
        # A store without a host is spelled with one slash or with three.
        names += [name.replace(":///", ":/", 1) for name in names if ":///" in name]
        reader = reader.where(_named(names))
    contents = reader.select(_within(F.col("path")).alias("full"), "content").coalesce(tasks)
    # Empty files are not read; the others stay where they are while their names can be sent to them.
    held = contents.join(broadcast_if_small(keys.select("full").distinct()), "full", "left_semi")
    content = F.when(F.col("empty"), F.lit(b"")).otherwise(F.col("content"))
    return keys.join(held, "full", "left").select(
        "source_id", "path", content.alias("content"), F.when(content.isNull(), "file cannot be read").alias("error")
    )


def open_listed(
    wanted: DataFrame, roots: list[Root], walk: Callable[[DataFrame], DataFrame], read: Callable[[StoreListing, DataFrame], DataFrame]
) -> DataFrame:
    """Bytes of the files that (source_id, path) rows name, whose paths lie below their roots.

    Only names are listed before; a path that is no file gives no row, and every path of
    a source without a folder is an error.
    """
    spark = wanted.sparkSession
    listing = list_roots(spark, roots, walk)
    plain = F.regexp_replace(F.regexp_replace("path", r"/(?:\./)+", "/"), "/+", "/")
    asked = wanted.withColumn("asked", F.col("path")).withColumn("path", plain)
    found = asked.join(listing.rows.where("state = 'file'"), ["source_id", "path"])
    texts = read(listing, stage(found.select("source_id", "root", "path", "bytes").distinct(), "wanted-files"))
    answers = texts.join(asked, ["source_id", "path"]).select("source_id", F.col("asked").alias("path"), "content", "error")
    lost = listing.rows.where("state <> 'file'").select("source_id")
    errors = wanted.join(lost, "source_id", "left_semi").select(
        "source_id", "path", F.lit(None).cast("binary").alias("content"), F.lit("source_not_on_disk").alias("error")
    )
    return answers.unionByName(errors)


def _reader(spark: SparkSession, tops: Iterable[str]) -> DataFrame | None:
    options = {"recursiveFileLookup": True, "ignoreMissingFiles": True, "ignoreCorruptFiles": True}
    tops = sorted(set(tops))
    return spark.read.format("binaryFile").options(**options).load(tops) if tops else None


def _named(names: list[str]) -> Column:
    """Whether a file has one of the names, written as SQL: a literal at a time takes a call to the JVM each."""
    listed = ", ".join(f"'{name}'" for name in names if "'" not in name)
    test = F.col("_metadata.file_path").isin([name for name in names if "'" in name])
    return test | F.expr(f"_metadata.file_path IN ({listed})") if listed else test


def _names(reader: DataFrame) -> list[str]:
    """The reader's files as Spark spells them, URIs without line breaks, brought over at once."""
    names = reader.sparkSession._jvm.org.apache.hadoop.util.StringUtils.join("\n", reader._jdf.inputFiles())
    return names.split("\n") if names else []


def _tasks(df: DataFrame, files: int, size: int = 0) -> int:
    return max(4 * df.sparkSession.sparkContext.defaultParallelism, files // FILES_PER_TASK, size // BYTES_PER_TASK)


def _plain(path: str) -> str:
    return re.sub(STORE, "", path)
