"""The index on storage: runs of parquet files and a commit record.

    <root>/chunks/run=R/source_id=S/embed_model=M/   chunks written by run R
    <root>/files/run=R/source_id=S/                  files changed by run R
    <root>/dead/run=R/embed_model=M/                 chunk versions run R retired
    <root>/versions/run=R/source_id=S/               feed versions that run R took in
    <root>/status/run=R/                             status of all sources after run R
    <root>/commits/run=R/                            one row; makes run R visible

A run only adds what changed. Its folders count once its commit row exists,
so a lost run leaves nothing behind that a reader sees, and the next run
clears it first. `compact` folds all runs into one. There is one writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from marlpit.model import CHUNKS, FILES, SOURCE_STATUS
from marlpit.runtime import broadcast_counted, exists, held_bytes, names_in, remove

KEYS = ["source_id", "path"]
# Folders (a run's part of a source) up to which readers treat those with retired
# chunks apart from all others.
TOUCHED_FOLDERS = 10_000

_RUN = T.StructType().add("run", T.LongType())
_CHUNKS = T.StructType(
    CHUNKS.fields
    + [
        T.StructField("embed_dim", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
    + _RUN.fields
)
_FILES = T.StructType(
    FILES.fields
    + [
        T.StructField("n_chunks", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
    ]
    + _RUN.fields
)
_DEAD = (
    T.StructType()
    .add("source_id", T.StringType())
    .add("path", T.StringType())
    .add("dead_run", T.LongType())
    .add("embed_model", T.StringType())
    .add("run", T.LongType())
)
_VERSIONS = (
    T.StructType()
    .add("source_id", T.StringType())
    .add("path", T.StringType())
    .add("version", T.LongType())
    .add("run", T.LongType())
)
_STATUS = T.StructType(SOURCE_STATUS.fields + _RUN.fields)
_COMMITS = (
    T.StructType()
    .add("base_run", T.LongType())
    .add("dead_rows", T.LongType())
    .add("run", T.LongType())
)
_SCHEMAS = {
    "chunks": _CHUNKS,
    "files": _FILES,
    "dead": _DEAD,
    "versions": _VERSIONS,
    "status": _STATUS,
    "commits": _COMMITS,
}
_PARTITIONS = {
    "chunks": ["source_id", "embed_model"],
    "files": ["source_id"],
    "dead": ["embed_model"],
    "versions": ["source_id"],
}


class Version(NamedTuple):
    """The visible state: runs `base_run..run`, with `dead_rows` retired chunk keys."""

    run: int
    base_run: int
    dead_rows: int


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def version(self) -> Version:
        for run in sorted(self._run_numbers("commits"), reverse=True):
            if exists(self.spark, f"{self._folder('commits', run)}/_SUCCESS"):
                row = self._read("commits", [run]).first()
                return Version(row["run"], row["base_run"], row["dead_rows"])
        return Version(0, 1, 0)

    def begin(self, version: Version | None = None) -> int:
        """Number of the next run, cleared of what a lost run may have left."""
        run = (version or self.version()).run + 1
        for table in _SCHEMAS:
            remove(self.spark, self._folder(table, run))
        return run

    def files(self, version: Version | None = None) -> DataFrame:
        """Current file rows, with `n_chunks` and the `run` that wrote the chunks."""
        version = version or self.version()
        log = self._runs("files", version)
        if version.run > version.base_run:
            values = [name for name in _FILES.names if name not in KEYS]
            log = (
                log.groupBy(*KEYS)
                .agg(F.max_by(F.struct(*values), F.col("run")).alias("last"))
                .select(*KEYS, "last.*")
            )
        return log.where(~F.col("deleted")).select(*FILES.names, "n_chunks", "run")

    def chunks(self, embed_model: str | None = None, version: Version | None = None) -> DataFrame:
        """Live chunks, optionally of one model; filters on source and model prune."""
        version = version or self.version()
        rows = self._runs("chunks", version)
        if not version.dead_rows:
            return self._of_model(rows, embed_model).select(*CHUNKS.names)
        rows, dead = (self._of_model(table, embed_model) for table in (rows, self._runs("dead", version)))
        # The folders that hold retired chunks, as many as sources were touched by runs.
        folders = dead.groupBy("source_id", "dead_run").agg(F.count("*").alias("rows"), held_bytes(dead).alias("bytes"))
        folders = folders.limit(TOUCHED_FOLDERS + 1).collect()
        if not folders:
            return rows.select(*CHUNKS.names)
        retired = dead.select(*KEYS, F.col("dead_run").alias("run"))
        if len(folders) > TOUCHED_FOLDERS:
            return rows.join(retired, [*KEYS, "run"], "left_anti").select(*CHUNKS.names)
        size = {name: sum(folder[name] for folder in folders) for name in ("rows", "bytes")}
        by_run: dict[int, list[str]] = {}
        for folder in folders:
            by_run.setdefault(folder["dead_run"], []).append(folder["source_id"])
        touched = F.lit(False)
        for run, sources in by_run.items():
            touched = touched | ((F.col("run") == run) & F.col("source_id").isin(*sources))
        live = rows.where(touched).join(broadcast_counted(retired, size), [*KEYS, "run"], "left_anti")
        # All other folders are read without a join.
        return rows.where(~touched).select(*CHUNKS.names).unionByName(live.select(*CHUNKS.names))

    @staticmethod
    def _of_model(rows: DataFrame, embed_model: str | None) -> DataFrame:
        return rows if embed_model is None else rows.where(F.col("embed_model") == embed_model)

    def versions(self, version: Version | None = None) -> DataFrame:
        """The highest feed version of every document that a feed named, deleted ones too."""
        log = self._runs("versions", version or self.version())
        return log.groupBy(*KEYS).agg(F.max("version").alias("version"))

    def status(self, version: Version | None = None) -> DataFrame:
        version = version or self.version()
        return self._read("status", [version.run]).select(*SOURCE_STATUS.names)

    def chunk_counts(self) -> DataFrame:
        """Live chunks per source, all models together, from the file rows alone."""
        return self.files().groupBy("source_id").agg(F.sum("n_chunks").alias("chunk_count"))

    def written(self, table: str, run: int) -> DataFrame:
        """Rows of a run still being built."""
        return self._read(table, [run])

    def write(self, table: str, run: int, rows: DataFrame) -> None:
        columns = [name for name in _SCHEMAS[table].names if name != "run"]
        writer = rows.select(*columns).write.mode("overwrite")
        partitions = _PARTITIONS.get(table)
        if partitions:
            writer = writer.partitionBy(*partitions)
        writer.parquet(self._folder(table, run))

    def commit(self, run: int, base_run: int, dead_rows: int) -> None:
        row = self.spark.range(1).select(
            F.lit(base_run).alias("base_run"), F.lit(dead_rows).alias("dead_rows")
        )
        self.write("commits", run, row.coalesce(1))

    def compact(self) -> int:
        """Fold the visible runs into one new run without retired rows."""
        version = self.version()
        run = self.begin(version)
        by_source = lambda rows: rows.hint("rebalance", "source_id")
        chunks = self.chunks(version=version)
        self.write(
            "chunks",
            run,
            by_source(chunks)
            .withColumn("embed_dim", F.size("embedding"))
            .withColumn("error", F.lit(None).cast("string")),
        )
        files = self.files(version).withColumn("deleted", F.lit(False))
        self.write("files", run, by_source(files))
        self.write("versions", run, by_source(self.versions(version)))
        self.write("status", run, self.status(version))
        self.commit(run, base_run=run, dead_rows=0)
        return run

    def expire(self) -> None:
        """Delete the runs that `compact` replaced; older readers must be done."""
        base_run = self.version().base_run
        for table in _SCHEMAS:
            for run in self._run_numbers(table):
                if run < base_run:
                    remove(self.spark, self._folder(table, run))

    def _runs(self, table: str, version: Version) -> DataFrame:
        """All visible rows; only the visible runs' folders are listed."""
        return self._read(table, range(version.base_run, version.run + 1))

    def _read(self, table: str, runs: Iterable[int]) -> DataFrame:
        present = set(self._run_numbers(table))
        folders = [self._folder(table, run) for run in runs if run in present]
        if not folders:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        reader = self.spark.read.schema(_SCHEMAS[table])
        return reader.option("basePath", f"{self.root}/{table}").parquet(*folders)

    def _folder(self, table: str, run: int) -> str:
        return f"{self.root}/{table}/run={run}"

    def _run_numbers(self, table: str) -> list[int]:
        names = names_in(self.spark, f"{self.root}/{table}")
        return [int(name.removeprefix("run=")) for name in names if name.startswith("run=")]
