"""Session helpers: a session builder, staged tables and storage checks."""

from __future__ import annotations

import functools
import tempfile
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F, types as T


def local_session(cores: str = "8", app: str = "marlpit") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by the cluster.

    It comes from `spark.checkpoint.dir` or `setCheckpointDir`. Only a session
    whose executors are threads of the driver gets a folder of our own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.split("[")[0] == "local":
        base = _own_folder()
    if not base:
        raise ValueError("the session names no shared folder: set spark.checkpoint.dir")
    return base.rstrip("/")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="marlpit-")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/marlpit/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and read it back.

    Used where several consumers must see the very same rows even when an
    executor is lost, and where the next step needs pruned columns or a known
    size: the staged table gives Catalyst exact statistics to choose a join by.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._marlpit_path = path
    return staged


def stage_observed(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """A staged table, and aggregates of it that the write itself has gathered."""
    seen = Observation()
    staged = stage(df.observe(seen, *[metric.alias(name) for name, metric in metrics.items()]), label)
    return staged, seen.get


def discard(*staged: DataFrame) -> None:
    """Remove staged tables that no plan reads any more."""
    for df in staged:
        path = getattr(df, "_marlpit_path", None)
        if path is not None:
            remove(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles that no plan refers to any more removed.

    Spark removes them when the driver's JVM happens to collect its garbage, which may
    be long after a job; jobs of many large shuffles fill the disks until then. What the
    last query held is found garbage once Spark has let go of it, so it takes two rounds.
    """
    for pause in (0.2, 0.0):
        spark._jvm.java.lang.System.gc()
        time.sleep(pause)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is there."""
    file_system, hadoop_path = _hadoop(spark, path)
    file_system.delete(hadoop_path, True)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that comes in fewer pieces than cores.

    Meant before work that costs much more than moving its rows. An input of
    enough pieces, or one that a shuffle already spread, stays as it is, so
    large tables are never moved for this.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def together(*steps: Callable[[], object]) -> None:
    """Run independent Spark jobs at the same time; the first failure is raised."""
    with ThreadPoolExecutor(max(1, len(steps))) as pool:
        for running in [pool.submit(step) for step in steps]:
            running.result()


def exists(spark: SparkSession, path: str) -> bool:
    file_system, hadoop_path = _hadoop(spark, path)
    return file_system.exists(hadoop_path)


def folder_at(spark: SparkSession, path: str) -> str | None:
    """The full URI of a folder, or none where there is nothing; a file is no folder."""
    file_system, hadoop_path = _hadoop(spark, path.rstrip("/"))
    if not file_system.exists(hadoop_path):
        return None
    if not file_system.getFileStatus(hadoop_path).isDirectory():
        raise NotADirectory(path)
    return file_system.makeQualified(hadoop_path).toString()


class NotADirectory(PySparkException):
    def __init__(self, path: str):
        super().__init__(f"no folder: {path}")


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the direct entries of a folder; none when it is missing."""
    file_system, hadoop_path = _hadoop(spark, path)
    if not file_system.exists(hadoop_path):
        return []
    return [entry.getPath().getName() for entry in file_system.listStatus(hadoop_path)]


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


# Rows and bytes up to which a configuration-sized side is broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a cheap side whose counted rows and bytes allow it.

    Beyond the bounds the join is left to Catalyst: a sort-merge join whose
    skewed partitions adaptive execution splits.
    """
    size = df.limit(max_rows + 1).agg(F.count("*").alias("rows"), held_bytes(df).alias("bytes")).first()
    return broadcast_counted(df, size, max_rows)


def broadcast_counted(df: DataFrame, size: dict | Row, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same for a side whose `rows` and `bytes` are known, as from `stage_observed`."""
    small = size["rows"] <= max_rows and (size["bytes"] or 0) <= BROADCAST_BYTES
    return F.broadcast(df) if small else df


def held_bytes(df: DataFrame) -> Column:
    """About how many bytes of values the rows of `df` hold, an aggregate."""
    total = F.lit(16)
    for field in df.schema.fields:
        total = total + F.coalesce(_value_bytes(F.col(f"`{field.name}`"), field.dataType), F.lit(0))
    return F.sum(total.cast("long"))


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(value)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return F.octet_length(F.array_join(value, ",", ""))
        return F.size(value) * 16
    return F.lit(8)
