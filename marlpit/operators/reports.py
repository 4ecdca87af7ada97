"""Counts, checks, report lines and crawl order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marlpit.functions.paths import parts
from marlpit.operators.embedding import BATCH_SIZE
from marlpit.runtime import stage


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_id").agg(F.count("*").alias("chunk_count"))


def crawled_counts(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk count of each given source, 0 when it has none."""
    return sources.select("source_id").join(
        chunk_counts(chunks), "source_id", "left"
    ).select("source_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def file_dimensions(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vector size per file, 0 for a file without chunks."""
    keys = ["source_id", "path"]
    sizes = chunks.groupBy(*keys).agg(F.max(F.size("embedding")).alias("dim"))
    return files.select(*keys).join(sizes, keys, "left").select(
        *keys, F.coalesce("dim", F.lit(0)).alias("embed_dim")
    )


def dimension_check(chunks: DataFrame, *by: str) -> DataFrame:
    """Groups whose vectors differ in size, e.g. by model or by file."""
    return (
        chunks.groupBy(*by)
        .agg(
            F.min(F.size("embedding")).alias("min_dim"),
            F.max(F.size("embedding")).alias("max_dim"),
        )
        .where("min_dim <> max_dim")
    )


def query_dimension_check(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: sizes on both sides and whether they agree; an empty index agrees.

    Both sides are folded in one aggregate, so nothing is paired.
    """
    side = lambda df, name: df.select(
        F.lit(name).alias("side"), F.size("embedding").alias("dim")
    )

    def over(name: str, fold) -> Column:
        return fold(F.when(F.col("side") == name, F.col("dim")))

    return (
        side(queries, "query")
        .unionByName(side(chunks, "index"))
        .agg(
            over("query", F.min).alias("query_min_dim"),
            over("query", F.max).alias("query_max_dim"),
            over("index", F.min).alias("index_min_dim"),
            over("index", F.max).alias("index_max_dim"),
        )
        .withColumn(
            "compatible",
            F.coalesce(
                (F.col("index_min_dim") == F.col("index_max_dim"))
                & (F.col("query_min_dim") == F.col("index_min_dim"))
                & (F.col("query_max_dim") == F.col("index_max_dim")),
                F.lit(True),
            ),
        )
    )


def report_lines(report: DataFrame) -> DataFrame:
    """The text lines of a crawl report, in order within each source."""
    counts = F.format_string(
        "%s: indexados=%d pulados=%d removidos=%d chunks=%d",
        "source_id", "indexed_files", "skipped_files", "removed_files", "chunk_count",
    )
    failure = F.when(
        F.coalesce("error", F.lit("")) != "", F.concat("source_id", F.lit(": "), "error")
    )
    return report.select(
        "source_id",
        F.posexplode(F.array_compact(F.array(counts, failure))).alias("line_number", "line"),
    )


def any_failed(report: DataFrame) -> DataFrame:
    """One row: did any source fail?"""
    failed = F.bool_or(F.coalesce("error", F.lit("")) != "")
    return report.agg(F.coalesce(failed, F.lit(False)).alias("failed"))


def crawl_positions(files: DataFrame) -> DataFrame:
    """Add `position` (1..n by path components) and `total` within each source.

    A source may hold most of the files, so no task ever gets a whole source:
    the rows are range-partitioned in crawl order, numbered within their
    partition, and shifted by the counts of the partitions before. The
    partition borders are sampled, hence the numbered rows are staged.
    """
    order = ["source_id", "_parts"]
    sorted_rows = (
        files.withColumn("_parts", parts(F.col("path")))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    # The id is the partition number above the row number, which has 33 bits.
    numbered = stage(
        sorted_rows.withColumn("_partition", F.shiftright("_row", 33)).drop("_parts"),
        "crawl-order",
    )
    # One row per source and partition it reaches into.
    blocks = numbered.groupBy("source_id", "_partition").agg(
        F.min("_row").alias("_first"), F.count("*").alias("_rows")
    )
    before = W.partitionBy("source_id").orderBy("_partition").rowsBetween(
        W.unboundedPreceding, -1
    )
    offsets = blocks.select(
        "source_id",
        "_partition",
        "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(W.partitionBy("source_id")).alias("total"),
    )
    return numbered.join(offsets, ["source_id", "_partition"]).select(
        *files.columns,
        (F.col("_row") - F.col("_first") + F.col("_offset") + 1).alias("position"),
        "total",
    )


def progress_log(positions: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """The progress text of a crawl: rows (source_id, position, batch, line).

    Position 0 heads a source with its file count; files with more than one
    embedding batch (by `n_chunks`, null for files not embedded) add a line
    per batch.
    """
    line = F.format_string("%s: arquivo %d de %d %s", "source_id", "position", "total", "path")
    batches = F.ceil(F.coalesce("n_chunks", F.lit(0)) / batch_size).cast("int")

    def entry(position: Column, batch: Column, text: Column) -> Column:
        return F.struct(
            position.cast("long").alias("position"),
            batch.cast("int").alias("batch"),
            text.alias("line"),
        )

    head = F.when(
        F.col("position") == 1,
        entry(F.lit(0), F.lit(0), F.format_string("%s: %d arquivos", "source_id", "total")),
    )
    own = F.array_compact(F.array(head, entry(F.col("position"), F.lit(0), line)))
    numbers = F.when(batches > 1, F.sequence(F.lit(1), batches)).otherwise(
        F.array().cast("array<int>")
    )
    lots = F.transform(
        numbers,
        lambda i: entry(
            F.col("position"),
            i,
            F.concat(line, F.format_string(" (lote %d de %d)", i, batches)),
        ),
    )
    return positions.select("source_id", F.explode(F.concat(own, lots)).alias("entry")).select(
        "source_id", "entry.*"
    )


def chunk_batches(chunks: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Add the number of each chunk's embedding batch and how many its file has.

    Needs `n_chunks`, the chunk count of the file.
    """
    return chunks.withColumn(
        "batch_number", F.floor(F.col("chunk_index") / batch_size) + 1
    ).withColumn("batch_total", F.ceil(F.col("n_chunks") / batch_size))
