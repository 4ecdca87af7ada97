"""Change plans, index states, crawls, reports and listings (A*, E1, E3, F*, G4, H*, I*, K1)."""

from __future__ import annotations

import os
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import functions as F

from marlpit.functions.paths import is_safe_path
from marlpit.model import REGISTRY
from marlpit.operators import changes, reports
from marlpit.operators.chunking import fixed_chunks
from marlpit.operators.embedding import RuleEmbedder
from marlpit.operators.reading import list_sources as sources_listing, read_requests
from marlpit.plans.crawl import Indexing, crawl
from marlpit.runtime import broadcast_if_small, fresh_path, stage
from marlpit.sources.registry import (
    local_sources as local_only,
    normalized_registry,
    registry_violations,
)
from marlpit.sources.store import IndexStore
from marlpit.sources.tables import documents_from_table
from marlpit.sources.tree import open_paths, scan_tree
from marlpit.streaming.continuous import index_stream
from queries import query, table
from queries.fixtures import (
    GONE_SOURCE_SQL,
    PATH_SQL,
    PLAN_SQL,
    SCAN_SQL,
    SPACES_SQL,
    STORED_SQL,
    STORED_TEXTS_SQL,
    doc_path,
    documents,
    gone_source,
    stored_files,
    stored_texts,
    windows_sql,
)

KEYS = ["source_id", "path"]


def _plan(spark, folder):
    scan = changes.unique_scan(changes.fingerprint(documents(spark, folder)))
    return changes.change_plan(scan, stored_files(spark, folder), "m1")


@query(f"WITH {PLAN_SQL} SELECT source_id, path, action FROM plan")
def change_plan(spark, folder):
    return _plan(spark, folder).select(*KEYS, "action")


@query(
    f"""WITH {PLAN_SQL} SELECT source_id, path,
      CASE WHEN doc_id % 5 = 1 AND action <> 'remove' THEN 'fail' ELSE action END AS action,
      CASE WHEN doc_id % 5 = 1 AND action <> 'remove' THEN '2 documents share the path ' || path END AS error
    FROM plan LEFT JOIN (SELECT source AS source_id, {PATH_SQL} AS path, doc_id FROM documents) USING (source_id, path)"""
)
def change_plan_copies(spark, folder):
    """Every document listed twice: with one content, or, one in five, with two."""
    once = documents(spark, folder)
    odd = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long") % 5 == 1
    again = once.withColumn("content", F.when(odd, F.concat("content", F.lit("y").cast("binary"))).otherwise(F.col("content")))
    scan = changes.unique_scan(changes.fingerprint(once.unionByName(again)))
    return changes.change_plan(scan, stored_files(spark, folder), "m1").select(*KEYS, "action", "error")


@query(f"WITH {PLAN_SQL} SELECT source_id, path FROM plan WHERE action = 'remove'")
def removed_paths(spark, folder):
    return changes.removed_paths(
        stored_files(spark, folder), changes.fingerprint(documents(spark, folder))
    )


@query(
    f"""WITH {SCAN_SQL}, {STORED_SQL}
    SELECT source_id, path, s.content_hash, 'm1' AS embed_model FROM scan s"""
)
def next_files(spark, folder):
    """Stored files without the touched ones, plus the re-indexed ones."""
    plan = stage(_plan(spark, folder).where("action <> 'skip'"), "plan")
    fresh = plan.where("action <> 'remove'").select(
        *KEYS, "content_hash", F.lit("m1").alias("embed_model")
    )
    return changes.replace_rows(stored_files(spark, folder), plan, fresh)


@query(
    f"""WITH {STORED_TEXTS_SQL},
    docs AS (SELECT source AS source_id, {PATH_SQL} AS path, text FROM documents),
    now AS ({windows_sql('docs', 'source_id, path')})
    SELECT source_id, path, chunk_index, text FROM now"""
)
def next_chunks(spark, folder):
    plan = stage(_plan(spark, folder).where("action <> 'skip'"), "plan")
    # Files that the plan touches go before the rest are cut.
    kept = changes.delete_rows(stored_texts(spark, folder).drop("embed_model"), plan)
    wanted = plan.where("action <> 'remove'").select(*KEYS)
    texts = table(spark, folder, "documents").select(
        F.col("source").alias("source_id"), doc_path().alias("path"), "text"
    )
    fresh = fixed_chunks(texts.join(wanted, KEYS, "left_semi"))
    return fixed_chunks(kept).unionByName(fresh).withColumn("chunk_index", F.col("chunk_index").cast("long"))


_FAILED_SQL = f"""
toxic AS (
  SELECT source AS source_id, {PATH_SQL} AS path, 'failed on ' || doc_id AS error
  FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0),
failing AS (
  SELECT source_id, string_split(path, '/') AS parts, error FROM toxic
  UNION ALL SELECT 'src4', []::VARCHAR[], 'no root'),
gates AS (
  SELECT source_id, min(parts) AS gate, arg_min(error, parts) AS gate_error
  FROM failing GROUP BY source_id),
gated AS (
  SELECT p.source_id, p.path, p.action, gate_error, content_hash,
    CASE WHEN gate IS NULL THEN true WHEN action = 'remove' THEN false
         ELSE string_split(p.path, '/') < gate END AS applied
  FROM plan p LEFT JOIN gates USING (source_id))
"""


def _gated(spark, folder):
    """Documents labelled both bad and toxic fail; source src4 has no root."""
    toxic = (
        table(spark, folder, "labels")
        .where("toxic = 1 and quality = 0")
        .join(table(spark, folder, "documents"), "doc_id")
        .select(
            F.col("source").alias("source_id"),
            doc_path().alias("path"),
            F.concat(F.lit("failed on "), "doc_id").alias("failure"),
        )
    )
    rows = _plan(spark, folder).drop("error").join(toxic, KEYS, "left")
    rows = stage(rows.withColumnRenamed("failure", "error"), "failing-plan")
    root = spark.range(1).select(F.lit("src4").alias("source_id"), F.lit("no root").alias("error"))
    gates = stage(changes.source_gates(rows, root), "gates")
    return changes.apply_gates(rows, broadcast_if_small(gates))


@query(
    f"""WITH {PLAN_SQL}, {_FAILED_SQL}
    SELECT source_id, path, action, applied, gate_error FROM gated"""
)
def error_gate(spark, folder):
    return _gated(spark, folder).select(*KEYS, "action", "applied", "gate_error")


_PIECES_SQL = f"""
docs AS (SELECT source AS source_id, {PATH_SQL} AS path, text FROM documents),
pieces AS MATERIALIZED ({windows_sql('docs', 'source_id, path')})
"""


def _pieces(spark, folder):
    """The chunks of all documents."""
    return fixed_chunks(table(spark, folder, "documents").select(
        F.col("source").alias("source_id"), doc_path().alias("path"), "text"
    ))


_REPORT_SQL = f"""{PLAN_SQL}, {_FAILED_SQL},
{_PIECES_SQL},
sizes AS (SELECT source_id, count(*) AS chunk_count FROM pieces GROUP BY ALL),
report AS (
  SELECT source_id,
    count(*) FILTER (WHERE applied AND action IN ('new', 'edited', 'remodel')) AS indexed_files,
    count(*) FILTER (WHERE applied AND action = 'skip') AS skipped_files,
    count(*) FILTER (WHERE applied AND action = 'remove') AS removed_files,
    any_value(chunk_count) AS chunk_count, any_value(gate_error) AS error
  FROM gated JOIN sizes USING (source_id) GROUP BY source_id)
"""


def _report(spark, folder):
    tally = changes.crawl_tally(
        _gated(spark, folder), F.first("gate_error", ignorenulls=True).alias("error")
    )
    return tally.join(reports.chunk_counts(_pieces(spark, folder)), "source_id")


@query(f"WITH {_REPORT_SQL} SELECT * FROM report")
def crawl_report(spark, folder):
    return _report(spark, folder)


@query(
    f"""WITH {_REPORT_SQL},
    lines AS (
      SELECT NULL AS source_id, -1 AS line_number,
        CASE WHEN count(*) > 0 THEN 'failed' ELSE 'ok' END AS line FROM report WHERE error <> ''
      UNION ALL SELECT source_id, 0 AS line_number, source_id || ': indexados=' || indexed_files
        || ' pulados=' || skipped_files || ' removidos=' || removed_files
        || ' chunks=' || chunk_count AS line FROM report
      UNION ALL SELECT source_id, 1, source_id || ': ' || error FROM report WHERE error <> '')
    SELECT source_id, line_number, line FROM lines"""
)
def crawl_report_lines(spark, folder):
    """The lines of all sources, and one that says whether any failed."""
    report = stage(_report(spark, folder), "report")
    flag = reports.any_failed(report).select(
        F.lit(None).cast("string").alias("source_id"),
        F.lit(-1).alias("line_number"),
        F.when(F.col("failed"), "failed").otherwise("ok").alias("line"),
    )
    return reports.report_lines(report).unionByName(flag)


@query(
    f"""WITH {STORED_SQL}, docs AS (SELECT source_id, path, text FROM stored_texts),
    pieces AS ({windows_sql('docs', 'source_id, path')}),
    counted AS (SELECT source_id, count(*) AS n FROM pieces GROUP BY ALL)
    SELECT source_id, coalesce(n, 0) AS chunk_count
    FROM (SELECT DISTINCT source AS source_id FROM documents
          UNION ALL SELECT 'lang-' || lang FROM documents GROUP BY lang) s
    LEFT JOIN counted USING (source_id)"""
)
def chunk_counts(spark, folder):
    """Counts per crawled source; the language sources have no chunks."""
    rows = table(spark, folder, "documents")
    crawled = (
        rows.select(F.col("source").alias("source_id"))
        .unionByName(rows.select(F.concat(F.lit("lang-"), "lang").alias("source_id")))
        .distinct()
    )
    return reports.crawled_counts(crawled, fixed_chunks(stored_texts(spark, folder)))


@query(
    f"""SELECT source_id, path, max(d)::INTEGER AS embed_dim FROM (
      SELECT source AS source_id, {PATH_SQL} AS path, 0 AS d FROM documents
      UNION ALL
      SELECT source, lang || '/' || doc_id || '.md', len(embedding) FROM documents
      JOIN embeddings ON vec_id = doc_id) GROUP BY ALL"""
)
def file_dims(spark, folder):
    """Documents with a vector of their number have chunks, the others none."""
    rows = table(spark, folder, "documents")
    chunks = rows.join(
        table(spark, folder, "embeddings"), F.col("vec_id") == F.col("doc_id")
    ).select(F.col("source").alias("source_id"), doc_path().alias("path"), "embedding")
    files = rows.select(F.col("source").alias("source_id"), doc_path().alias("path"))
    return reports.file_dimensions(files, chunks)


@query(
    f"""SELECT id, kind, last_commit, last_error, sum(n)::BIGINT AS chunk_count FROM (
      SELECT source AS id, 'local' AS kind, NULL::VARCHAR AS last_commit,
        md5(min(text)) AS last_error, count(*) AS n FROM documents GROUP BY source
      UNION ALL
      SELECT {GONE_SOURCE_SQL} || '-old', 'git', md5({GONE_SOURCE_SQL}), NULL, count(*)
      FROM pages GROUP BY 1, 3) GROUP BY ALL"""
)
def source_status_upsert(spark, folder):
    """Stored: every page source, twice over; crawled: the documents' sources."""
    at = F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc))
    pages = table(spark, folder, "pages").select(gone_source().alias("source"))
    columns = ["id", "kind", "last_crawl_at", "last_commit", "last_error", "chunk_count"]
    none = F.lit(None).cast("string")

    def stored(suffix):
        return pages.groupBy("source").agg(F.count("*").alias("chunk_count")).select(
            F.concat("source", F.lit(suffix)).alias("id"), F.lit("git").alias("kind"),
            at.alias("last_crawl_at"), F.md5(F.col("source").cast("binary")).alias("last_commit"),
            none.alias("last_error"), "chunk_count",
        )

    fresh = table(spark, folder, "documents").groupBy("source").agg(
        F.md5(F.min("text").cast("binary")).alias("last_error"), F.count("*").alias("chunk_count")
    ).select(
        F.col("source").alias("id"), F.lit("local").alias("kind"), at.alias("last_crawl_at"),
        none.alias("last_commit"), "last_error", "chunk_count",
    )
    before = stored("").unionByName(stored("-old")).select(*columns)
    return changes.upsert_status(before, fresh).drop("last_crawl_at")


_PLACED_SQL = """
named AS (
  SELECT source AS source_id, doc_id AS number,
    lang || CASE WHEN n_chars % 2 = 0 THEN '/' ELSE '-' END || doc_id || '.md' AS path
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY string_split(path, '/'))
      AS position, count(*) OVER (PARTITION BY source_id) AS total FROM named)
"""


def _named(spark, folder):
    """Paths like a/1.md and a-2.md, which component order tells apart."""
    separator = F.when(F.col("n_chars") % 2 == 0, "/").otherwise("-")
    return table(spark, folder, "documents").select(
        F.col("source").alias("source_id"),
        F.concat("lang", separator, "doc_id", F.lit(".md")).alias("path"),
        "text",
    )


@query(f"WITH {_PLACED_SQL} SELECT source_id, path, position, total FROM placed")
def crawl_positions(spark, folder):
    return reports.crawl_positions(_named(spark, folder).select(*KEYS))


@query(
    f"""WITH {_PLACED_SQL},
    docs AS (
      SELECT source_id, path, text FROM placed JOIN documents ON doc_id = number),
    pieces AS MATERIALIZED ({windows_sql('docs', 'source_id, path')}),
    sizes AS (SELECT source_id, path, count(*) AS n_chunks FROM pieces GROUP BY ALL),
    lines AS (
      SELECT *, source_id || ': arquivo ' || position || ' de ' || total || ' ' || path AS line,
        ceil(coalesce(n_chunks, 0) / 16)::BIGINT AS batches
      FROM placed LEFT JOIN sizes USING (source_id, path))
    SELECT source_id, 0 AS position, 0 AS batch, source_id || ': ' || total || ' arquivos' AS line
    FROM lines WHERE position = 1
    UNION ALL SELECT source_id, position, 0, line FROM lines
    UNION ALL SELECT source_id, position, batch, line || ' (lote ' || batch || ' de ' || batches || ')'
    FROM (SELECT *, unnest(range(1, batches + 1)) AS batch FROM lines WHERE batches > 1)"""
)
def progress_log(spark, folder):
    """The log of a crawl that embeds the chunks of all documents."""
    files = _named(spark, folder)
    sizes = fixed_chunks(files).groupBy(*KEYS).agg(F.count("*").alias("n_chunks"))
    placed = reports.crawl_positions(files.select(*KEYS))
    return reports.progress_log(placed.join(sizes, KEYS, "left"))


@query(
    f"""WITH docs AS (SELECT doc_id, text FROM documents),
    pieces AS ({windows_sql('docs', 'doc_id')})
    SELECT doc_id, chunk_index, chunk_index // 16 + 1 AS batch_number,
      (count(*) OVER (PARTITION BY doc_id) + 15) // 16 AS batch_total FROM pieces"""
)
def embedding_batches(spark, folder):
    pieces = fixed_chunks(table(spark, folder, "documents").select("doc_id", "text"))
    sizes = pieces.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return reports.chunk_batches(pieces.join(sizes, "doc_id")).select(
        "doc_id", F.col("chunk_index").cast("long"), "batch_number", "batch_total"
    )


# Every document stands for a registry entry, so ids repeat a lot.
_ENTRIES_SQL = """
entries AS (
  SELECT doc_id::INTEGER AS ordinal,
    CASE WHEN n_chars % 7 = 0 THEN '.' || source || ' ' WHEN n_chars % 7 = 1 THEN ' ' || source
         WHEN n_chars % 7 = 2 THEN source || '/' || doc_id ELSE source || '-' || doc_id END AS raw_id,
    CASE WHEN n_chars % 5 = 0 THEN 'svn' WHEN n_chars % 2 = 0 THEN 'git' ELSE 'local' END AS kind,
    CASE WHEN n_chars % 3 = 0 THEN '  ' ELSE '/data/' || source END AS raw_path,
    CASE WHEN n_chars % 3 = 1 THEN NULL ELSE 'https://' || source END AS raw_url,
    CASE WHEN n_chars % 4 = 0 THEN 'dev' END AS raw_branch,
    n_chars % 11 <> 0 AS included
  FROM documents),
clean AS (
  SELECT *, trim(raw_id) AS source_id, nullif(trim(raw_path), '') AS path, raw_url AS url,
    coalesce(raw_branch, CASE WHEN kind = 'git' THEN 'main' END) AS branch FROM entries)
"""


def _entries(spark, folder):
    n = F.col("n_chars")
    source, number = F.col("source"), F.col("doc_id")
    return table(spark, folder, "documents").select(
        number.cast("int").alias("ordinal"),
        F.when(n % 7 == 0, F.concat(F.lit("."), source, F.lit(" ")))
        .when(n % 7 == 1, F.concat(F.lit(" "), source))
        .when(n % 7 == 2, F.concat(source, F.lit("/"), number))
        .otherwise(F.concat(source, F.lit("-"), number))
        .alias("source_id"),
        F.when(n % 5 == 0, "svn").when(n % 2 == 0, "git").otherwise("local").alias("kind"),
        F.when(n % 3 == 0, "  ").otherwise(F.concat(F.lit("/data/"), source)).alias("path"),
        F.when(n % 3 != 1, F.concat(F.lit("https://"), source)).alias("url"),
        F.when(n % 4 == 0, "dev").alias("branch"),
        F.when(n % 11 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("**/*.md")))
        .alias("include"),
        F.lit(None).cast("array<string>").alias("exclude"),
    )


@query(
    f"""WITH {_ENTRIES_SQL},
    firsts AS (SELECT source_id, min(ordinal) AS first FROM clean GROUP BY source_id)
    SELECT ordinal, source_id, violation FROM (
      SELECT ordinal, source_id, unnest([
        CASE WHEN NOT regexp_full_match(source_id, '[A-Za-z0-9][A-Za-z0-9._-]{{0,63}}')
             THEN 'bad_id' END,
        CASE WHEN ordinal > first THEN 'repeated_id' END,
        CASE WHEN kind NOT IN ('local', 'git') THEN 'unknown_kind' END,
        CASE WHEN NOT included THEN 'no_include' END,
        CASE WHEN kind = 'local' AND path IS NULL THEN 'no_path' END,
        CASE WHEN kind = 'git' AND url IS NULL THEN 'no_url' END]) AS violation
      FROM clean JOIN firsts USING (source_id)) WHERE violation IS NOT NULL"""
)
def registry_check(spark, folder):
    return registry_violations(_entries(spark, folder))


@query(
    f"""WITH {_ENTRIES_SQL}
    SELECT ordinal, source_id, kind, path, url, branch FROM clean WHERE kind = 'local'"""
)
def local_sources(spark, folder):
    entries = local_only(normalized_registry(_entries(spark, folder)))
    return entries.drop("include", "exclude")


@query(
    f"""WITH registry AS (
      SELECT substring(source, 4)::INTEGER AS ordinal, source AS id FROM documents GROUP BY ALL
      UNION ALL SELECT 1000 + ascii(lang), lang FROM documents GROUP BY ALL),
    status AS (
      SELECT {GONE_SOURCE_SQL} AS id, md5(min(url)) AS last_commit, NULL::VARCHAR AS last_error
      FROM pages GROUP BY 1
      UNION ALL SELECT DISTINCT 'dropped', 'x', 'y' FROM pages),
    {_PIECES_SQL},
    counts AS (SELECT source_id AS id, count(*) AS n FROM pieces GROUP BY ALL)
    SELECT ordinal, id, 'local' AS kind, last_commit, last_error,
      CASE WHEN last_commit IS NOT NULL THEN '2024-01-01 00:00:00' END AS last_crawl_at,
      coalesce(n, 0) AS chunk_count
    FROM registry LEFT JOIN status USING (id) LEFT JOIN counts USING (id)"""
)
def list_sources(spark, folder):
    rows = table(spark, folder, "documents")
    registry = (
        rows.select(F.substring("source", 4, 9).cast("int").alias("ordinal"),
                    F.col("source").alias("source_id"))
        .unionByName(rows.select((F.ascii("lang") + 1000).alias("ordinal"),
                                 F.col("lang").alias("source_id")))
        .distinct()
        .withColumn("kind", F.lit("local"))
    )
    pages = table(spark, folder, "pages")
    status = (
        pages.groupBy(gone_source().alias("id"))
        .agg(F.md5(F.min("url").cast("binary")).alias("last_commit"))
        .withColumn("last_error", F.lit(None).cast("string"))
        .unionByName(
            pages.select(
                F.lit("dropped").alias("id"), F.lit("x").alias("last_commit"),
                F.lit("y").alias("last_error"),
            ).distinct()
        )
        .withColumn("kind", F.lit("local"))
        .withColumn("last_crawl_at", F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc)))
        .withColumn("chunk_count", F.lit(-1))
    )
    counts = reports.chunk_counts(_pieces(spark, folder))
    listed = sources_listing(registry, status, counts)
    return listed.withColumn("last_crawl_at", F.date_format("last_crawl_at", "yyyy-MM-dd HH:mm:ss"))


# Crawls -------------------------------------------------------------------

_RULES = Indexing(RuleEmbedder({"the": [0.6, 0.8], "que": [-0.8, 0.6]}, [0.3, 0.1]), "m1")
_FINAL_FILES_SQL = f"""
SELECT source AS source_id, {PATH_SQL} AS path, sha256(text) AS content_hash,
  'm1' AS embed_model,
  CASE WHEN regexp_matches(text, '[^{SPACES_SQL}]') THEN 2 ELSE 0 END::INTEGER AS embed_dim
FROM documents
"""
_FILE_COLUMNS = ["source_id", "path", "content_hash", "embed_model", "embed_dim"]


def _registry(spark, folder, path=None):
    """One local source per source of the documents."""
    return (
        table(spark, folder, "documents").select("source").distinct()
        .select(
            F.substring("source", 4, 9).cast("int").alias("ordinal"),
            F.col("source").alias("source_id"),
            F.lit("local").alias("kind"),
            (F.concat(F.lit(f"{path}/"), "source") if path else F.lit("-")).alias("path"),
            F.lit(None).cast("string").alias("url"),
            F.lit(None).cast("string").alias("branch"),
            F.array(F.lit("**/*.md")).alias("include"),
            F.array(F.lit("**/drafts/*")).alias("exclude"),
        )
        .select(*REGISTRY.names)
    )


def _crawled(spark, folder) -> IndexStore:
    """Two crawls: the stored state, then the documents."""
    store = IndexStore(spark, fresh_path(spark, "index"))
    registry = _registry(spark, folder)
    before = documents_from_table(
        stored_texts(spark, folder), F.col("source_id"), F.col("path"), F.col("text")
    )
    crawl(store, registry, before, _RULES)
    crawl(store, registry, documents(spark, folder), _RULES)
    return store


@query(_FINAL_FILES_SQL)
def incremental_crawl(spark, folder):
    """The files in the index after two crawls."""
    return _crawled(spark, folder).files().select(*_FILE_COLUMNS)


_INDEXED_CHUNKS_SQL = f"""
SELECT source AS source_id, {PATH_SQL} AS path, true AS numbered, true AS contained,
  true AS covered, true AS by_rule
FROM documents WHERE regexp_matches(text, '[^{SPACES_SQL}]')
"""


def _chunk_facts(store, spark, folder):
    """Per file: chunks numbered from 0 without gaps, parts of the text, covering it, with their vectors.

    Chunks and texts meet once a file, so a text is searched, and measured, once and not
    with each of its chunks.
    """
    texts = table(spark, folder, "documents").select(
        F.col("source").alias("source_id"), doc_path().alias("path"), F.col("text").alias("whole")
    )
    solid = lambda text: F.char_length(F.regexp_replace(text, r"\s+", "")).cast("long")
    rule = _RULES.embedder.column(F.col("text")).cast("array<float>")
    # A path may stand for several documents, as many times as it does.
    wholes = texts.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("times"), F.collect_set("whole").alias("wholes"), F.bool_or(F.col("whole").isNull()).alias("lost")
    )
    files = store.chunks(_RULES.model).groupBy(*KEYS).agg(
        F.collect_list("text").alias("pieces"), F.collect_set("chunk_index").alias("numbers"), F.count(F.lit(1)).alias("n"),
        F.sum(solid(F.col("text"))).alias("solid"), F.bool_and(F.col("embedding") == rule).alias("by_rule"),
    )
    n, times = F.col("n") * F.coalesce("times", F.lit(1)), F.coalesce("times", F.lit(1))
    within = F.forall("pieces", lambda piece: F.forall("wholes", lambda whole: F.contains(whole, piece)))
    return files.join(wholes, KEYS, "left").select(
        *KEYS,
        ((F.size("numbers") == n) & (F.array_max("numbers") == n - 1)).alias("numbered"),
        F.coalesce(~F.col("lost") & within, F.lit(False)).alias("contained"),
        (F.col("solid") * times >= F.array_max(F.transform("wholes", solid))).alias("covered"),
        "by_rule",
    )


@query(_INDEXED_CHUNKS_SQL)
def incremental_chunks(spark, folder):
    """What two crawls leave as chunks, checked against the texts."""
    return _chunk_facts(_crawled(spark, folder), spark, folder)


def _versions(spark, folder):
    """The feed: first texts and the pages, then final texts and deletions."""
    rows = table(spark, folder, "documents")
    final = rows.select(
        F.col("source").alias("source_id"), doc_path().alias("path"),
        F.col("text").cast("binary").alias("content"),
        F.lit(2).cast("long").alias("version"), F.lit(False).alias("deleted"),
    )
    first = final.withColumn("content", F.concat("content", F.lit("x").cast("binary"))).withColumn(
        "version", F.lit(1).cast("long")
    )
    pages = table(spark, folder, "pages").select(
        gone_source().alias("source_id"),
        F.concat(F.lit("gone/"), "page_id", F.lit(".md")).alias("path"),
        F.col("html").cast("binary").alias("content"),
        F.lit(1).cast("long").alias("version"), F.lit(False).alias("deleted"),
    )
    gone = (
        pages.withColumn("content", F.lit(None).cast("binary"))
        .withColumn("version", F.lit(2).cast("long"))
        .withColumn("deleted", F.lit(True))
    )
    return first.unionByName(pages), final.unionByName(gone)


def _streamed(spark, folder) -> IndexStore:
    """The feed written as two sets of files, the stream run to its end after each."""
    store = IndexStore(spark, fresh_path(spark, "index"))
    feed = fresh_path(spark, "feed")
    state = fresh_path(spark, "stream-state")
    registry = _registry(spark, folder)
    for rows in _versions(spark, folder):
        rows.write.mode("append").parquet(feed)
        stream = spark.readStream.schema(rows.schema).parquet(feed)
        index_stream(store, registry, stream, _RULES, state).awaitTermination()
    return store


@query(_FINAL_FILES_SQL)
def stream_index(spark, folder):
    """The files in the index after the stream."""
    return _streamed(spark, folder).files().select(*_FILE_COLUMNS)


@query(_INDEXED_CHUNKS_SQL)
def stream_chunks(spark, folder):
    """What the stream leaves as chunks, checked against the texts."""
    return _chunk_facts(_streamed(spark, folder), spark, folder)


def _shuffled_feed(spark, folder):
    """Three versions of each document over three sets of files, in an order that its id decides.

    The last version of every seventh document deletes it; pages come and go.
    """
    first, final = _versions(spark, folder)
    rows = table(spark, folder, "documents").select(
        F.col("source").alias("source_id"), doc_path().alias("path"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("last "), "text").cast("binary")).alias("content"),
        F.lit(3).cast("long").alias("version"), (F.col("doc_id") % 7 == 0).alias("deleted"),
    )
    everything = first.unionByName(final).unionByName(rows)
    part = F.pmod(F.xxhash64("path", "version"), F.lit(3))
    return [everything.where(part == k) for k in range(3)]


@query(
    f"""SELECT source AS source_id, {PATH_SQL} AS path, sha256('last ' || text) AS content_hash
    FROM documents WHERE doc_id % 7 <> 0"""
)
def stream_versions(spark, folder):
    """The files that remain when versions arrive in any order over micro-batches."""
    store = IndexStore(spark, fresh_path(spark, "index"))
    feed, state = fresh_path(spark, "feed"), fresh_path(spark, "stream-state")
    registry = _registry(spark, folder)
    for rows in _shuffled_feed(spark, folder):
        rows.write.mode("append").parquet(feed)
        stream = spark.readStream.schema(rows.schema).parquet(feed)
        index_stream(store, registry, stream, _RULES, state).awaitTermination()
    return store.files().select("source_id", "path", "content_hash")


def _write_files(batches):
    for batch in batches:
        for root, path, content in batch.itertuples(index=False):
            target = os.path.join(root, path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as file:
                file.write(content)
        yield pd.DataFrame({"written": [len(batch)]})


@query(
    f"""SELECT source AS source_id, {PATH_SQL} AS path, sha256(text) AS content_hash,
      length(text) AS n_chars FROM documents"""
)
def tree_scan(spark, folder):
    """Documents written as files by the executors, then scanned as trees."""
    root = fresh_path(spark, "tree").removeprefix("file:")
    files = documents(spark, folder).select(
        F.concat(F.lit(f"{root}/"), "source_id").alias("root"), "path", "content"
    )
    skipped = files.withColumn("path", F.concat(F.lit("node_modules/"), "path"))
    drafts = files.withColumn("path", F.concat(F.lit("x/drafts/"), "path"))
    everything = files.unionByName(skipped).unionByName(drafts)
    everything.mapInPandas(_write_files, "written long").agg(F.sum("written")).collect()
    content = F.col("content")
    scan = scan_tree(_registry(spark, folder, root))
    if not scan.source_errors.isEmpty():
        raise RuntimeError("a tree could not be listed")
    return scan.documents.select(
        *KEYS,
        F.sha2(content, 256).alias("content_hash"),
        F.char_length(content.cast("string")).cast("long").alias("n_chars"),
    )


def _write_tree(rows, root):
    """Each document as a file below `source=S`, its text and a line break.

    Files on a mounted folder are written by tasks themselves, some thousand ids to a
    folder: Hadoop's local file system starts a process for every folder and file it
    makes. Other stores get a folder for each document from Spark's writer.
    """
    if not root.startswith("file:"):
        rows.select("source", "doc_id", "text").write.partitionBy("source", "doc_id").text(root)
        return
    # As in that writer, rows of one id are one file, and a source without a name has a default one.
    lines = F.array_join(F.sort_array(F.collect_list(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")))), "")
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    path = F.concat(F.lit("source="), "source", F.lit("/"), F.expr("doc_id DIV 20000"), F.lit("/doc_id="), "doc_id", F.lit(".txt"))
    files = rows.groupBy(source.alias("source"), "doc_id").agg(lines.alias("text")).select(
        F.lit("/" + root.removeprefix("file:").lstrip("/")).alias("root"), path.alias("path"), F.col("text").cast("binary").alias("content")
    )
    files.mapInPandas(_write_files, "written long").agg(F.sum("written")).collect()


@query(
    r"""WITH docs AS (
      SELECT doc_id, source, text || chr(10) AS text,
        string_split_regex(text, '[\n\x{85}\x{2028}]') AS lines,
        CASE WHEN doc_id % 10 > 0 THEN (doc_id % 4)::INTEGER END AS start_line,
        CASE WHEN doc_id % 10 > 1 THEN (doc_id % 6)::INTEGER END AS end_line
      FROM documents)
    SELECT doc_id AS request_id, source AS source_id,
      CASE WHEN doc_id % 10 IN (8, 9) THEN NULL
        WHEN start_line IS NULL AND end_line IS NULL THEN text
        ELSE array_to_string(list_slice(lines, greatest(coalesce(start_line, 1), 1),
          CASE WHEN end_line IS NULL THEN len(lines)
          ELSE greatest(end_line, greatest(coalesce(start_line, 1), 1)) END), chr(10)) END AS text,
      CASE doc_id % 10 WHEN 8 THEN 'missing_document' WHEN 9 THEN 'unsafe_path' END AS error
    FROM docs"""
)
def tree_read(spark, folder):
    """Whole files and line ranges read from trees that tasks wrote, by path.

    A source's files are named by the listing of its root, a URI of the shared folder.
    """
    path = fresh_path(spark, "read-tree")
    root = path if ":" in path.split("/")[0] else f"file://{path}"
    _write_tree(table(spark, folder, "documents"), root)
    registry = _registry(spark, folder, f"{root}/source=").withColumn("path", F.replace("path", F.lit("source=/"), F.lit("source=")))
    registry = registry.withColumn("include", F.array(F.lit("**/*.txt")))
    number = F.regexp_extract("path", r"\bdoc_id=(\d+)[/.]", 1).cast("long")
    listed = scan_tree(registry).files.select("source_id", "path", number.alias("request_id"))
    requests = stage(
        listed.select(
            "request_id", "source_id",
            F.when(number % 10 == 8, F.concat("path", F.lit(".md"))).when(number % 10 == 9, F.concat(F.lit("../"), "path"))
            .otherwise(F.col("path")).alias("path"),
            F.when(number % 10 > 0, (number % 4).cast("int")).alias("start_line"),
            F.when(number % 10 > 1, (number % 6).cast("int")).alias("end_line"),
        ),
        "requests",
    )
    wanted = requests.where(is_safe_path(F.col("path"))).select("source_id", "path").distinct()
    documents_ = open_paths(wanted, registry)
    return read_requests(requests, registry, documents_).select("request_id", "source_id", "text", "error")
