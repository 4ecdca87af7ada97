"""Inputs derived from the driver tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marlpit.sources.tables import documents_from_table
from queries import table

# documents as files -------------------------------------------------------

PATH_SQL = "lang || '/' || doc_id || '.md'"


def doc_path():
    return F.concat("lang", F.lit("/"), "doc_id", F.lit(".md"))


def documents(spark, folder) -> DataFrame:
    return documents_from_table(
        table(spark, folder, "documents"), F.col("source"), doc_path(), F.col("text")
    )


SCAN_SQL = f"""
scan AS (
  SELECT source AS source_id, {PATH_SQL} AS path, sha256(text) AS content_hash
  FROM documents)
"""

# stored state: toxic documents are not stored yet (new), those of quality 0
# were edited since, French ones belong to another model, and every page is a
# stored file that the listing no longer has (removed).

GONE_SOURCE_SQL = "'src' || (page_id % 20)"


def gone_source():
    return F.concat(F.lit("src"), F.col("page_id") % 20)


def labelled(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").join(
        table(spark, folder, "labels"), "doc_id", "left"
    )


def stored_texts(spark, folder) -> DataFrame:
    """(source_id, path, text, embed_model) of the files stored before."""
    known = labelled(spark, folder).where("coalesce(toxic, 0) = 0")
    edited = F.coalesce(F.col("quality"), F.lit(1)) == 0
    kept = known.select(
        F.col("source").alias("source_id"),
        doc_path().alias("path"),
        F.when(edited, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("lang") == "fr", "m0").otherwise("m1").alias("embed_model"),
    )
    gone = table(spark, folder, "pages").select(
        gone_source().alias("source_id"),
        F.concat(F.lit("gone/"), "page_id", F.lit(".md")).alias("path"),
        F.col("html").alias("text"),
        F.lit("m1").alias("embed_model"),
    )
    return kept.unionByName(gone)


def stored_files(spark, folder) -> DataFrame:
    return stored_texts(spark, folder).select(
        "source_id", "path", F.sha2("text", 256).alias("content_hash"), "embed_model"
    )


STORED_TEXTS_SQL = f"""
stored_texts AS (
  SELECT source AS source_id, {PATH_SQL} AS path,
         CASE WHEN coalesce(quality, 1) = 0 THEN text || 'x' ELSE text END AS text,
         CASE WHEN lang = 'fr' THEN 'm0' ELSE 'm1' END AS embed_model
  FROM documents LEFT JOIN labels USING (doc_id)
  WHERE coalesce(toxic, 0) = 0
  UNION ALL
  SELECT {GONE_SOURCE_SQL}, 'gone/' || page_id || '.md', html, 'm1' FROM pages)
"""
STORED_SQL = f"""
{STORED_TEXTS_SQL},
stored AS (
  SELECT source_id, path, sha256(text) AS content_hash, embed_model FROM stored_texts)
"""
PLAN_SQL = f"""
{SCAN_SQL}, {STORED_SQL},
plan AS (
  SELECT source_id, path,
         CASE WHEN n.content_hash IS NULL THEN 'remove'
              WHEN o.content_hash IS NULL THEN 'new'
              WHEN n.content_hash <> o.content_hash THEN 'edited'
              WHEN o.embed_model <> 'm1' THEN 'remodel'
              ELSE 'skip' END AS action,
         n.content_hash AS content_hash
  FROM scan n FULL OUTER JOIN stored o USING (source_id, path))
"""

# embeddings as chunks: vectors scaled by their label, which leaves those of
# label 0 without length; the model depends on the first component.


def vector_chunks(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("s"), "label").alias("source_id"),
        F.col("vec_id").cast("string").alias("path"),
        F.lit(0).alias("chunk_index"),
        F.concat(F.lit("text of "), "vec_id").alias("text"),
        F.transform("embedding", lambda x: (x * F.col("label")).cast("float")).alias("embedding"),
        F.when(F.col("embedding")[0] < -0.125, "m0").otherwise("m1").alias("embed_model"),
    )


def vector_queries(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


VECTORS_SQL = """
chunks AS (
  SELECT 's' || label AS source_id, vec_id::VARCHAR AS path, 0 AS chunk_index,
         'text of ' || vec_id AS text,
         [(x::DOUBLE * label)::FLOAT::DOUBLE FOR x IN embedding] AS v,
         CASE WHEN embedding[1] < -0.125 THEN 'm0' ELSE 'm1' END AS embed_model
  FROM embeddings),
questions AS (
  SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM embeddings)
"""


def cosine_sql(a: str, b: str) -> str:
    return (
        f"CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 "
        f"THEN 0.0 ELSE list_cosine_similarity({a}, {b}) END"
    )


def top_sql(where: str = "true", fetch_k: int = 20) -> str:
    """CTE `top` from `chunks` and `questions`; no CTE is referred to twice."""
    return f"""
top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id
             ORDER BY score DESC, source_id, path, chunk_index) AS candidate
    FROM (SELECT q.query_id, c.source_id, c.path, c.chunk_index, c.text, c.v,
                 round({cosine_sql('q.v', 'c.v')}, 9) AS score
          FROM questions q, chunks c WHERE {where}))
  WHERE candidate <= {fetch_k})
"""


def hits_sql(k: int = 4) -> str:
    """Query: query_id, rank, hit of re-ranking `top`, a fold over one list for each question.

    Each step reads the one before once: the values of all candidates, null where
    picked already, and the place of the first of the highest.
    """
    rows = f"""
  SELECT query_id, c, [[{cosine_sql('a.v', 'b.v')} FOR b IN c] FOR a IN c] AS near, [1::BIGINT] AS picks
  FROM (SELECT query_id, list(struct_pack(source_id, path, chunk_index, text, v, score) ORDER BY candidate) AS c
        FROM top GROUP BY query_id)"""
    for _ in range(1, k):
        rows = f"""
  SELECT query_id, c, near,
         CASE WHEN len(picks) < len(c) THEN list_append(picks, list_position(worth, list_max(worth)))
              ELSE picks END AS picks
  FROM (SELECT *, [CASE WHEN list_contains(picks, i) THEN NULL
                   ELSE round(0.1::DOUBLE * c[i].score - 0.9::DOUBLE
                              * greatest(0.0::DOUBLE, list_max([near[i][p] FOR p IN picks])), 9)
                   END FOR i IN range(1, len(c) + 1)] AS worth
        FROM ({rows}))"""
    return f"""
  SELECT query_id, rank::INTEGER AS rank, c[pick] AS hit
  FROM (SELECT query_id, c, unnest(picks) AS pick, generate_subscripts(picks, 1) AS rank FROM ({rows}))"""


# fixed windows of a text column -------------------------------------------


def windows_sql(source: str, columns: str, size: int = 500, overlap: int = 50) -> str:
    """Query: columns, chunk_index, text of the non-blank windows of `source`."""
    step = size - overlap
    return f"""
  SELECT {columns}, text,
         row_number() OVER (PARTITION BY {columns} ORDER BY pos) - 1 AS chunk_index
  FROM (SELECT {columns}, pos, substring(text, pos * {step} + 1, {size}) AS text
        FROM (SELECT {columns}, text,
                     unnest(range(1 + ceil(greatest(length(text) - {size}, 0) / {step})::BIGINT))
                     AS pos
              FROM {source} WHERE text <> ''))
  WHERE regexp_matches(text, '[^{SPACES_SQL}]')"""


SPACES_SQL = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


# feature hashing of `texts` (id, text) ------------------------------------

HASH_WEIGHTS_SQL = r"""
terms AS (
  SELECT id, unnest(string_split_regex(lower(text), '[ \t\n\r\f\v]+')) AS term FROM texts),
buckets AS (
  SELECT id, ('0x' || substring(md5(term), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n
  FROM terms WHERE term <> '' GROUP BY ALL),
weights AS (
  SELECT id, bucket, n, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM buckets)
"""


def hashed_sql(text: str, dim: int = 64) -> str:
    """The hashed vector of a text column, as a list."""
    terms = rf"list_filter(string_split_regex(lower({text}), '[ \t\n\r\f\v]+'), lambda t: t <> '')"
    buckets = f"[('0x' || substring(md5(t), 1, 8))::BIGINT % {dim} FOR t IN {terms}]"
    counts = f"[coalesce(h[b], 0)::DOUBLE FOR b IN range({dim})]"
    return f"""(SELECT CASE WHEN size = 0 THEN n ELSE [x / sqrt(size) FOR x IN n] END
      FROM (SELECT n, list_dot_product(n, n) AS size
            FROM (SELECT {counts} AS n FROM (SELECT list_aggregate({buckets}, 'histogram') AS h))))"""
