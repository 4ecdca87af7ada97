"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlpit.functions.vectors import cosine
from marlpit.operators.chunking import fixed_chunks
from marlpit.operators.embedding import HashEmbedder, embed_chunks
from marlpit.operators.reports import dimension_check, query_dimension_check
from marlpit.operators.retrieval import rerank, scope_chunks, top_chunks, with_vectors
from marlpit.plans.search import search
from queries import query, table
from queries.fixtures import (
    PATH_SQL,
    VECTORS_SQL,
    cosine_sql,
    doc_path,
    hashed_sql,
    hits_sql,
    hashed_sql,
    hits_sql,
    top_sql,
    vector_chunks,
    vector_queries,
    windows_sql,
)

_TOP = "query_id, candidate, source_id, path, chunk_index, score"
_HIT = "hit.text AS page_content, hit.source_id AS source_id, hit.path AS path, hit.chunk_index AS chunk_index, hit.score AS score"


@query(
    f"""WITH {VECTORS_SQL}, {top_sql("c.embed_model = 'm1'")}
    SELECT query_id, rank, {_HIT} FROM ({hits_sql()})"""
)
def mmr_search(spark, folder):
    hits = search(vector_queries(spark, folder), vector_chunks(spark, folder), "m1")
    return hits.select(
        "query_id", "rank", "page_content", *[
            f"metadata.{name}" for name in ("source_id", "path", "chunk_index", "score")
        ]
    )


@query(f"WITH {VECTORS_SQL}, {top_sql()} SELECT {_TOP} FROM top")
def topk_cosine(spark, folder):
    top = top_chunks(vector_queries(spark, folder), vector_chunks(spark, folder))
    return top.selectExpr(*_TOP.split(", "))


@query(f"WITH {VECTORS_SQL}, {top_sql()} SELECT {_TOP} FROM top")
def sliced_search(spark, folder):
    """All vectors as questions, in many slices that share one scan of the chunks."""
    top = top_chunks(vector_queries(spark, folder), vector_chunks(spark, folder), per_slice=16)
    return top.selectExpr(*_TOP.split(", "))


@query(
    f"""WITH {VECTORS_SQL},
    {top_sql("c.embed_model = 'm1' AND c.source_id IN ('s1', 's2', 's5', 's8')")}
    SELECT {_TOP} FROM top"""
)
def scoped_search(spark, folder):
    chunks = scope_chunks(vector_chunks(spark, folder), "m1", ["s1", "s2", "s5", "s8"])
    return top_chunks(vector_queries(spark, folder), chunks).selectExpr(*_TOP.split(", "))


@query(
    f"""WITH {VECTORS_SQL}, {top_sql('''
      (q.label = 9 OR c.source_id IN ('s' || q.label, 's' || (q.label + 1)))
      AND q.label <> 7 ''')}
    SELECT query_id, rank, hit.source_id AS source_id, hit.path AS path, hit.score AS score FROM ({hits_sql(6)})"""
)
def question_scopes(spark, folder):
    """Each question limited to two sources; label 9 asks all, label 7 none."""
    label = F.col("label")
    sources = F.array(F.concat(F.lit("s"), label), F.concat(F.lit("s"), label + 1))
    queries = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.when(label == 7, F.array().cast("array<string>"))
        .when(label < 9, sources)
        .alias("source_ids"),
    )
    chunks = vector_chunks(spark, folder)
    hits = rerank(with_vectors(top_chunks(queries, chunks), chunks), k=6)
    return hits.select("query_id", "rank", "source_id", "path", "score")


@query(f"WITH {VECTORS_SQL}, {top_sql('false')} SELECT {_TOP} FROM top")
def empty_scope_search(spark, folder):
    chunks = scope_chunks(vector_chunks(spark, folder), "m1", [])
    return top_chunks(vector_queries(spark, folder), chunks).selectExpr(*_TOP.split(", "))


@query(
    f"""WITH {VECTORS_SQL}
    SELECT a.query_id AS vec_id, round({cosine_sql('a.v', 'b.v')}, 9) AS score
    FROM questions a JOIN chunks b ON b.path = (a.query_id + 1)::VARCHAR"""
)
def zero_vector_score(spark, folder):
    """Each vector against the next, scaled one; those of label 0 score 0."""
    following = vector_chunks(spark, folder).select(
        (F.col("path").cast("long") - 1).alias("query_id"), F.col("embedding").alias("next")
    )
    return vector_queries(spark, folder).join(following, "query_id").select(
        F.col("query_id").alias("vec_id"),
        F.round(cosine(F.col("embedding"), F.col("next").cast("array<double>")), 9).alias("score"),
    )


@query(
    f"""WITH docs AS (SELECT source AS source_id, {PATH_SQL} AS path, text FROM documents),
    chunks AS (
      SELECT source_id, path, chunk_index, text, [x::FLOAT::DOUBLE FOR x IN {hashed_sql('text')}] AS v
      FROM ({windows_sql('docs', 'source_id, path')})),
    questions AS (SELECT item_id AS query_id, {hashed_sql('text')} AS v FROM benchmark),
    {top_sql()}
    SELECT query_id, rank, {_HIT} FROM ({hits_sql()})"""
)
def text_search(spark, folder):
    """Benchmark texts as questions over all documents: embed, score, re-rank."""
    embedder = HashEmbedder(64)
    documents = table(spark, folder, "documents").select(
        F.col("source").alias("source_id"), doc_path().alias("path"), "text"
    )
    chunks = embed_chunks(fixed_chunks(documents), embedder, "hash")
    questions = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = search(questions, chunks, "hash", embedder=embedder)
    return hits.select(
        "query_id", "rank", "page_content", *[
            f"metadata.{name}" for name in ("source_id", "path", "chunk_index", "score")
        ]
    )


_CUT_SQL = """
  SELECT source_id, embed_model, path,
         CASE WHEN source_id IN ('s3', 's6') THEN v[1:len(v) - vec_id % 2] ELSE v END AS v
  FROM (SELECT 's' || label AS source_id, vec_id::VARCHAR AS path, vec_id, embedding AS v,
               CASE WHEN embedding[1] < -0.125 THEN 'm0' ELSE 'm1' END AS embed_model
        FROM embeddings)
"""


def _cut_vectors(spark, folder):
    """Chunks of two sources lose their last component now and then."""
    odd = F.col("source_id").isin("s3", "s6") & (F.col("path").cast("long") % 2 == 1)
    return vector_chunks(spark, folder).withColumn(
        "embedding",
        F.when(odd, F.slice("embedding", 1, F.size("embedding") - 1)).otherwise(F.col("embedding")),
    )


@query(
    f"""SELECT source_id, embed_model, min(len(v))::INTEGER AS min_dim,
      max(len(v))::INTEGER AS max_dim
    FROM ({_CUT_SQL}) GROUP BY ALL HAVING min(len(v)) <> max(len(v))"""
)
def dimension_violations(spark, folder):
    return dimension_check(_cut_vectors(spark, folder), "source_id", "embed_model")


@query(
    f"""SELECT q.lo AS query_min_dim, q.hi AS query_max_dim,
      c.lo AS index_min_dim, c.hi AS index_max_dim, false AS compatible
    FROM (SELECT min(len(v))::INTEGER AS lo, max(len(v))::INTEGER AS hi FROM ({_CUT_SQL})) c,
         (SELECT min(len(embedding))::INTEGER AS lo, max(len(embedding))::INTEGER AS hi
          FROM embeddings) q"""
)
def query_dimensions(spark, folder):
    return query_dimension_check(vector_queries(spark, folder), _cut_vectors(spark, folder))
