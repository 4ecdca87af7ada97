"""Search: a table of questions against the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marlpit.operators.embedding import ColumnEmbedder, Embedder, embed_queries
from marlpit.operators.retrieval import (
    FETCH_K,
    KEY,
    RELEVANCE_WEIGHT,
    TOP_K,
    rerank,
    scope_chunks,
    top_chunks,
    with_vectors,
)
from marlpit.runtime import broadcast_if_small, stage


def search(
    queries: DataFrame,
    chunks: DataFrame,
    embed_model: str,
    *,
    embedder: Embedder | ColumnEmbedder | None = None,
    source_ids: list[str] | DataFrame | None = None,
    k: int = TOP_K,
    fetch_k: int = FETCH_K,
    relevance_weight: float = RELEVANCE_WEIGHT,
) -> DataFrame:
    """Hits per question: query_id, rank, page_content, metadata.

    `queries` has query_id and either `embedding` or, with an embedder, `text`;
    a `source_ids` column limits single questions, the argument limits all.
    Texts are not carried through scoring: the hits, at most `k` per question,
    are stored and then sent to the text column. Only when a question table is
    so large that its hits pass the broadcast bound are both joined by key.
    """
    if embedder is not None:
        queries = stage(embed_queries(queries, embedder, embed_model), "embedded-questions")
    scoped = scope_chunks(chunks, embed_model, source_ids)
    best = with_vectors(top_chunks(queries, scoped, fetch_k), scoped)
    hits = stage(rerank(best, k, relevance_weight), "hits")
    texts = scoped.select(*KEY, F.col("text").alias("page_content"))
    return texts.join(broadcast_if_small(hits), KEY).select(
        "query_id",
        "rank",
        "page_content",
        F.struct(*KEY, "score").alias("metadata"),
    )
