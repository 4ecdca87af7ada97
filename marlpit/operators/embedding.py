"""Texts to vectors with a pluggable embedder.

An embedder is either a callable `list[str] -> list[list[float]]`, run in
Arrow batches on the executors, or a `ColumnEmbedder`, which stays in the JVM.
A callable that needs a heavy model should load it on first use and keep it in
its module, so that a reused Python worker loads it once.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marlpit.functions.text import document_prefix, query_prefix, with_prefix
from marlpit.runtime import spread

BATCH_SIZE = 16  # Fixed value: texts per call.

Embedder = Callable[[list[str]], list[list[float]]]

_RESULT = "embedding array<double>, error string"


class ColumnEmbedder:
    """Base of embedders that can be written as a Column of a Column."""

    def column(self, text: Column) -> Column:
        raise NotImplementedError


class RuleEmbedder(ColumnEmbedder):
    """The vector of the first term that occurs in a text, else a vector for the rest.

    `vectors` maps terms to vectors, in order of precedence.
    """

    def __init__(self, vectors: dict[str, list[float]], rest: list[float]):
        self.vectors = vectors
        self.rest = rest

    def column(self, text: Column) -> Column:
        chosen = F.array(*map(F.lit, self.rest))
        for term, vector in reversed(self.vectors.items()):
            chosen = F.when(text.contains(term), F.array(*map(F.lit, vector))).otherwise(chosen)
        return chosen


class HashEmbedder:
    """Feature hashing: term counts in md5 buckets, at length 1."""

    KNOWN_TERMS = 1 << 16

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self._vector(text) for text in texts]

    def _vector(self, text: str) -> list[float]:
        counts = [0] * self.dim
        for term, times in Counter(re.split(r"[ \t\n\r\f\v]+", text.lower())).items():
            if term:
                counts[self._bucket(term)] += times
        length = math.sqrt(sum(count * count for count in counts))
        return [count / length if length else 0.0 for count in counts]

    def _bucket(self, term: str) -> int:
        bucket = self._known.get(term)
        if bucket is None:
            if len(self._known) >= self.KNOWN_TERMS:
                self._known.clear()
            digest = hashlib.md5(term.encode()).digest()
            bucket = self._known[term] = int.from_bytes(digest[:4], "big") % self.dim
        return bucket


def embed_chunks(
    chunks: DataFrame,
    embedder: Embedder | ColumnEmbedder,
    model: str,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add `embed_model`, `embedding` (stored as float) and `error`.

    The prefix the model expects is given to the embedder only, never stored.
    A failing call leaves its file's rows with an error and an empty vector.
    """
    prepared = with_prefix(F.col("text"), document_prefix(F.lit(model)))
    result = _embedded(prepared, F.xxhash64("source_id", "path"), embedder, batch_size)
    empty = F.array().cast("array<float>")
    return (
        spread(chunks).withColumn("_result", result)
        .withColumn("embed_model", F.lit(model))
        .withColumn(
            "embedding",
            F.coalesce(F.col("_result.embedding").cast("array<float>"), empty),
        )
        .withColumn("error", F.col("_result.error"))
        .drop("_result")
    )


def embed_queries(
    queries: DataFrame,
    embedder: Embedder | ColumnEmbedder,
    model: str,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add `embedding` to questions, kept in double precision; a failure is an error."""
    prepared = with_prefix(F.col("text"), query_prefix(F.lit(model)))
    result = _embedded(prepared, F.xxhash64("query_id"), embedder, batch_size)
    checked = F.when(
        F.col("_result.error").isNotNull(), F.raise_error(F.col("_result.error"))
    ).otherwise(F.col("_result.embedding"))
    return (
        queries.withColumn("_result", result).withColumn("embedding", checked).drop("_result")
    )


def _embedded(
    prepared: Column, owner: Column, embedder: Embedder | ColumnEmbedder, batch_size: int
) -> Column:
    if isinstance(embedder, ColumnEmbedder):
        return F.struct(
            embedder.column(prepared).cast("array<double>").alias("embedding"),
            F.lit(None).cast("string").alias("error"),
        )

    @F.arrow_udf(_RESULT)
    def embed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, owners in batches:
            yield _embed_batch(embedder, texts.to_pylist(), owners.to_pylist(), batch_size)

    return embed(prepared, owner)


def _embed_batch(
    embedder: Embedder, texts: list[str], owners: list[int], batch_size: int
) -> pa.StructArray:
    """Vectors as one list column over one flat buffer, and errors."""
    flat: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    errors: list[str | None] = []

    def take(batch: list[str]) -> str | None:
        values, lengths, error = _try(embedder, batch)
        if error is None:
            flat.append(values)
            sizes.append(lengths)
        return error

    for start in range(0, len(texts), batch_size):
        batch = texts[start : start + batch_size]
        if take(batch) is None:
            errors += [None] * len(batch)
            continue
        # Ask again owner by owner, so that only the failing ones carry the error.
        members = owners[start : start + batch_size]
        at = 0
        while at < len(batch):
            stop = at + 1
            while stop < len(batch) and members[stop] == members[at]:
                stop += 1
            error = take(batch[at:stop])
            if error is not None:
                sizes.append(np.zeros(stop - at, np.int64))
            errors += [error] * (stop - at)
            at = stop
    values = np.concatenate(flat or [np.zeros(0)])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)]))])
    reasons = pa.array(errors, pa.string())
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=reasons.is_valid())
    return pa.StructArray.from_arrays([lists, reasons], names=["embedding", "error"])


def _try(embedder: Embedder, batch: list[str]) -> tuple[np.ndarray | None, np.ndarray | None, str | None]:
    """All numbers of a call's vectors, the size of each vector, and the error if there is one."""
    try:
        vectors = embedder(batch)
        lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
        if isinstance(vectors, np.ndarray):
            values = vectors.astype(np.float64).ravel()
        else:
            values = np.fromiter(chain.from_iterable(vectors), np.float64, int(lengths.sum()))
    except Exception as problem:  # noqa: BLE001 - becomes the error of the rows
        return None, None, str(problem) or type(problem).__name__
    if len(lengths) != len(batch):
        return None, None, f"the embedder returned {len(lengths)} vectors for {len(batch)} texts"
    return values, lengths, None


def hash_term_counts(texts: DataFrame, key: str, dim: int = 64) -> DataFrame:
    """Feature hashing of a whole text column in the JVM, in sparse form.

    Rows `(key, bucket, n, weight)`; weights of one key have length 1. All
    terms of a text sit in one row, so the partial count already folds them
    before the shuffle; the window sees at most `dim` rows per key.
    """
    terms = F.filter(F.split(F.lower("text"), r"[ \t\n\r\f\x0b]+"), lambda term: term != "")
    bucket = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 8), 16, 10).cast("long")
    counts = (
        spread(texts).select(key, F.explode(terms).alias("term"))
        .groupBy(key, (bucket % dim).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy(key)))
    return counts.withColumn("weight", F.col("n") / length)
