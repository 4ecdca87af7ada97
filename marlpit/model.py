"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(*fields: tuple) -> T.StructType:
    schema = T.StructType()
    for name, kind, *nullable in fields:
        schema.add(name, kind, bool(nullable and nullable[0]))
    return schema


STRINGS = T.ArrayType(T.StringType(), False)

REGISTRY = _table(
    ("ordinal", T.IntegerType()),
    ("source_id", T.StringType()),
    ("kind", T.StringType()),
    ("path", T.StringType(), True),
    ("url", T.StringType(), True),
    ("branch", T.StringType(), True),
    ("include", STRINGS),
    ("exclude", STRINGS),
)

# `error` carries a read failure; content is null then.
DOCUMENTS = _table(
    ("source_id", T.StringType()),
    ("path", T.StringType()),
    ("content", T.BinaryType(), True),
    ("error", T.StringType(), True),
)

FILES = _table(
    ("source_id", T.StringType()),
    ("path", T.StringType()),
    ("content_hash", T.StringType()),
    ("embed_model", T.StringType()),
    ("embed_dim", T.IntegerType()),
    ("commit_sha", T.StringType(), True),
)

CHUNKS = _table(
    ("source_id", T.StringType()),
    ("path", T.StringType()),
    ("chunk_index", T.IntegerType()),
    ("text", T.StringType()),
    ("embedding", T.ArrayType(T.FloatType(), False)),
    ("embed_model", T.StringType()),
)

SOURCE_STATUS = _table(
    ("id", T.StringType()),
    ("kind", T.StringType()),
    ("last_crawl_at", T.TimestampType(), True),
    ("last_commit", T.StringType(), True),
    ("last_error", T.StringType(), True),
    ("chunk_count", T.LongType()),
)

READ_REQUESTS = _table(
    ("request_id", T.LongType()),
    ("source_id", T.StringType()),
    ("path", T.StringType()),
    ("start_line", T.IntegerType(), True),
    ("end_line", T.IntegerType(), True),
)

SOURCE_ERRORS = _table(("source_id", T.StringType()), ("error", T.StringType()))
COMMITS = _table(("source_id", T.StringType()), ("commit_sha", T.StringType()))
