"""Paths, texts, chunks and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlpit.functions import paths, text as texts
from marlpit.operators.chunking import boundary_pieces, chunk_documents, fixed_chunks
from marlpit.operators.embedding import (
    HashEmbedder,
    RuleEmbedder,
    embed_chunks,
    embed_queries,
    hash_term_counts,
)
from marlpit.operators.reading import read_requests
from marlpit.operators.reports import chunk_batches
from marlpit.runtime import broadcast_if_small, spread
from marlpit.sources.tables import documents_from_table, select_documents
from queries import query, table
from queries.fixtures import (
    HASH_WEIGHTS_SQL,
    PATH_SQL,
    SPACES_SQL,
    doc_path,
    documents,
    windows_sql,
)

# Paths with folders: those of the pages' URLs, under a folder per page class.
_FOLDERS = ("docs", "node_modules", "src", "dist", "a-b")


def _page_paths(spark, folder):
    return table(spark, folder, "pages").select(
        F.concat_ws(
            "/",
            F.element_at(F.array(*map(F.lit, _FOLDERS)), (F.col("page_id") % 5 + 1).cast("int")),
            F.regexp_replace("url", "^https?://", ""),
        ).alias("path")
    )


_PAGE_PATHS_SQL = f"""
page_paths AS (
  SELECT list_extract([{", ".join(f"'{name}'" for name in _FOLDERS)}], page_id % 5 + 1)
         || '/' || regexp_replace(url, '^https?://', '') AS path FROM pages),
all_paths AS (SELECT path FROM page_paths UNION ALL SELECT {PATH_SQL} FROM documents)
"""


@query(
    rf"""WITH {_PAGE_PATHS_SQL}
    SELECT path, list_has_any(string_split(path, '/')[:-2],
        ['.git', 'node_modules', 'vendor', 'dist', '__pycache__', '.venv']) AS skipped
    FROM all_paths
    WHERE (regexp_full_match(path, '(?s).*/.*1.*\.md|.*/[0-9][0-9]..*|.*[a-f]t.*\.com/.*')
           OR regexp_full_match(path, '(?s)[^s].*/[^e-z][a-z]/.*'))
      AND NOT regexp_full_match(path, '(?s).*#top|docs/.*\?.*')"""
)
def glob_filter(spark, folder):
    path = F.col("path")
    listed = _page_paths(spark, folder).unionByName(
        table(spark, folder, "documents").select(doc_path().alias("path"))
    )
    include = ["*/*1*.md", "*/[0-9][0-9]?*", "*[a-f]t*.com/*", "[!s]*/[!e-z][a-z]/*"]
    exclude = ["*#top", "docs/*[?]*"]
    return listed.where(paths.selected(path, include, exclude)).select(
        "path", paths.in_skipped_folder(path).alias("skipped")
    )


@query(
    rf"""SELECT source AS source_id, {PATH_SQL} AS path FROM documents
    WHERE CASE lang WHEN 'en' THEN doc_id::VARCHAR LIKE '%7%'
                    WHEN 'fr' THEN NOT (doc_id::VARCHAR LIKE '%0') ELSE true END"""
)
def registry_globs(spark, folder):
    """Globs per source from a registry table; here the languages are the sources."""
    listed = table(spark, folder, "documents").select(
        F.col("lang").alias("source_id"), "source", doc_path().alias("path")
    )
    registry = listed.select("source_id").distinct().select(
        "source_id",
        F.when(F.col("source_id") == "en", F.array(F.lit("**/en/*7*.md"), F.lit("none")))
        .otherwise(F.array(F.lit("**/*.md")))
        .alias("include"),
        F.when(F.col("source_id") == "fr", F.array(F.lit("fr/*0.md")))
        .otherwise(F.array().cast("array<string>"))
        .alias("exclude"),
    )
    selected = select_documents(listed, broadcast_if_small(registry))
    return selected.select(F.col("source").alias("source_id"), "path")


@query(
    f"""SELECT {PATH_SQL} AS path, sha256(text) AS content_hash FROM documents
    UNION ALL SELECT url || page_id, sha256(html) FROM pages"""
)
def content_hash(spark, folder):
    pages = documents_from_table(
        table(spark, folder, "pages"), F.lit("pages"), F.concat("url", "page_id"), F.col("html")
    )
    return documents(spark, folder).unionByName(pages).select(
        "path", texts.content_hash(F.col("content")).alias("content_hash")
    )


@query(
    f"""SELECT {PATH_SQL} AS path, lang <> 'fr' AS decodable,
      CASE WHEN lang <> 'fr' THEN length(text) ELSE -1 END AS n_chars FROM documents"""
)
def undecodable_files(spark, folder):
    """French documents get bytes that no UTF-8 text has."""
    broken = F.concat(F.col("content"), F.unhex(F.lit("FFFE00")), F.col("content"))
    french = F.col("path").startswith("fr/")
    content = F.when(french, broken).otherwise(F.col("content"))
    text = texts.decoded(content)
    return documents(spark, folder).select(
        "path", text.isNotNull().alias("decodable"), F.coalesce(F.char_length(text), F.lit(-1)).cast("long").alias("n_chars"),
    )


_NAMES = (
    "a/{}.MD", "{}.mdx", "b.d/README.{}", "readme-{}.py", "x/{}.py", "{}.JSX", "y.ts/{}",
    "{}.tsx", "{}.go", "{}.Java", "q/{}.rs", ".py", "{}.", "x/.{}.js", "{}.tar.gz", "..rs",
)


@query(
    f"""WITH named AS (
      SELECT doc_id, replace(list_extract([{", ".join(f"'{n}'" for n in _NAMES)}],
                             doc_id % {len(_NAMES)} + 1), '{{}}', doc_id::VARCHAR) AS path
      FROM documents),
    split AS (
      SELECT *, lower(list_extract(string_split(path, '/'), -1)) AS name FROM named),
    suffixed AS (
      SELECT *, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS suffix FROM split)
    SELECT path, CASE
      WHEN suffix IN ('.md', '.mdx', '.markdown') OR starts_with(name, 'readme') THEN 'markdown'
      WHEN suffix = '.py' THEN 'python' WHEN suffix IN ('.js', '.jsx') THEN 'js'
      WHEN suffix IN ('.ts', '.tsx') THEN 'ts' WHEN suffix = '.go' THEN 'go'
      WHEN suffix = '.java' THEN 'java' WHEN suffix = '.rs' THEN 'rust' END AS language
    FROM suffixed"""
)
def language_class(spark, folder):
    names = F.array(*map(F.lit, _NAMES))
    name = F.element_at(names, (F.col("doc_id") % len(_NAMES) + 1).cast("int"))
    path = F.replace(name, F.lit("{}"), F.col("doc_id").cast("string"))
    return table(spark, folder, "documents").select(path.alias("path")).select(
        "path", paths.language_class(F.col("path")).alias("language")
    )


@query(
    """WITH sized AS (
      SELECT doc_id, lang, CASE WHEN n_chars % 3 > 0 THEN (n_chars % 300 + 1)::INTEGER END AS tokens
      FROM documents),
    based AS (
      SELECT *, CASE WHEN tokens IS NULL THEN 500 ELSE greatest(tokens * 4, 32) END AS base
      FROM sized),
    chosen AS (
      SELECT *, CASE WHEN lang = 'en' THEN base ELSE least(base, 400) END AS size FROM based)
    SELECT doc_id, size::INTEGER AS size,
      least(greatest(size // 10, 0), size - 1)::INTEGER AS overlap FROM chosen"""
)
def chunk_policy(spark, folder):
    """English documents count as markdown, the others as Python or unknown."""
    tokens = F.when(F.col("n_chars") % 3 > 0, (F.col("n_chars") % 300 + 1).cast("int"))
    language = F.when(F.col("lang") == "en", "markdown").when(F.col("lang") == "fr", "python")
    size = texts.chunk_chars(language, texts.base_chars(tokens))
    return table(spark, folder, "documents").select(
        "doc_id", size.alias("size"), texts.chunk_overlap(size).alias("overlap")
    )


@query(
    rf"""WITH told AS (
      SELECT 'd' || doc_id AS id, 'fatal: https://user' || doc_id || ':t0k@host/' || text ||
             ' git://' || source || ':x@y' AS text FROM documents
      UNION ALL SELECT 'p' || page_id, url || ' ' || html FROM pages)
    SELECT id, regexp_replace(text, '//[^/:{SPACES_SQL}]+:[^/@{SPACES_SQL}]+@', '//***@', 'g')
      AS text FROM told"""
)
def redact_credentials(spark, folder):
    told = table(spark, folder, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.concat(
            F.lit("fatal: https://user"), "doc_id", F.lit(":t0k@host/"), "text",
            F.lit(" git://"), "source", F.lit(":x@y"),
        ).alias("text"),
    )
    pages = table(spark, folder, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("id"), F.concat_ws(" ", "url", "html").alias("text")
    )
    return told.unionByName(pages).select(
        "id", texts.redact_credentials(F.col("text")).alias("text")
    )


_MODELS = ("nomic-embed-text", "qwen3-embedding:0.6b", "multilingual-e5-large", "minilm")
_QWEN_SQL = (
    "'Instruct: Given a web search query, retrieve relevant passages that answer the query'"
    " || chr(10) || 'Query: '"
)


@query(
    f"""WITH asked AS (
      SELECT doc_id, list_extract([{", ".join(f"'{m}'" for m in _MODELS)}], doc_id % 4 + 1) AS model,
        CASE WHEN lang = 'en' THEN 'search_query: ' || text
             WHEN lang = 'fr' THEN 'passage: ' || text ELSE text END AS text
      FROM documents),
    prefixed AS (
      SELECT *, CASE WHEN model LIKE '%nomic-embed%' THEN 'search_document: '
                     WHEN model LIKE '%e5%' THEN 'passage: ' ELSE '' END AS d,
                CASE WHEN model LIKE '%nomic-embed%' THEN 'search_query: '
                     WHEN model LIKE '%qwen3-embedding%' THEN {_QWEN_SQL}
                     WHEN model LIKE '%e5%' THEN 'query: ' ELSE '' END AS q
      FROM asked)
    SELECT doc_id, model,
      CASE WHEN starts_with(text, d) THEN text ELSE d || text END AS as_document,
      CASE WHEN starts_with(text, q) THEN text ELSE q || text END AS as_question
    FROM prefixed"""
)
def model_prefix(spark, folder):
    models = F.array(*map(F.lit, _MODELS))
    asked = table(spark, folder, "documents").select(
        "doc_id",
        F.element_at(models, (F.col("doc_id") % 4 + 1).cast("int")).alias("model"),
        F.when(F.col("lang") == "en", F.concat(F.lit("search_query: "), "text"))
        .when(F.col("lang") == "fr", F.concat(F.lit("passage: "), "text"))
        .otherwise(F.col("text"))
        .alias("text"),
    )
    text, model = F.col("text"), F.col("model")
    return asked.select(
        "doc_id",
        "model",
        texts.with_prefix(text, texts.document_prefix(model)).alias("as_document"),
        texts.with_prefix(text, texts.query_prefix(model)).alias("as_question"),
    )


@query(windows_sql("documents", "doc_id"))
def fixed_windows(spark, folder):
    return fixed_chunks(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "text", F.col("chunk_index").cast("long").alias("chunk_index")
    )


_REQUESTS = ("p.md", "/p.md", "\\p.md", "../p.md", "a/../p.md", "a..p.md", "")


@query(
    rf"""WITH requests AS (
      SELECT doc_id AS request_id,
        CASE WHEN lang = 'fr' AND doc_id % 10 = 3 THEN 'nowhere' ELSE source END AS source_id,
        CASE WHEN doc_id % 3 > 0 THEN {PATH_SQL}
             ELSE list_extract([{", ".join(f"'{r}'" for r in _REQUESTS)}],
                               (doc_id // 3) % {len(_REQUESTS)} + 1) END AS path,
        CASE WHEN doc_id % 10 > 0 THEN (doc_id % 4)::INTEGER END AS start_line,
        CASE WHEN doc_id % 10 > 1 THEN (doc_id % 6)::INTEGER END AS end_line
      FROM documents),
    judged AS (
      SELECT *, CASE
        WHEN source_id = 'nowhere' THEN 'unknown_source'
        WHEN path = '' OR left(path, 1) IN ('/', '\')
          OR list_contains(string_split(path, '/'), '..') THEN 'unsafe_path' END AS refused
      FROM requests),
    docs AS (
      SELECT source AS source_id, {PATH_SQL} AS path, text,
        string_split_regex(regexp_replace(text, '\n$', ''), '[\n\x{{85}}\x{{2028}}]') AS lines
      FROM documents)
    SELECT request_id, source_id, path,
      CASE WHEN refused IS NULL AND text IS NOT NULL THEN
        CASE WHEN start_line IS NULL AND end_line IS NULL THEN text
        ELSE array_to_string(list_slice(lines, greatest(coalesce(start_line, 1), 1),
          CASE WHEN end_line IS NULL THEN len(lines)
          ELSE greatest(end_line, greatest(coalesce(start_line, 1), 1)) END), chr(10)) END END
      AS text,
      coalesce(refused, CASE WHEN text IS NULL THEN 'missing_document' END) AS error
    FROM judged LEFT JOIN docs USING (source_id, path)"""
)
def read_lines(spark, folder):
    table_ = table(spark, folder, "documents")
    number = F.col("doc_id")
    odd = F.element_at(
        F.array(*map(F.lit, _REQUESTS)),
        (F.floor(number / 3) % len(_REQUESTS) + 1).cast("int"),
    )
    requests = table_.select(
        number.alias("request_id"),
        F.when((F.col("lang") == "fr") & (number % 10 == 3), "nowhere")
        .otherwise(F.col("source"))
        .alias("source_id"),
        F.when(number % 3 > 0, doc_path()).otherwise(odd).alias("path"),
        F.when(number % 10 > 0, (number % 4).cast("int")).alias("start_line"),
        F.when(number % 10 > 1, (number % 6).cast("int")).alias("end_line"),
    )
    registry = table_.select(F.col("source").alias("source_id")).distinct()
    return read_requests(requests, registry, documents(spark, folder))


@query(
    """WITH texts AS (
      SELECT 'd' || doc_id AS id, text, true AS stored FROM documents
      UNION ALL SELECT 'q' || item_id, text, false FROM benchmark),
    ruled AS (
      SELECT id, stored, CASE WHEN contains(text, 'the') THEN [0.6, 0.8]
        WHEN contains(text, 'que') THEN [-0.8, 0.6] ELSE [0.3, 0.1] END::DOUBLE[] AS v FROM texts)
    SELECT id, CASE WHEN stored THEN v[1]::FLOAT::DOUBLE ELSE v[1] END AS x,
      CASE WHEN stored THEN v[2]::FLOAT::DOUBLE ELSE v[2] END AS y FROM ruled"""
)
def rule_embed(spark, folder):
    """Documents rounded to float, questions kept in double precision."""
    embedder = RuleEmbedder({"the": [0.6, 0.8], "que": [-0.8, 0.6]}, [0.3, 0.1])
    chunks = table(spark, folder, "documents").select(
        F.col("source").alias("source_id"), F.concat(F.lit("d"), "doc_id").alias("path"), "text"
    )
    questions = table(spark, folder, "benchmark").select(
        F.concat(F.lit("q"), "item_id").alias("query_id"), "text"
    )
    component = lambda i: F.col("embedding")[i].cast("double")
    stored = embed_chunks(chunks, embedder, "rules").select(
        F.col("path").alias("id"), component(0).alias("x"), component(1).alias("y")
    )
    asked = embed_queries(questions, embedder, "rules").select(
        F.col("query_id").alias("id"), component(0).alias("x"), component(1).alias("y")
    )
    return stored.unionByName(asked)


@query(
    f"""WITH texts AS (SELECT doc_id AS id, text FROM documents), {HASH_WEIGHTS_SQL}
    SELECT id AS doc_id, bucket, n, round(weight, 9) AS weight FROM weights"""
)
def hash_embed(spark, folder):
    return hash_term_counts(
        table(spark, folder, "documents").select("doc_id", "text"), "doc_id"
    ).withColumn("weight", F.round("weight", 9))


@query(
    f"""WITH texts AS (SELECT doc_id AS id, text FROM documents), {HASH_WEIGHTS_SQL}
    SELECT id AS doc_id, bucket, round(weight::FLOAT::DOUBLE, 9) AS weight FROM weights"""
)
def callable_embed(spark, folder):
    """The same vectors from a Python callable, in Arrow batches."""
    rows = table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("source_id"), doc_path().alias("path"), "text"
    )
    vectors = embed_chunks(rows, HashEmbedder(64), "hash")
    return (
        vectors.select("doc_id", F.posexplode_outer("embedding").alias("bucket", "weight"))
        .where("weight > 0")
        .select(
            "doc_id",
            F.col("bucket").cast("long").alias("bucket"),
            F.round(F.col("weight").cast("double"), 9).alias("weight"),
        )
    )


@query()
def boundary_chunk_rows(spark, folder):
    rows = table(spark, folder, "documents").select(doc_path().alias("path"), "doc_id", "text")
    return chunk_batches(chunk_documents(rows))


@query(
    f"""SELECT doc_id, true AS some, true AS short, true AS in_order, true AS covered, true AS little_twice
      FROM documents WHERE regexp_matches(text, '[^{SPACES_SQL}]')"""
)
def boundary_chunks(spark, folder):
    """What must hold of a document's chunks, overlaps included.

    There is one; none is longer than allowed; each stands in the text, from the start
    of the one before on; together they hold every non-blank character, and no more of
    them twice than the overlaps allow.
    """
    rows = table(spark, folder, "documents").select("doc_id", "text", doc_path().alias("path"))
    language = paths.language_class(F.col("path"))
    size = texts.chunk_chars(language, texts.base_chars(F.lit(None).cast("int")))
    rows = rows.withColumn("size", size).withColumn("overlap", texts.chunk_overlap(F.col("size")))
    cut = spread(rows).withColumn("pieces", boundary_pieces("text", language, "size", "overlap")).where(F.size("pieces") > 0)
    solid = lambda column: F.char_length(F.regexp_replace(column, f"[{texts.SPACE_CLASS}]+", ""))
    # The place of each piece, from that of the one before on; -1 once a piece is not found.
    place = F.expr("aggregate(pieces, 1, (at, piece) -> CASE WHEN at < 1 THEN -1 ELSE coalesce(nullif(locate(piece, text, at), 0), -1) END)")
    held = F.aggregate(F.transform("pieces", solid), F.lit(0), lambda total, n: total + n)
    facts = cut.select(
        "doc_id", "overlap", "size", F.size("pieces").alias("n"), F.array_max(F.transform("pieces", F.char_length)).alias("longest"),
        place.alias("place"), held.alias("held"), solid(F.col("text")).alias("whole"),
    )
    return facts.select(
        "doc_id",
        (F.col("n") > 0).alias("some"),
        (F.col("longest") <= F.col("size")).alias("short"),
        (F.col("place") > 0).alias("in_order"),
        (F.col("held") >= F.col("whole")).alias("covered"),
        (F.col("held") <= F.col("whole") + (F.col("n") - 1) * F.col("overlap")).alias("little_twice"),
    )


@query(
    f"""SELECT doc_id, 0::BIGINT AS oversized, md5(regexp_replace(text, '[{SPACES_SQL}]', '', 'g'))
      AS squeezed FROM documents WHERE regexp_matches(text, '[^{SPACES_SQL}]')"""
)
def boundary_chunks_lossless(spark, folder):
    """Without overlap the chunks hold every non-blank character once, in order."""
    pieces = boundary_pieces(
        F.col("text"), paths.language_class(doc_path()), F.lit(300), F.lit(0)
    )
    joined = F.array_join("pieces", "")
    return (
        table(spark, folder, "documents")
        .select("doc_id", pieces.alias("pieces"))
        .where(F.size("pieces") > 0)
        .select(
            "doc_id",
            F.size(F.filter("pieces", lambda p: F.char_length(p) > 300))
            .cast("long")
            .alias("oversized"),
            F.md5(
                F.regexp_replace(joined, f"[{texts.SPACE_CLASS}]", "").cast("binary")
            ).alias("squeezed"),
        )
    )
