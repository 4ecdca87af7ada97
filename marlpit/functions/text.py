"""Columns over document text: decoding, hashing, sizes, redaction, lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marlpit.functions.vectors import let

# Chunk sizes in characters.
BASE_CHARS = 500
CODE_CHARS = 400
MIN_CONTEXT_CHARS = 32
CHARS_PER_TOKEN = 4

# Prefixes some embedding models expect.
NOMIC_DOCUMENT = "search_document: "
NOMIC_QUERY = "search_query: "
QWEN_QUERY = (
    "Instruct: Given a web search query, retrieve relevant passages that answer the query\n"
    "Query: "
)
E5_DOCUMENT = "passage: "
E5_QUERY = "query: "

# The characters Python's str.strip() and \s treat as white space.
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The characters at which Python's str.splitlines() breaks, after \r is gone.
LINE_BREAKS = r"[\n\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"

# Fixed value: user and password in a URL.
_CREDENTIALS = rf"//[^/{SPACE_CLASS}:]+:[^/{SPACE_CLASS}@]+@"


def decoded(content: Column) -> Column:
    """Text of a UTF-8 payload; null when it is not valid UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(f"[^{SPACE_CLASS}]"))


def base_chars(context_tokens: Column) -> Column:
    """Chunk size by model context; null context gives the default."""
    return F.when(context_tokens.isNull(), F.lit(BASE_CHARS)).otherwise(
        F.greatest(context_tokens * CHARS_PER_TOKEN, F.lit(MIN_CONTEXT_CHARS))
    )


def chunk_chars(language: Column, base: Column) -> Column:
    return F.when(language == "markdown", base).otherwise(
        F.least(base, F.lit(CODE_CHARS))
    )


def chunk_overlap(size: Column) -> Column:
    tenth = F.floor(size / 10).cast("int")
    return F.least(F.greatest(tenth, F.lit(0)), size - 1)


def redact_credentials(text: Column) -> Column:
    return F.regexp_replace(text, _CREDENTIALS, "//***@")


def document_prefix(model: Column) -> Column:
    return (
        F.when(model.contains("nomic-embed"), F.lit(NOMIC_DOCUMENT))
        .when(model.contains("e5"), F.lit(E5_DOCUMENT))
        .otherwise(F.lit(""))
    )


def query_prefix(model: Column) -> Column:
    return (
        F.when(model.contains("nomic-embed"), F.lit(NOMIC_QUERY))
        .when(model.contains("qwen3-embedding"), F.lit(QWEN_QUERY))
        .when(model.contains("e5"), F.lit(E5_QUERY))
        .otherwise(F.lit(""))
    )


def with_prefix(text: Column, prefix: Column) -> Column:
    """Prefix the text unless it already starts so; an empty prefix is a no-op."""
    return F.when(F.startswith(text, prefix), text).otherwise(F.concat(prefix, text))


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines `start..end`, inclusive and 1-based; both null gives the whole text."""

    def of_lines(lines: Column) -> Column:
        ends_in_break = F.element_at(lines, -1) == ""
        count = F.size(lines) - ends_in_break.cast("int")
        first = F.greatest(F.coalesce(start, F.lit(1)), F.lit(1))
        last = F.least(F.greatest(F.coalesce(end, count), first), count)
        length = F.greatest(F.when(end.isNull(), count).otherwise(last) - first + 1, F.lit(0))
        return F.array_join(F.slice(lines, first, length), "\n")

    def of_text(translated: Column) -> Column:
        return F.when(start.isNull() & end.isNull(), translated).otherwise(
            let(F.split(translated, LINE_BREAKS, -1), of_lines)
        )

    return let(F.regexp_replace(text, r"\r\n?", "\n"), of_text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z", "")
