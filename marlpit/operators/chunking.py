"""Documents to chunks: boundary-aware pieces and fixed windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from marlpit.functions.paths import language_class
from marlpit.functions.text import base_chars, chunk_chars, chunk_overlap, is_blank
from marlpit.functions.vectors import let
from marlpit.runtime import spread

# Bytes of pieces, and documents, after which a task hands them on.
PIECE_BYTES = 4 << 20
PIECE_ROWS = 1 << 10

# Where a text may be cut, coarsest first. A cut is made before a match; a match of
# the group `whole` is stepped over instead, so nothing is cut inside it. Repeats are
# bounded or end where the next match can begin, so that no text takes more than
# linear time.
_PROSE = (r"\n[ \t]*(?=\n)", r"\n", r"[ \t]")
_DOC_COMMENT = r"(?:[ \t]*/\*\*(?:[^*/]|\*(?!/)|/(?!\*\*))*\*/[ \t]*\n)?"


def _lines(opening: str, most: int = 40) -> str:
    """Up to `most` lines that belong to the declaration below them."""
    return rf"(?:[ \t]*{opening}[^\n]*\n){{0,{most}}}"


def _declared(kinds: str, modifiers: str = "", lead: str = "", indent: str = "") -> str:
    """A declaration on a new line: lines that belong to it, modifiers in any order, its kind."""
    before = rf"(?:(?:{modifiers})[ \t]+){{0,9}}" if modifiers else ""
    return rf"\n{lead}{indent}{before}(?:{kinds})"


_INDENTED = r"[ \t]+"
_FENCE = r"(?P<whole>\n[ \t]{0,3}(?:```|~~~)[\s\S]*?\n[ \t]{0,3}(?:```|~~~)[^\n]*)"
_JS_WORDS = "export|default|async|abstract|declare"
_JS_NAMED = r"const\b|let\b|var\b"
_JAVA_WORDS = "public|protected|private|abstract|final|static|sealed|non-sealed|strictfp|default|synchronized|native"
_JAVA_LEAD = _DOC_COMMENT + _lines("@(?!interface)")
_RUST_WORDS = r"pub(?:\([^)\n]{0,80}\))?|async|unsafe|const|default|extern(?:[ \t]+\"[^\"\n]{0,20}\")?"
_RUST_LEAD = _lines(r"(?:///|#\[)")
_BOUNDARIES = {
    "markdown": (
        rf"{_FENCE}|\n#{{1,6}}[ \t]|\n[^\n]+\n(?:=+|-+)[ \t]*(?=\n)",
        rf"{_FENCE}|\n[ \t]{{0,3}}(?:(?:\*[ \t]*){{3,}}|(?:-[ \t]*){{3,}}|(?:_[ \t]*){{3,}})(?=\n)",
        rf"{_FENCE}|{_PROSE[0]}",
        r"\n(?=[ \t]{0,3}(?:```|~~~))",
        *_PROSE,
    ),
    "python": (
        _declared(r"class\b|def\b|async[ \t]+def\b", lead=r"(?:@[^\n]*\n(?:[ \t)\]}][^\n]*\n){0,9}){0,9}"),
        _declared(r"class\b|def\b|async[ \t]+def\b", lead=_lines("@"), indent=_INDENTED),
        *_PROSE,
    ),
    "js": (
        _declared(r"class\b|function\b", _JS_WORDS, _DOC_COMMENT),
        _declared(_JS_NAMED, _JS_WORDS, _DOC_COMMENT),
        *_PROSE,
    ),
    "ts": (
        _declared(
            r"class\b|function\b|interface\b|type\b|enum\b|const[ \t]+enum\b|namespace\b|module\b",
            _JS_WORDS, _DOC_COMMENT + _lines("@"),
        ),
        _declared(_JS_NAMED, _JS_WORDS, _DOC_COMMENT),
        *_PROSE,
    ),
    "go": (
        _declared(r"func\b|type\b", lead=_lines("//")),
        _declared(r"import\b|const\b|var\b", lead=_lines("//")),
        *_PROSE,
    ),
    "java": (
        _declared(r"class\b|interface\b|enum\b|record\b|@interface\b", _JAVA_WORDS, _JAVA_LEAD),
        _declared(rf"(?:{_JAVA_WORDS})[ \t]", lead=_JAVA_LEAD, indent=_INDENTED),
        *_PROSE,
    ),
    "rust": (
        _declared(r"fn\b|struct\b|enum\b|union\b|trait\b|impl\b|mod\b|macro_rules!", _RUST_WORDS, _RUST_LEAD),
        _declared(r"fn\b", _RUST_WORDS, _RUST_LEAD, _INDENTED),
        _declared(r"use\b|type\b|const\b|static\b", _RUST_WORDS, _RUST_LEAD),
        *_PROSE,
    ),
}
_COMPILED = {
    language: tuple(re.compile(rule) for rule in rules)
    for language, rules in {**_BOUNDARIES, None: _PROSE}.items()
}


def chunk_documents(documents: DataFrame, context_tokens: int | None = None) -> DataFrame:
    """One row per chunk of `text`, at most the size its language allows.

    Every other column of `documents` is kept; `chunk_index` numbers the
    non-blank chunks of a document from 0 and `n_chunks` is their number.
    """
    kept = [name for name in documents.columns if name != "text"]
    size = chunk_chars(F.col("_language"), base_chars(F.lit(context_tokens).cast("int")))
    return (
        spread(documents).withColumn("_language", language_class(F.col("path")))
        .withColumn("_size", size)
        .withColumn(
            "_pieces",
            boundary_pieces("text", "_language", "_size", chunk_overlap(F.col("_size"))),
        )
        .select(
            *kept,
            F.size("_pieces").alias("n_chunks"),
            F.posexplode_outer("_pieces").alias("chunk_index", "text"),
        )
        .where("text is not null")
    )


@F.arrow_udf(T.ArrayType(T.StringType()))
def boundary_pieces(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Pieces of (text, language, size, overlap).

    Only the texts being cut are Python strings, and what is cut goes out after every
    `PIECE_BYTES`, so that a task holds little besides Spark's batch, whatever its rows.
    """
    for columns in batches:
        pieces, counts, held = [], [], 0
        for row in zip(*columns):
            own = list(_pieces(*(value.as_py() for value in row)))
            pieces.append(pa.array(own, pa.string()))
            counts.append(len(own))
            held += pieces[-1].nbytes
            if held >= PIECE_BYTES or len(counts) >= PIECE_ROWS:
                yield _lists(pieces, counts)
                pieces, counts, held = [], [], 0
        if counts or not len(columns[0]):
            yield _lists(pieces, counts)


def _lists(values: list[pa.Array], counts: list[int]) -> pa.Array:
    offsets = pa.array([0, *accumulate(counts)], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.concat_arrays([pa.array([], pa.string()), *values]))


def _pieces(text: str, language: str | None, size: int, overlap: int) -> Iterator[str]:
    rules = _COMPILED[language if isinstance(language, str) else None]
    for start, end in _spans(text, 0, len(text), rules, size, overlap):
        piece = text[start:end].strip()
        if piece:
            yield piece


def _spans(text, start, end, rules, size, overlap) -> Iterator[tuple[int, int]]:
    """Chunk borders of `text[start:end]`, cut by the first rule that occurs in it."""
    for level, rule in enumerate(rules):
        cuts = [match.start() for match in rule.finditer(text, start, end) if match.lastgroup != "whole"]
        if cuts:
            break
    else:
        yield from _windows(start, end, size, overlap)
        return
    borders = [start, *(cut for cut in cuts if cut > start), end]
    packed = [start]
    for left, right in zip(borders, borders[1:]):
        if right - left < size:
            packed.append(right)
            continue
        yield from _packed(packed, size, overlap)
        yield from _spans(text, left, right, rules[level + 1 :], size, overlap)
        packed = [right]
    yield from _packed(packed, size, overlap)


def _packed(borders: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Join neighbouring pieces up to `size`; the next chunk repeats at most `overlap`."""
    first = 0
    for last in range(1, len(borders)):
        if borders[last] - borders[first] > size and last - 1 > first:
            yield borders[first], borders[last - 1]
            while first < last - 1 and (
                borders[last - 1] - borders[first] > overlap
                or borders[last] - borders[first] > size
            ):
                first += 1
    if len(borders) > 1:
        yield borders[first], borders[-1]


def _windows(start: int, end: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    while end - start > size:
        yield start, start + size
        start += size - overlap
    if end > start:
        yield start, end


def fixed_chunks(documents: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of `size` characters, each `size - overlap` after the one before.

    The text is cut into steps in one pass, and a window is a step plus the
    head of the next. Blank windows are dropped; `chunk_index` numbers the rest.
    """
    step = size - overlap
    if not 0 <= overlap <= step:
        raise ValueError("overlap must be at most half of size")
    kept = [name for name in documents.columns if name != "text"]
    steps = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    windows = let(
        steps,
        lambda cut: F.zip_with(
            cut,
            F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))),
            lambda head, rest: F.concat(
                head, F.coalesce(F.substring(rest, 1, overlap), F.lit(""))
            ),
        ),
    )
    beyond = F.greatest(F.char_length("text") - size, F.lit(0))
    count = 1 + F.ceil(beyond / step).cast("int")
    pieces = F.filter(F.slice(windows, 1, count), lambda piece: ~is_blank(piece))
    # Outer, then filtered: a plain explode would infer a filter on the size
    # of the pieces and cut every text twice.
    return spread(documents).select(
        *kept, F.posexplode_outer(pieces).alias("chunk_index", "text")
    ).where("text is not null")
