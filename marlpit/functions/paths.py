"""Columns over relative paths: globs, pruned folders, language, order, safety."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Folders never indexed, and languages by file suffix.
SKIPPED_FOLDERS = (".git", "node_modules", "vendor", "dist", "__pycache__", ".venv")
MARKDOWN_SUFFIXES = (".md", ".mdx", ".markdown")
CODE_SUFFIXES = {
    "python": (".py",),
    "js": (".js", ".jsx"),
    "ts": (".ts", ".tsx"),
    "go": (".go",),
    "java": (".java",),
    "rust": (".rs",),
}

_NEVER = "(?!)"


def _literal(char: str) -> str:
    return char if char.isalnum() and char.isascii() else f"\\x{{{ord(char):x}}}"


def _class_regex(body: str) -> str:
    """Regex for the inside of a glob's `[...]`; reversed ranges match nothing."""
    negated = body.startswith("!")
    body = body[1:] if negated else body
    members = []
    at = 0
    while at < len(body):
        if body[at + 1 : at + 2] == "-" and at + 2 < len(body):
            low, high = body[at], body[at + 2]
            if low <= high:
                members.append(f"{_literal(low)}-{_literal(high)}")
            at += 3
        else:
            members.append(_literal(body[at]))
            at += 1
    if not members:
        return "." if negated else _NEVER
    return f"[{'^' if negated else ''}{''.join(members)}]"


def _glob_body(glob: str) -> str:
    out = []
    at = 0
    while at < len(glob):
        char = glob[at]
        at += 1
        if char == "*":
            if out[-1:] != [".*"]:
                out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[":
            # A `]` right after `[` or `[!` is a member, not the end.
            first = at + 1 if glob[at : at + 1] == "!" else at
            end = glob.find("]", first + 1)
            if end < 0:
                out.append(_literal(char))
            else:
                out.append(_class_regex(glob[at:end]))
                at = end + 1
        else:
            out.append(_literal(char))
    return "".join(out)


def globs_regex(globs: Iterable[str]) -> str:
    """One anchored Java regex for a list of globs; an empty list matches nothing.

    `*` and `?` also match `/`, case counts, and a glob that starts with `**/`
    is tried without that start too.
    """
    branches = []
    for glob in globs:
        glob = glob.replace("\\", "/")
        branches.append(_glob_body(glob))
        if glob.startswith("**/"):
            branches.append(_glob_body(glob[3:]))
    if not branches:
        return _NEVER
    return f"(?s)\\A(?:{'|'.join(dict.fromkeys(branches))})\\z"


@F.pandas_udf(T.StringType())
def globs_regex_column(globs: pd.Series) -> pd.Series:
    """`globs_regex` for a registry column of glob lists (configuration-sized)."""
    return globs.map(lambda items: globs_regex(items if items is not None else ()))


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    return F.rlike(slashed(path), F.lit(globs_regex(globs)))


def selected(path: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    wanted = matches_any(path, include)
    return wanted & ~matches_any(path, exclude) if exclude else wanted


def parts(path: Column) -> Column:
    """Path components; sorting by them puts `a/b` before `a-b`."""
    return F.split(path, "/")


def in_skipped_folder(path: Column) -> Column:
    folders = parts(path)
    return F.arrays_overlap(
        F.slice(folders, 1, F.size(folders) - 1),
        F.array(*[F.lit(name) for name in SKIPPED_FOLDERS]),
    )


def language_class(path: Column) -> Column:
    """Language of a path, null when unknown; markdown wins over any suffix."""
    name = F.lower(F.element_at(parts(path), -1))
    suffix = F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1)
    language = F.when(
        suffix.isin(*MARKDOWN_SUFFIXES) | name.startswith("readme"), F.lit("markdown")
    )
    for label, suffixes in CODE_SUFFIXES.items():
        language = language.when(suffix.isin(*suffixes), F.lit(label))
    return language


def is_safe_path(path: Column) -> Column:
    """Non-empty, relative, without a `..` component."""
    return F.coalesce(
        (path != "")
        & ~F.substring(path, 1, 1).isin("/", "\\")
        & ~F.array_contains(parts(path), ".."),
        F.lit(False),
    )


__all__ = [
    "globs_regex",
    "globs_regex_column",
    "in_skipped_folder",
    "is_safe_path",
    "language_class",
    "matches_any",
    "parts",
    "selected",
    "slashed",
]
