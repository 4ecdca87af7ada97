"""Source registries: rule violations, defaults, restriction to one kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marlpit.functions.paths import globs_regex_column
from marlpit.functions.text import strip

# The id rule, the known kinds and the default branch.
ID_RULE = r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,63}\z"
KINDS = ("local", "git")
DEFAULT_BRANCH = "main"


def _trimmed(name: str):
    return strip(F.coalesce(F.col(name), F.lit("")))


def normalized_registry(raw: DataFrame) -> DataFrame:
    """Trimmed text, an empty exclude list and the default branch filled in."""
    return raw.select(
        "ordinal",
        _trimmed("source_id").alias("source_id"),
        _trimmed("kind").alias("kind"),
        F.nullif(_trimmed("path"), F.lit("")).alias("path"),
        F.nullif(_trimmed("url"), F.lit("")).alias("url"),
        F.coalesce(
            F.nullif(_trimmed("branch"), F.lit("")),
            F.when(_trimmed("kind") == "git", F.lit(DEFAULT_BRANCH)),
        ).alias("branch"),
        F.coalesce(F.col("include"), F.array().cast("array<string>")).alias("include"),
        F.coalesce(F.col("exclude"), F.array().cast("array<string>")).alias("exclude"),
    )


def registry_violations(raw: DataFrame) -> DataFrame:
    """One row per broken rule; of entries sharing an id, the first is good.

    Repeated ids come from a pre-aggregated count, not from a window, so that
    an id given to a large part of the table is no heavy group.
    """
    entries = normalized_registry(raw)
    repeated = (
        entries.groupBy("source_id")
        .agg(F.count("*").alias("entries"), F.min("ordinal").alias("first_ordinal"))
        .where("entries > 1")
    )
    rules = F.array_compact(
        F.array(
            F.when(~F.rlike("source_id", F.lit(ID_RULE)), F.lit("bad_id")),
            F.when(F.col("ordinal") > F.col("first_ordinal"), F.lit("repeated_id")),
            F.when(~F.col("kind").isin(*KINDS), F.lit("unknown_kind")),
            F.when(F.size("include") == 0, F.lit("no_include")),
            F.when((F.col("kind") == "local") & F.col("path").isNull(), F.lit("no_path")),
            F.when((F.col("kind") == "git") & F.col("url").isNull(), F.lit("no_url")),
        )
    )
    return entries.join(repeated, "source_id", "left").select(
        "ordinal", "source_id", F.explode(rules).alias("violation")
    )


def checked_registry(raw: DataFrame) -> DataFrame:
    """The normalized registry; an error when any rule is broken or none is left."""
    broken = registry_violations(raw).orderBy("ordinal").first()
    if broken is not None:
        raise ValueError(f"source {broken.source_id!r}: {broken.violation}")
    entries = normalized_registry(raw)
    if entries.isEmpty():
        raise ValueError("the registry lists no sources")
    return entries


def sources_of_kind(registry: DataFrame, kind: str = "local") -> DataFrame:
    return registry.where(F.col("kind") == kind)


def local_sources(registry: DataFrame) -> DataFrame:
    """The local sources; an error when there are none."""
    chosen = sources_of_kind(registry, "local")
    if chosen.isEmpty():
        raise ValueError("the registry lists no local source")
    return chosen


def compiled_globs(registry: DataFrame) -> DataFrame:
    """One include and one exclude regex per source."""
    return registry.select(
        "source_id",
        globs_regex_column("include").alias("include_regex"),
        globs_regex_column("exclude").alias("exclude_regex"),
    )
