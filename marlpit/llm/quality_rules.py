"""Quality rules: base counts and a likelihood ratio of hashed n-grams, in SQL functions only.

The trusted target is the part of the corpus that passes strict rules of form.
Words and word pairs of all documents fall into a fixed number of buckets; a
document's score is its mean log ratio of the target's bucket probabilities to
those of the raw corpus. The table of ratios has fixed size and enters the plan as
one literal, so scoring is a scan without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 14
THRESHOLD = -0.1
MIN_WORDS = 20
WINDOW = 8


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _count_of(text: Column, characters: str) -> Column:
    """Occurrences of single characters of a class."""
    return F.regexp_count(text, F.lit(characters)).cast("long")


def _word_chars(text: Column) -> Column:
    return (F.length(text) - _count_of(text, SPACE)).cast("long")


def pair_hashes(words: Column) -> Column:
    """Hashes of all pairs of adjacent words."""
    return _joined(words, 1)


def _joined(values: Column, apart: int) -> Column:
    """Hashes of all (value, value `apart` places on)."""
    return F.when(F.size(values) <= apart, F.array().cast("array<long>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.size(values) - apart - 1),
            lambda i: F.xxhash64(F.get(values, i), F.get(values, i + apart)),
        )
    )


def repeat_words(pairs: Column) -> Column:
    """Words within windows of eight words that occur twice or more, from the hashes of pairs."""

    def covered(hashes: Column) -> Column:
        def of_sorted(places: Column) -> Column:
            same = F.filter(
                places,
                lambda x, k: (F.get(places, k - 1)["h"] == x["h"]) | (F.get(places, k + 1)["h"] == x["h"]),
            )
            starts = F.sort_array(F.transform(same, lambda x: x["i"]))
            first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
            return F.aggregate(
                starts, first,
                lambda acc, i: F.struct(
                    i.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total")
                ),
                lambda acc: acc["total"],
            )

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, of_sorted))

    eights = let(_joined(pairs, 2), lambda fours: _joined(fours, 4))
    return let(eights, covered).cast("long")


def grams(words: Column, pairs: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of adjacent words."""
    return F.concat(
        F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")),
        F.transform(pairs, lambda h: F.pmod(h, F.lit(buckets)).cast("int")),
    )


def trusted(text: Column, words: Column) -> Column:
    """Prose by form alone: enough different words, few symbols, capitals and exclamations."""
    used = _word_chars(text)
    return (
        (F.size(words) >= 50)
        & (3 * F.size(F.array_distinct(words)) >= F.size(words))
        & (500 * _count_of(text, f"[!{SYMBOLS}]") <= used)
        & (5 * _count_of(text, "[A-Z]") <= used)
    )


def log_ratios(docs: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log ratio of target to raw probability of each bucket, over all documents.

    Counts have one added. Without any trusted document all ratios are 0.
    """
    text = F.coalesce("text", F.lit(""))
    both = let(
        _words(F.col("text")),
        lambda w: F.struct(
            trusted(text, w).cast("int").alias("trusted"), grams(w, pair_hashes(w), buckets).alias("grams")
        ),
    )
    counted = (
        docs.select(both.alias("both"))
        .select("both.trusted", F.explode("both.grams").alias("bucket"))
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    )
    raw, target = [1.0] * buckets, [1.0] * buckets
    for bucket, n, t in counted.collect():  # at most `buckets` rows
        raw[bucket] += n
        target[bucket] += t
    all_raw, all_target = sum(raw), sum(target)
    if all_target == buckets:
        return [0.0] * buckets
    return [math.log(t / all_target) - math.log(r / all_raw) for r, t in zip(raw, target)]


def quality_rules(docs: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, carry: tuple = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    One row for each row of `docs` (doc_id, text and the columns in `carry`, which
    follow unchanged). Null, empty and blank texts have no words, fail the base and
    score 0. Kept is what passes the base with a score of at least `threshold`, so
    ties at the threshold are kept. Other columns are ignored.
    """
    table = ",".join(repr(x) for x in log_ratios(docs, buckets))
    ratios = F.split(F.lit(table), ",").cast("array<double>")
    text = F.coalesce("text", F.lit(""))

    def measured(words: Column) -> Column:
        return let(pair_hashes(words), lambda pairs: counted(words, pairs))

    def counted(words: Column, pairs: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        total = F.aggregate(grams(words, pairs, buckets), F.lit(0.0), lambda acc, g: acc + F.get(ratios, g))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeat_words(pairs).alias("n_repeat_words"),
            F.when(F.size(words) == 0, 0.0).otherwise(total / (2 * F.size(words) - 1)).alias("score"),
        )

    found = docs.select(
        "doc_id", *carry,
        _word_chars(text).alias("word_chars"), _count_of(text, f"[{SYMBOLS}]").alias("n_symbols"),
        let(_words(F.col("text")), measured).alias("measured"),
    )
    n, repeated = F.col("measured.n_words"), F.col("measured.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeated > 30 * n)
    return found.select(
        "doc_id", n.alias("n_words"), "word_chars", "n_symbols", "measured.n_dup_lines", "measured.n_repeat_words",
        failed.alias("base_failed"), "measured.score",
        (~failed & (F.col("measured.score") >= threshold)).alias("kept"), *carry,
    )
