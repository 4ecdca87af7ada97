"""A Bloom filter of keys, built by aggregation and applied as a Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Bits for each key while the filter has room, probes of a key, and the most bytes of a filter.
BITS_PER_KEY = 16
PROBES = 4
FILTER_BYTES = 4 << 20


def key_filter(keys: DataFrame, on: list[str], n_keys: int, most_bytes: int | None = None) -> Column:
    """Whether the key in the columns `on` may be one of `keys`: never false for one that is.

    Keys set bits in 64-bit words; equal words are joined by a bitwise or before and
    after the shuffle, and the words come back as one array, which is a scalar subquery
    and so a constant of the scan it filters. About one other key in 400 is held too
    while `n_keys` keys have `BITS_PER_KEY` bits each; a filter at its bound lets
    more through, and an exact join must follow anyhow.
    """
    most = FILTER_BYTES if most_bytes is None else most_bytes
    words = max(1, min(most // 8, -(-n_keys * BITS_PER_KEY // 64)))
    bits = (
        keys.select(F.explode(F.array(*_positions(on, words))).alias("at"))
        .groupBy(F.shiftright("at", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))
    )
    # One row of `words` numbers, those without a bit included.
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word"))
    row = every.join(bits, "word", "left").agg(
        F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("held")
    )
    held = row.select(F.col("held.bits").alias("held")).scalar()
    tests = [
        F.get(held, F.shiftright(at, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0
        for at in _positions(on, words)
    ]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def _positions(on: list[str], words: int) -> list[Column]:
    """The bits of a key, each from a hash of its own."""
    return [F.pmod(F.xxhash64(F.lit(k), *on), F.lit(64 * words).cast("long")) for k in range(PROBES)]
