"""Words of whole texts as numpy arrays over the bytes of Arrow columns.

Inside a task texts are never turned into Python strings: a slice of about a
megabyte of bytes is cut into words and hashed by array operations. White
space is 20 and 09-0D (hex) throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on at a time, whole texts being kept together.
SLICE_BYTES = 1 << 20


def _space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, 9, 10, 11, 12, 13]] = True
    return table


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


SPACE = _space_table()
LOWER = _lower_table()
ODD = np.uint64(0x9E3779B97F4A7C15)


def _random_table(seed: int, size: int = 256) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE_VALUES = _random_table(7)
POSITION = _random_table(11, 1 << 12)
GRAM = _random_table(13, 16)


class Texts(NamedTuple):
    """Bytes of some texts; text i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def count(self) -> int:
        return len(self.offsets) - 1


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray  # index of the text of each word
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Runs of whole texts of about `limit` bytes; a null is an empty text."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.large_string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, offsets_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer or b"", np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield Texts(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def words(texts: Texts, separators: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are no separators, never across texts."""
    size = len(texts.data)
    inside = np.zeros(size + 2, bool)
    inside[1:-1] = ~separators[texts.data]
    cut = np.zeros(size + 1, bool)  # a text begins here
    cut[texts.offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    bounds = np.searchsorted(starts, texts.offsets)
    text = np.repeat(np.arange(texts.count), np.diff(bounds))
    return Words(starts, ends, text, bounds)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = values ^ (values >> np.uint64(31))
    values = values * ODD
    values ^= values >> np.uint64(29)
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(32)
    return values


def word_hashes(data: np.ndarray, found: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word; other seeds give other hashes."""
    if not len(found.starts):
        return np.zeros(0, np.uint64)
    lengths = found.ends - found.starts
    longest = int(lengths.max())
    place = POSITION if longest <= len(POSITION) else _random_table(11, longest)
    values = BYTE_VALUES if not seed else _random_table(7 + (seed << 8))
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    source = at + np.repeat(found.starts, lengths)
    parts = values[data[source]] * place[at]
    sums = np.add.reduceat(parts, np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64) * ODD)


def shingles(hashes: np.ndarray, found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a text, and their texts.

    A text of fewer words, but at least one, gives its whole sequence as one.
    """
    n = len(hashes)
    counts = np.diff(found.bounds)
    if n >= size:
        run = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            run += hashes[k : n - size + 1 + k] * GRAM[k]
        whole = found.text[: n - size + 1] == found.text[size - 1 :]
        run, text = mix(run[whole]), found.text[: n - size + 1][whole]
    else:
        run, text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        own = np.zeros(len(few), np.uint64)
        for i, t in enumerate(few):
            part = hashes[found.bounds[t] : found.bounds[t + 1]]
            with np.errstate(over="ignore"):
                own[i] = (part * GRAM[: len(part)]).sum(dtype=np.uint64) + GRAM[8 + len(part) % 8]
        run, text = np.concatenate([run, mix(own)]), np.concatenate([text, few])
        order = np.argsort(text, kind="stable")
        run, text = run[order], text[order]
    return run, text


def signed(values: np.ndarray) -> np.ndarray:
    """The same bits as the long values that Spark knows."""
    return values.view(np.int64)
