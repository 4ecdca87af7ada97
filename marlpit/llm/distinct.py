"""Token ids of texts whose parts are encoded apart: each distinct part once a task, or once a worker.

Spark gives a Python worker one task after another; with `of_worker`, what a worker has
learned of one tokenizer stays for its next tasks, up to a bound.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa

# Parts, and bytes of them, that are remembered; beyond, all begins anew.
REMEMBERED = 1 << 20
REMEMBERED_BYTES = 1 << 26
# Where a worker keeps them: functions come to it by value, so modules of ours do not last.
SHELF = "part_ids_of_this_worker"


def parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings data[starts:ends], which may not overlap, as an Arrow column."""
    lengths = ends - starts
    stops = np.cumsum(lengths)
    kept = np.zeros(len(data) + 1, np.int8)
    kept[starts[lengths > 0]] += 1
    kept[ends[lengths > 0]] -= 1
    flat = data[np.cumsum(kept[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], stops]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


class PartIds:
    """Remembers the ids and a flag of each distinct part."""

    def __init__(self, encode: Callable[[list[str]], tuple[Sequence, Sequence[bool]]], most: int = REMEMBERED):
        self.encode, self.most = encode, most
        self._empty()

    def _empty(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts, self.lengths, self.flags = (np.zeros(1 << 12, t) for t in (np.int64, np.int64, bool))
        self.used = self.bytes = 0

    def _room(self, name: str, size: int) -> None:
        held = getattr(self, name)
        if size > len(held):
            setattr(self, name, np.concatenate([held, np.zeros(max(size - len(held), len(held)), held.dtype)]))

    def _learn(self, words: list[bytes]) -> None:
        encoded, flags = self.encode([w.decode() for w in words])
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        n, total = len(self.known), int(lengths.sum())
        for name, size in (("ids", self.used + total), ("starts", n + len(words)), ("lengths", n + len(words)), ("flags", n + len(words))):
            self._room(name, size)
        at = slice(n, n + len(words))
        self.starts[at] = self.used + np.cumsum(lengths) - lengths
        self.lengths[at], self.flags[at] = lengths, flags
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(encoded), np.int32, total)
        self.used += total
        self.known.update(zip(words, range(n, n + len(words))))

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after another, how many each part has, and its flag."""
        coded = column.dictionary_encode()
        words = coded.dictionary.to_pylist()
        places = list(map(self.known.get, words))
        fresh = [w for w, place in zip(words, places) if place is None]
        full = len(self.known) + len(fresh) > self.most or self.bytes > REMEMBERED_BYTES
        if full and self.known:
            self._empty()
            fresh = words
        if fresh:
            self.bytes += sum(map(len, fresh))
            self._learn(fresh)
            places = list(map(self.known.get, words))
        place = np.array(places, np.int64)[coded.indices.to_numpy()]
        lengths = self.lengths[place]
        stops = np.cumsum(lengths)
        at = np.arange(stops[-1] if len(stops) else 0) + np.repeat(self.starts[place] - stops + lengths, lengths)
        return self.ids[at], lengths, self.flags[place]


def of_worker(name: str, make: Callable[[], Callable]) -> PartIds:
    """The parts that this worker knows under a name; `make` gives the encoder of new ones."""
    shelf = sys.modules.setdefault(SHELF, ModuleType(SHELF))
    known = vars(shelf).get(name)
    if known is None:
        # One tokenizer at a time, so that the bound holds.
        vars(shelf).clear()
        known = vars(shelf)[name] = PartIds(make())
    return known
