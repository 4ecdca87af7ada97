"""Best-two-fit packing of documents into sequences of equal width.

Words are encoded apart, without marks after them, each distinct one once a worker; only
documents longer than the width are cut. How pieces are packed depends on their lengths alone, so the plan
is made from the number of pieces of each length, of which there are at most as many
as the width: a bin is filled greedily, its smallest piece gives way to two that fill
its gap better, and the same bin is made again while there are pieces for it. Pieces
then find their places by their rank among those of their length.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from marlpit.llm import distinct, tokens
from marlpit.runtime import broadcast_if_small, stage

WIDTH = 2048
END = 0
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
SLICE_BYTES = 1 << 22


def read_tokenizer(path: str = TOKENIZER) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def best_two_fit(counts: dict[int, int], width: int = WIDTH) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins as ([(length, copies)], times), for pieces counted by length.

    Each is the bin that filling one by one would make next, as often as its pieces last.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    lengths = sorted(left)
    bins = []
    while lengths:
        taken: dict[int, int] = {}
        gap, at = width, len(lengths)
        while at and (at := bisect_right(lengths, gap, 0, at)):
            length = lengths[at - 1]
            copies = min(left[length], gap // length)
            taken[length] = copies
            gap -= copies * length
            at -= 1
        smallest = min(taken)
        if gap and sum(taken.values()) > 1:
            pair = _best_pair(lengths, left, taken, smallest, gap + smallest)
            if pair:
                taken[smallest] -= 1
                for length in pair:
                    taken[length] = taken.get(length, 0) + 1
        taken = {length: n for length, n in taken.items() if n}
        times = min(left[length] // n for length, n in taken.items())
        bins.append((sorted(taken.items(), reverse=True), times))
        for length, n in taken.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
                lengths.pop(bisect_left(lengths, length))
    return bins


def _best_pair(lengths: list[int], left: dict, taken: dict, smallest: int, room: int) -> tuple[int, int] | None:
    """Two unpacked pieces of the largest sum above `smallest` and up to `room`."""
    spare = [x for x in lengths[: bisect_right(lengths, room)] if left[x] > taken.get(x, 0)]
    best, pair, low, high = smallest, None, 0, len(spare) - 1
    while low <= high:
        x, y = spare[low], spare[high]
        if x + y > room:
            high -= 1
            continue
        if x + y > best and (low < high or left[x] - taken.get(x, 0) > 1):
            best, pair = x + y, (x, y)
        low += 1
    return pair


def _places(bins: list) -> dict[str, np.ndarray]:
    """For runs of ranks of a length: the bin of the first, copies a bin, and the place of the first copy."""
    rows, ranks, sequence = [], {}, 0
    for parts, times in bins:
        place = 0
        for length, copies in parts:
            rank = ranks.get(length, 0)
            rows.append((length, rank, sequence, copies, place))
            ranks[length] = rank + times * copies
            place += length * copies
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "copies", "place"), np.ascontiguousarray(columns)))


def _units(texts: tokens.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and starts, ends and texts of parts whose ids, one after another, are those of the texts.

    Words are such parts, as no token holds white space. So is what follows an ASCII
    letter from the first ASCII mark on, since a run of letters ends there whatever
    comes next. Words of ASCII alone are lowered, as the normaliser does. A word that
    may hold the name of a special token stays as it is.
    """
    found, data = tokens.words(texts), texts.data
    special = np.zeros(len(data) + 1, bool)
    special[1:-1] = (data[:-1] == NAME[0]) & (data[1:] == NAME[1])

    def of_words(marks: np.ndarray) -> np.ndarray:
        which = np.zeros(len(found.starts), bool)
        which[np.searchsorted(found.ends, np.flatnonzero(marks), side="right")] = True
        return which

    def inside(which: np.ndarray) -> np.ndarray:
        edges = np.zeros(len(data) + 1, np.int8)
        edges[found.starts[which]] += 1
        edges[found.ends[which]] -= 1
        return np.cumsum(edges[:-1], dtype=np.int8).view(bool)

    named = of_words(special[1:])
    kept = inside(of_words(data >= 128) | named)
    cut = np.zeros(len(data), bool)
    cut[1:] = LETTER[data[:-1]] & MARK[data[1:]]
    if named.any():
        cut &= ~inside(named)
    cuts = np.flatnonzero(cut)
    starts, ends = np.sort(np.concatenate([found.starts, cuts])), np.sort(np.concatenate([found.ends, cuts]))
    return np.where(kept, data, tokens.LOWER[data]), starts, ends, np.searchsorted(texts.offsets, starts, side="right") - 1


def _ascii(test) -> np.ndarray:
    return np.array([value < 128 and test(chr(value)) for value in range(256)])


# What special tokens begin with.
NAME = b"<|"
LETTER = _ascii(str.isalpha)
MARK = _ascii(lambda c: c.isprintable() and not c.isalnum() and c != " ")


def pieces(docs: DataFrame, tokenizer: str, width: int = WIDTH, end: int = END, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids, and part and nth: the task and the rank among its pieces of that length.

    Without `ids` their CRC-32 stands instead, of little-endian unsigned 32-bit numbers, as ids_crc32.
    """
    whole = ids
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    name = "packing " + hashlib.sha256(tokenizer.encode()).hexdigest()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        def encoder():
            library = Tokenizer.from_str(shared.value)

            def encode(words):
                found = library.encode_batch_fast(words, add_special_tokens=False)
                return [e.ids for e in found], np.zeros(len(words), bool)

            return encode

        table, task = distinct.of_worker(name, encoder), TaskContext.get().partitionId()
        seen = np.zeros(width + 1, np.int64)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for texts in tokens.slices(batch.column("text"), SLICE_BYTES):
                data, starts, ends, owner = _units(texts)
                found, lengths, _ = table.of(distinct.parts(data, starts, ends))
                sizes = np.bincount(owner, weights=lengths, minlength=texts.count).astype(np.int64) + 1
                stops = np.cumsum(sizes)
                flat = np.full(int(stops[-1]), end, np.int32)
                is_id = np.ones(len(flat), bool)
                is_id[stops - 1] = False
                flat[is_id] = found
                # Pieces: all of full width but the last of each document.
                n = -(-sizes // width)
                doc = np.repeat(np.arange(texts.count), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * width
                length = np.minimum(sizes[doc] - start, width)
                # Ranks among the pieces of a length, in order.
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order], side="left")
                nth = np.empty(len(order), np.int64)
                nth[order] = seen[length[order]] + np.arange(len(order)) - first
                seen += np.bincount(length, minlength=width + 1)
                bounds = np.concatenate([[0], np.cumsum(length)])
                if whole:
                    content = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
                else:
                    raw = memoryview(flat.astype("<u4", copy=False)).cast("B")
                    content = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in pairwise(bounds.tolist())], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.take(pa.array(texts.first + doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                        content, pa.array(np.full(len(doc), task, np.int32)), pa.array(nth),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids" if whole else "ids_crc32", "part", "nth"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    content = "ids array<int>" if ids else "ids_crc32 long"
    schema = f"doc_id {kind}, piece int, start long, length long, {content}, part int, nth long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(cut: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of `pieces` with sequence_id and offset, in place of part and nth.

    `cut` must be a written table: it is read twice. Sequences are numbered from 0
    without gaps; pieces of a sequence follow one another from offset 0 on.
    """
    by_task = stage(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    # At most `width` lengths, whatever the number of pieces.
    counts = {row["length"]: row["n"] for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = _places(best_two_fit(counts, width))
    shared = cut.sparkSession.sparkContext.broadcast(plan)
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    ranked = (
        cut.join(broadcast_if_small(before), ["length", "part"])
        .withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth", "part")
    )
    fields = [f for f in ranked.schema.fields if f.name != "rank"]

    def run(batches):
        places = shared.value
        # Runs are sorted by length and rank; both fit one number.
        keys = (places["length"].astype(np.uint64) << np.uint64(48)) + places["rank"].astype(np.uint64)
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length.astype(np.uint64) << np.uint64(48)) + rank.astype(np.uint64), side="right") - 1
            bin_, copy = np.divmod(rank - places["rank"][at], places["copies"][at])
            out = batch.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(places["sequence"][at] + bin_))
            yield out.append_column("offset", pa.array(places["place"][at] + copy * length))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def packed_pieces(docs: DataFrame, tokenizer: str, width: int = WIDTH, end: int = END, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids or their ids_crc32, sequence_id, offset: a row for each piece.

    A document is the ids of its text and one `end`; a null or empty text is the end
    alone. Documents of any length are cut into pieces of `width`, the last may be
    shorter. Repeated rows are documents of their own; other columns are ignored; an
    empty table gives no rows.
    """
    packed = pack(stage(pieces(docs, tokenizer, width, end, ids), "pieces"), width)
    return packed.select("doc_id", "piece", "start", "length", "ids" if ids else "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and spans (offset, doc_id, start, length) of the rows of `packed_pieces` with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"),
        F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"))).alias("spans"),
    )
