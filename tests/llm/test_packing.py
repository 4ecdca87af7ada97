"""Packing against whole texts through the library and bins filled one by one."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.llm import packing

ODD = "a\x0bb c d e f ́x İ ΣΑΣ ñ 'S it's 12345 <|endoftext|>x 木材 🙂🙂 a\x1cb  \r\n\tend "


@pytest.fixture(scope="module")
def rows():
    random_ = random.Random(3)
    words = ["river", "Stone", "été", "x1", "don't", "...", "wörter"]
    made = [(i, " ".join(random_.choices(words, k=random_.randrange(0, 90)))) for i in range(150)]
    odd = ["W", "w", "e", "É", "'", "'s", "'Re", "!", "!!", ",", "<", "|", "<|", "|>", "<|ENDOFTEXT|>", "<|endoftext|>", "1", "\u030a", "\u0301", "\u00a0", " ", "\n", "…", "木", "K", "\u212a", "İ"]
    made += [(300 + i, "".join(random_.choices(odd, k=random_.randrange(1, 60)))) for i in range(300)]
    return made + [(1, made[1][1]), (200, None), (201, ""), (202, " \n "), (203, ODD), (204, "ab " * 5000), (None, "no id"), (205, "x" * 9000)]


def expected(rows, width):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(packing.read_tokenizer())
    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for p in range(-(-len(ids) // width)):
            out.append((doc, p, p * width, ids[p * width : (p + 1) * width]))
    return out


@pytest.mark.parametrize("width", [16, 2048])
def test_pieces_and_places(spark, rows, width):
    names = "piece start length ids part nth rank sequence_id offset n".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).select("*", *[F.lit("x").alias(n) for n in names])
    tokenizer = packing.read_tokenizer()
    packed = packing.packed_pieces(docs, tokenizer, width).cache()
    wanted = expected(rows, width)
    got = [tuple(r) for r in packed.collect()]
    assert sorted(((d, p, s, i) for d, p, s, n, i, *_ in got), key=repr) == sorted(wanted, key=repr)
    assert all(len(i) == n for _, _, _, n, i, *_ in got)
    bins = {}
    for _, _, _, length, _, sequence, offset in got:
        bins.setdefault(sequence, []).append((offset, length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
    assert sorted(bins) == list(range(len(bins)))
    least = -(-sum(len(i) for *_, i in wanted) // width)
    assert len(bins) <= least * 1.1 + 1
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == sum(len(i) for *_, i in wanted)
    by_doc = {(d, s): i for d, p, s, i in wanted}
    for r in whole:
        for span in r.spans:
            assert r.ids[span.offset : span.offset + span.length] == by_doc[span.doc_id, span.start]
    short = packing.packed_pieces(docs, tokenizer, width, ids=False).collect()
    assert Counter(r.ids_crc32 for r in short) == Counter(zlib.crc32(np.array(i, "<u4").tobytes()) for *_, i in wanted)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed_pieces(empty, packing.read_tokenizer()).collect() == []


def one_by_one(counts, width):
    """Bins filled one after another from single pieces."""
    left, bins = Counter(counts), []
    while +left:
        bin_, gap = [], width
        for length in sorted(left, reverse=True):
            while left[length] and length <= gap:
                bin_.append(length)
                left[length] -= 1
                gap -= length
        if gap and len(bin_) > 1:
            small = min(bin_)
            pairs = [
                (x + y, -x, x, y) for x in left for y in left
                if x <= y and small < x + y <= gap + small and left[x] and left[y] > (x == y)
            ]
            if pairs:
                *_, x, y = max(pairs)
                bin_.remove(small)
                left[small] += 1
                bin_ += [x, y]
                left[x] -= 1
                left[y] -= 1
        bins.append(tuple(sorted(bin_, reverse=True)))
    return bins


@pytest.mark.parametrize("seed", range(20))
def test_best_two_fit_fills_bins_as_one_by_one(seed):
    random_ = random.Random(seed)
    width = random_.choice([10, 40, 100])
    counts = Counter(random_.randint(1, width) for _ in range(random_.randrange(1, 300)))
    bins = []
    for parts, times in packing.best_two_fit(dict(counts), width):
        bins += [tuple(x for length, n in parts for x in [length] * n)] * times
    wanted = one_by_one(counts, width)
    assert sum(map(sum, bins)) == sum(k * v for k, v in counts.items())
    assert Counter(x for b in bins for x in b) == counts
    assert all(sum(b) <= width for b in bins)
    # Pairs of equal sums may differ, so bins are compared by how full they are.
    assert len(bins) <= len(wanted) + 1


def test_a_smallest_piece_gives_way_to_two():
    assert packing.best_two_fit({60: 1, 30: 1, 21: 1, 19: 1}, 100) == [([(60, 1), (21, 1), (19, 1)], 1), ([(30, 1)], 1)]
    assert packing.best_two_fit({2048: 5, 1024: 4, 1: 3}) == [([(2048, 1)], 5), ([(1024, 2)], 2), ([(1, 3)], 1)]
    assert packing.best_two_fit({}) == []
