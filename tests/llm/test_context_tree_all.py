"""Context-tree scores where the training texts hold more contexts than any fixed table."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from marlpit.llm import context_tree

DEPTH = 4


def ways(byte):
    """Bit prefixes of a byte and the bits that follow them."""
    return [((1 << k) | byte >> (8 - k), byte >> (7 - k) & 1) for k in range(8)]


def places(text):
    data = b"".join(w.encode() + b" " for w in text.split()) + b"\xff"
    padded = b"\xff" * DEPTH + data
    return [(padded[i : i + DEPTH], byte) for i, byte in enumerate(data)]


def reference(training):
    counts = defaultdict(lambda: [0, 0])
    for text in training:
        for past, byte in places(text):
            for d in range(DEPTH + 1):
                for prefix, bit in ways(byte):
                    counts[past[DEPTH - d :], prefix][bit] += 1
    share, below = {}, defaultdict(float)
    for context, prefix in sorted(counts, key=lambda node: -len(node[0])):
        zeros, ones = counts[context, prefix]
        own = math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)
        weighted = own if len(context) == DEPTH else np.logaddexp(own, below[context, prefix]) - math.log(2)
        share[context, prefix] = 1.0 if len(context) == DEPTH else math.exp(own - math.log(2) - weighted)
        below[context[1:], prefix] += weighted

    def log10(text):
        total = 0.0
        for past, byte in places(text):
            for prefix, bit in ways(byte):
                mixed, left, last = 0.0, 1.0, 0.5
                for d in range(DEPTH + 1):
                    context = past[DEPTH - d :]
                    if (context, 1) not in counts:
                        break
                    zeros, ones = counts.get((context, prefix), (0, 0))
                    last = (ones + 0.5) / (zeros + ones + 1)
                    own = share.get((context, prefix), 1.0 if d == DEPTH else 0.5)
                    mixed, left = mixed + left * own * last, left * (1 - own)
                one = min(max(mixed + left * last, 1e-6), 1 - 1e-6)
                total += math.log10(one if bit else 1 - one)
        return total

    return len({c for c, _ in counts}), log10


@pytest.mark.parametrize("frequent", [1000, 1 << 20])
def test_every_context_counts(spark, frequent):
    random_ = random.Random(4)
    letters = lambda n: "".join(random_.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    trained = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 != 2][:4]
    texts = {i: " ".join(letters(9) for _ in range(800)) for i in trained}
    texts[out] = " ".join([*texts[trained[0]].split()[:40], *[letters(9) for _ in range(40)], "Ü#"])
    n_contexts, log10 = reference([texts[i] for i in trained])
    assert n_contexts > 1 << 15
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for r in context_tree.language_scores(table, depth=DEPTH, frequent=frequent).collect():
        assert r.score == pytest.approx(log10(texts[r.doc_id]), rel=1e-6)
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.bytes)


def test_more_subtrees_than_tasks_give_the_same_scores(spark, monkeypatch):
    rows = [(i, " ".join(f"{i * k % 97}x{k}" for k in range(60))) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    once = {r.doc_id: r.score for r in context_tree.language_scores(table).collect()}
    monkeypatch.setattr(context_tree, "RUNS_PER_TASK", 500)
    again = {r.doc_id: r.score for r in context_tree.language_scores(table).collect()}
    assert again == pytest.approx(once, rel=1e-9)
