"""What the Jaccard join keeps on disk, and that it loses no link by keeping less."""

import random
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from marlpit import runtime
from marlpit.llm import jaccard_join
from tests.llm.test_documents import SCHEMA, components, prose


def near_copies():
    random_ = random.Random(8)
    made = []
    for i in range(48):
        words = prose(i % 6, 40 + i % 5).split()
        for _ in range(random_.randrange(4)):
            words[random_.randrange(40)] = f"w{random_.randrange(20)}"
        made.append((i, " ".join(words), "en", "a", 0))
    return made


@pytest.mark.parametrize("percent", [40, 75, 100])
def test_sets_that_may_link_stay(percent):
    """Against all pairs: first shared shingle in the common order, and exact overlap."""
    random_ = np.random.default_rng(percent)
    sets = {}
    for k in range(60):
        base = np.arange(8 * (k % 9), 8 * (k % 9) + 12 + k % 7)
        members = np.unique(np.concatenate([base[random_.random(len(base)) < 0.9], random_.integers(0, 90, 2)]))
        sets[k] = members
    rows = sorted((int(x), i, k, len(s)) for k, s in sets.items() for i, x in enumerate(s[: len(s) - (percent * len(s) + 99) // 100 + 1]))
    rows += rows[::3]  # sets of several documents
    rows.sort()
    region, name = jaccard_join.may_link(*(np.array(x) for x in zip(*rows)), percent)
    kept = set(zip(region.tolist(), name.tolist()))
    assert len(kept) == len(region) and kept <= {(x, k) for x, _, k, _ in rows}
    linked = [(a, b) for a, b in combinations(sets, 2)
              if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]
    distinct = [(a, b) for a, b in linked if not np.array_equal(sets[a], sets[b])]
    for a, b in linked:
        first = int(np.intersect1d(sets[a], sets[b])[0])
        assert {(first, a), (first, b)} <= kept
    assert distinct or percent == 100
    # A set alone, or with sets too far from it in size or place, is not kept.
    place = {(x, k): i for x, i, k, _ in rows}
    for x, k in place:
        n, i = len(sets[k]), place[x, k]
        partners = [m for y, m in place if y == x and m != k
                    and (100 + percent) * min(n - i, len(sets[m]) - place[x, m]) >= percent * (n + len(sets[m]))]
        assert ((x, k) in kept) == bool(partners)


def test_tables_are_removed_and_texts_sent_in_rounds(spark, tmp_path, monkeypatch):
    made = near_copies()
    docs = spark.createDataFrame(made, SCHEMA)
    labels, rounds = [], []
    held = jaccard_join._held
    monkeypatch.setattr(jaccard_join, "_held", lambda df, label: (labels.append(label), held(df, label))[1])
    in_rounds = jaccard_join._in_rounds
    monkeypatch.setattr(jaccard_join, "_in_rounds", lambda df, key, n: (rounds.append(n), in_rounds(df, key, n))[1])
    monkeypatch.setattr(jaccard_join, "PARTS", 12)
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: f"file://{tmp_path}")
    got = jaccard_join.near_duplicates(docs)
    kept = {p.name.rsplit("-", 1)[0] for p in Path(tmp_path, "marlpit").iterdir()}
    assert sorted(map(tuple, got.collect())) == components(made)
    assert rounds[0] > 1 and labels.count("measured") == rounds[0]
    # Only what names the components is left.
    assert "document-sets" in kept and not kept & {"anchored-sets", "regions", "examples", "fetched", "stars", "bounds", "told", "named", "clusters"}
