"""The mix as blocks in schedule order, and documents cut where it ends."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlpit.llm import mixing

ROWS = [(i, " ".join(f"d{i}w{k}" for k in range(5 + 7 * (i % 6))), "abc"[i % 3] if i % 7 else None) for i in range(60)]
ROWS += [(100, None, "a"), (101, " \n", "b"), (None, "no id at all", "a"), (None, "  another\twithout \n id, longer than a block ", "b"), (7, ROWS[7][1], ROWS[7][2]), (7, ROWS[7][1], ROWS[7][2])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3)


def test_blocks_are_joined_in_schedule_order(docs):
    rows = mixing.interleaved(docs.withColumn("slot", F.lit("x")), block=8).orderBy("slot").collect()
    assert len({r.slot for r in rows}) == len(rows)
    words = Counter()
    for r in rows:
        assert len(r.text.split()) == sum(s.words for s in r.spans) <= 8
        at, mine = 0, r.text.split()
        for span in r.spans:
            texts = [t for d, t, s in ROWS if d == span.doc_id and s == r.source]
            assert any(t.split()[span.first : span.first + span.words] == mine[at : at + span.words] for t in texts if t)
            words[span.doc_id] += span.words
            at += span.words
    taken = Counter()
    for r in mixing.mix(docs, block=8).collect():
        taken[r.doc_id] += r.taken
    assert +taken == words
    # Prefixes follow the weights: each source's share of any prefix is near its target's.
    shares = {r.source: r.target for r in mixing.mix(docs, block=8).select("source", "target").distinct().collect()}
    total = sum(shares.values())
    for n in (20, len(rows) // 2):
        seen = Counter(r.source for r in rows[:n])
        assert all(abs(seen[s] - n * t / total) <= 3 for s, t in shares.items())


@pytest.mark.parametrize("text", ["one two  three\n four", "  lead one\ttwo ", "x", " \n y z"])
def test_texts_are_cut_after_a_word(spark, text):
    n = len(text.split())
    df = spark.createDataFrame([(text, k) for k in range(1, n + 1)], "text string, k int")
    for r in df.select("k", mixing._first_words(F.col("text"), F.col("k")).alias("cut")).collect():
        assert r.cut == re.match(r"\s*" + r"\s+".join([r"\S+"] * r.k), text).group()


def test_documents_stand_as_often_as_they_are_taken(docs):
    named = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("row", F.lit("x")).withColumn("h1", F.col("source"))
    got = Counter()
    for r in mixing.mixed_documents(named, block=8).collect():
        assert r.n_chars == len(r.text) and r.row == "x" and r.h1 == r.source
        assert any(t and t.startswith(r.text) for d, t, s in ROWS if (d, s) == (r.doc_id, r.source))
        got[r.doc_id] += len(r.text.split())
    taken = Counter()
    for r in mixing.mix(named, block=8).collect():
        taken[r.doc_id] += r.taken
    assert got == +taken
