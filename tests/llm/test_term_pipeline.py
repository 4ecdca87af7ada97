"""Ranked search against plain Python on small tables."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlpit.llm import term_pipeline

WORDS = "the of and river stone cloud meadow lantern copper window garden silver thunder paper candle été wörter 木材".split()
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, bag in bags:
            size, score = sum(bag.values()), 0
            for term in wanted & bag.keys():
                df = sum(1 for _, b in bags if term in b)
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                score += weight * (10**9 * bag[term] // (1000 * bag[term] + 8 * (10 + 90 * size * n // total)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort(key=lambda x: x[:3])
        out += [(item, at + 1, doc, -score) for at, (score, *_, doc) in enumerate(scored[:10])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    random_ = random.Random(4)
    docs = [(i, " ".join(random_.choices(WORDS, [20, 15, 10] + [1] * 15, k=random_.randrange(1, 60)))) for i in range(300)]
    copy = "Copper lantern, silver THUNDER; paper"
    docs += [(400 + i, copy) for i in range(15)] + [(7, copy), (7, copy), (None, copy), (500, None), (501, ""), (502, "?! ... \n")]
    docs += [(503, "thunder " * 30_000)]
    items = [(i, " ".join(random_.sample(WORDS, 6))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "nowhere found"), (33, "the of"), (1, "extra copper"), (None, copy), (34, copy)]
    return docs, items


@pytest.mark.parametrize("setting", [{}, {"BLOCK_DOCS": 16, "BUNDLE_ITEMS": 4}, {"BLOCK_POSTINGS": 40, "PLAN_ROWS": 1}, {"VOCABULARY_TERMS": 2, "BLOCK_DOCS": 50}])
def test_ranks_like_plain_python(spark, monkeypatch, tables, setting):
    for name, value in setting.items():
        monkeypatch.setattr(term_pipeline, name, value)
    docs, items = tables
    names = "score rank block term w slot bundle place counts".split()
    given = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).select("*", *[F.lit("x").alias(n) for n in names])
    asked = spark.createDataFrame(items, "item_id long, text string").select("*", *[F.lit("x").alias(n) for n in names])
    got = term_pipeline.rank_documents(given, asked)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items)


def test_empty_tables(spark, tables):
    docs, items = (spark.createDataFrame(rows, f"{name} long, text string") for rows, name in zip(tables, ("doc_id", "item_id")))
    for given, asked in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("doc_id = 501"), items)):
        assert term_pipeline.rank_documents(given, asked).collect() == []
