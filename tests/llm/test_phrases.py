"""Collocations against counting all phrases in plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlpit.llm import phrases


def every_phrase(docs):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = lang or "und"
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                counts.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    return counts, totals


def collocations(docs, least, top):
    f, totals = every_phrase(docs)
    candidates = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    absorbed = set()
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * a >= 80 * f[lang, p[i : i + m]]:
                    absorbed.add((lang, p[i : i + m]))
    rows = []
    for (lang, p), a in candidates.items():
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if (lang, p) not in absorbed:
            rows.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out, place = [], Counter()
    for lang, score, a, phrase, left, right in sorted(rows):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return out


@pytest.fixture(scope="module")
def docs():
    random_ = random.Random(8)
    vocabulary = [f"w{i}" for i in range(25)] + ["Été", "木材", "a", "A"]
    fixed = ["red green blue", "red green blue white", "one two", "a a a", "W1 w2 w3"]

    def text(n):
        parts = [random_.choice(fixed) if random_.random() < 0.3 else random_.choice(vocabulary) for _ in range(n)]
        return "".join(p + random_.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for p in parts)

    rows = [(text(random_.randrange(1, 60)), random_.choice(["en", "en", "de", None, "und"])) for _ in range(120)]
    return rows + [rows[0]] * 3 + [(None, "en"), ("", "de"), (" .,\n ", "fr"), ("once only", "fr"), (text(4000), "en"), ("ab " * 3000, "es")]


@pytest.mark.parametrize(
    "setting",
    [{"TOP": 2000, "LEAST": 30}, {"TOP": 8, "LEAST": 3, "FIRST_BATCH": 60, "HELD": 64}],
)
def test_finds_what_counting_all_phrases_finds(spark, monkeypatch, docs, setting):
    for name, value in setting.items():
        monkeypatch.setattr(phrases, name, value)
    names = "score rank phrase a l r n x word words side".split()
    given = spark.createDataFrame(docs, "text string, lang string").repartition(4).select("*", *[F.lit("x").alias(n) for n in names])
    got = sorted(map(tuple, phrases.collocations(given).collect()))
    assert got == sorted(collocations(docs, setting["LEAST"], setting["TOP"]))


def test_counts_anew_when_words_share_an_id(spark, monkeypatch, docs):
    rows = [("x", "en")] * 40 + [(text, lang or "und") for text, lang in docs[:40]]
    given = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    made = iter([True, False])
    real = phrases._words

    def clashing(seed):
        inner, clash = real(seed), next(made, False)

        def run(batches):
            import pyarrow as pa

            for batch in inner(batches):
                if clash:
                    batch = batch.set_column(0, "x", pa.array([1] * batch.num_rows, pa.int64()))
                yield batch

        return run

    monkeypatch.setattr(phrases, "_words", clashing)
    words, seed = phrases._counted_words(given)
    assert seed == 1 and words.groupBy("x").count().filter("count > 1").isEmpty()


def test_no_rows(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).collect() == []
    few = spark.createDataFrame([("a b a b", "en"), (None, None)], "text string, lang string")
    assert phrases.collocations(few).collect() == []
