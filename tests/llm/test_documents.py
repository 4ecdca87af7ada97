"""Operators on documents against plain Python on small tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from marlpit.llm import context_tree, jaccard_join, mixing, pieces, quality_classifier, quality_rules, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "river stone cloud meadow lantern copper window garden silver thunder paper candle".split()


def prose(seed, n):
    random_ = random.Random(seed)
    return " ".join(random_.choice(WORDS) + random_.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 120)
    edited = base.split()
    edited[60] = "changed"
    repeated = "same eight words are said here once more " * 6
    made = [
        (1, base), (2, base), (3, " ".join(edited)), (4, prose(2, 90)), (5, None), (6, ""), (7, " \n\t "),
        (8, "two words"), (9, "Two  words"), (10, repeated), (11, "line one\nline one\nx ## $$ |"), (12, prose(3, 3000)),
        (13, "a" * 5000), (1, base), (14, "nur vier Wörter hier"),
    ]
    return [(i, t, "en", [None, "a", "b", "c"][i % 4], None if t is None else len(t)) for i, t in made]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    """The same rows among columns that operators also make."""
    from pyspark.sql import functions as F

    names = "score size row start target taken words n host salt label ids key".split()
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


def split(text):
    return [w for w in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]


def shingles(text):
    words = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    label = [i for i, _ in sets]
    for _ in sets:
        for a, (_, x) in enumerate(sets):
            for b, (_, y) in enumerate(sets):
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    return sorted((i, len(s), c) for (i, s), c in zip(sets, label))


def test_jaccard_join(docs, clashing, rows):
    for table in (docs, clashing):
        got = jaccard_join.near_duplicates(table)
        assert sorted(map(tuple, got.collect())) == components(rows)


@pytest.mark.parametrize("in_task", [2, 4096])
def test_jaccard_join_of_many_near_copies(spark, in_task):
    random_ = random.Random(5)
    made = []
    for i in range(60):
        words = prose(i % 4, 60).split()
        for _ in range(random_.randrange(6)):
            words[random_.randrange(60)] = f"w{random_.randrange(30)}"
        made.append((i, " ".join(words), "en", "a", 0))
    got = jaccard_join.near_duplicates(spark.createDataFrame(made, SCHEMA), in_task=in_task)
    assert sorted(map(tuple, got.collect())) == components(made)


def test_region_links_connect_all_that_links():
    random_ = np.random.default_rng(3)
    base = random_.integers(0, 2**60, 40).astype(np.uint64)
    members = [np.unique(np.concatenate([base[random_.random(40) < 0.85], random_.integers(0, 2**60, 4).astype(np.uint64)])) for _ in range(40)]
    names = np.arange(40)
    links = jaccard_join.region_links(names, members, 75)
    def closed(pairs):
        label = list(range(40))
        for _ in range(40):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label
    every = [(a, b) for a in range(40) for b in range(a) if 100 * len(np.intersect1d(members[a], members[b])) >= 75 * len(np.union1d(members[a], members[b]))]
    assert closed(links) == closed(every) and all(pair in every or pair[::-1] in every for pair in links)


def repeat_words(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(8)})


def test_quality_rules(docs, clashing, rows):
    buckets = 256
    def grams(words):
        hashed = [xxhash.xxh64(w.encode(), 42).intdigest() for w in words]
        pairs = [xxhash.xxh64(b.encode(), xxhash.xxh64(a.encode(), 42).intdigest()).intdigest() for a, b in zip(words, words[1:])]
        return [(h - 2**64 if h >= 2**63 else h) % buckets for h in hashed + pairs]
    raw, target = Counter(), Counter()
    for _, text, *_ in rows:
        words, text = split(text), text or ""
        used = sum(map(len, words))
        good = (len(words) >= 50 and 3 * len(set(words)) >= len(words) and 500 * sum(c in "!#*$%&|<>" for c in text) <= used
                and 5 * sum("A" <= c <= "Z" for c in text) <= used)
        raw.update(grams(words))
        target.update(grams(words) if good else [])
    ratio = [math.log((target[b] + 1) / (sum(target.values()) + buckets)) - math.log((raw[b] + 1) / (sum(raw.values()) + buckets)) for b in range(buckets)]
    wanted = []
    for i, text, *_ in rows:
        words, found = split(text), grams(split(text))
        lines = [x for x in (text or "").split("\n") if split(x)]
        score = sum(ratio[g] for g in found) / len(found) if found else 0.0
        failed = len(words) < 20 or 100 * repeat_words(words) > 30 * len(words)
        wanted.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
                       repeat_words(words), failed, round(score, 6), not failed and score >= -0.1))
    for table in (docs, clashing):
        got = quality_rules.quality_rules(table, buckets).collect()
        assert sorted((*r[:7], round(r.score, 6), r.kept) for r in got) == sorted(wanted)


def test_mixing(spark, docs, clashing, rows):
    for table in (docs, clashing):
        got = mixing.mix(table, block=4).collect()
        sizes = Counter()
        for _, text, _, source, _ in rows:
            sizes[source] += len(split(text))
        order = sorted((s for s in sizes if s is not None)) + [None]
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        target, open_, left = {}, set(order), float(sum(sizes.values()))
        while open_:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = {s for s in open_ if share[s] > 3 * sizes[s]}
            target |= {s: 3.0 * sizes[s] for s in over} if over else share
            left -= sum(3 * sizes[s] for s in over)
            open_ = open_ - over if over else set()
        assert len(got) == len(rows)
        taken = Counter()
        for r in got:
            assert (r.source_size, round(r.target, 6)) == (sizes[r.source], round(target[r.source], 6))
            assert r.taken <= 3 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - target[s]) <= 16 for s in order)
    mixed = mixing.mixed_documents(docs, block=4)
    assert mixed.columns == docs.columns
    assert Counter(r.source for r in mixed.collect() for _ in split(r.text)) == taken


def byte_model(texts, depth):
    """Context-tree weighting by recursion over dictionaries."""
    counts = Counter()
    for text in texts:
        data = b"".join(w.encode() + b" " for w in split(text.lower())) + b"\xff"
        past = b"\xff" * depth
        for byte in data:
            for d in range(depth + 1):
                counts[past[depth - d :], byte] += 1
            past = past[1:] + bytes([byte])
    return counts


def test_context_tree(spark, docs, clashing, rows):
    training = [t or "" for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    seen = Counter(w for t in training for w in [*split("".join(c.lower() if c.isascii() else c for c in t)), ""])
    n, v = sum(seen.values()), len(seen)
    depth = 2
    counts = byte_model(training, depth)
    contexts = {c for c, _ in counts}
    lg = math.lgamma

    def bits(context, prefix):
        size = 1 << (8 - prefix[1])
        low, half = prefix[0] << (8 - prefix[1]), size // 2
        zeros = sum(counts[context, b] for b in range(low, low + half))
        return zeros, sum(counts[context, b] for b in range(low + half, low + size))

    def estimate(zeros, ones):
        return lg(zeros + 0.5) + lg(ones + 0.5) - lg(zeros + ones + 1) - math.log(math.pi)

    memo = {}
    def weighted(context, prefix):
        if (context, prefix) not in memo:
            own = estimate(*bits(context, prefix))
            if len(context) < depth:
                longer = [bytes([b]) + context for b in range(256) if bytes([b]) + context in contexts]
                own = np.logaddexp(own, sum(weighted(c, prefix) for c in longer)) - math.log(2)
            memo[context, prefix] = own
        return memo[context, prefix]

    def chance(past, prefix):
        mixed, left, last = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            context = past[depth - d :]
            if context not in contexts:
                break
            zeros, ones = bits(context, prefix)
            last = (ones + 0.5) / (zeros + ones + 1)
            share = 1.0 if d == depth else math.exp(estimate(zeros, ones) - math.log(2) - weighted(context, prefix))
            mixed, left = mixed + left * share * last, left * (1 - share)
        return min(max(mixed + left * last, 1e-6), 1 - 1e-6)

    def log10(text):
        data = b"".join(w.encode() + b" " for w in split(text.lower())) + b"\xff"
        past, total = b"\xff" * depth, 0.0
        for byte in data:
            for k in range(8):
                one = chance(past, (byte >> (8 - k), k))
                total += math.log10(one if byte >> (7 - k) & 1 else 1 - one)
            past = past[1:] + bytes([byte])
        return total

    got = context_tree.language_scores(docs, depth=depth, frequent=5).collect()
    assert len(got) == len(rows)
    by_id = {i: t or "" for i, t, *_ in rows}
    for r in got:
        words = [*split("".join(c.lower() if c.isascii() else c for c in by_id[r.doc_id])), ""]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(seen[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words))
        if len(by_id[r.doc_id]) < 400:
            assert r.score == pytest.approx(log10(by_id[r.doc_id]), rel=1e-4)
    assert context_tree.language_scores(clashing, depth=depth).count() == len(rows)
    empty = docs.filter("doc_id < 0")
    assert context_tree.language_scores(empty, depth=depth).count() == 0


def labelled(spark, toxic=False):
    random_ = random.Random(9)
    made, labels = [], []
    for i in range(300):
        bad = random_.random() < 0.4
        words = prose(i, random_.randrange(20, 80)).split()
        if bad:
            for _ in range(4):
                at = random_.randrange(len(words))
                words[at : at + 1] = ["grumble"] if toxic else ["$$$", "###", words[at], words[at]]
        made.append((i, " ".join(words), "en", "a", 0))
        labels.append((i, int(not bad), int(bad)))
    made += [(1000, None, None, None, None), (None, "", "en", "a", 0), (1001, prose(7, 4000), "en", "a", 0)]
    return spark.createDataFrame(made, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, t) for i, _, t in labels)


@pytest.mark.parametrize("toxic", [False, True])
def test_classifiers(spark, toxic):
    docs, labels, wanted = labelled(spark, toxic)
    run = toxicity.toxicity_scores if toxic else quality_classifier.quality_scores
    got = run(docs, labels).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 for r in got)
    told = [(r.predicted == 1) == (bool(wanted[r.doc_id]) == toxic) for r in got if r.held_out and r.doc_id in wanted]
    assert sum(told) / len(told) > 0.9
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert run(docs, labels.filter("doc_id < 0")).count() == 303
    assert run(docs.filter("doc_id < 0"), labels).count() == 0


def test_pieces(spark, docs, clashing, rows):
    from sentencepiece import SentencePieceProcessor

    model = pieces.read_model()
    original = SentencePieceProcessor(model_proto=model)
    got = pieces.encode(docs, model).collect()
    by_id = {i: t or "" for i, t, *_ in rows}
    assert len(got) == len(rows) and all(r.parity and r.round_trip for r in got)
    assert all(r.ids == original.encode(by_id[r.doc_id]) and r.n_tokens == len(r.ids) for r in got)
    texts = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, model), model).collect()}
    assert texts == by_id
    assert pieces.encode(clashing, model).count() == len(rows)


def test_empty_tables(docs):
    none = docs.filter("doc_id < 0")
    assert jaccard_join.near_duplicates(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert pieces.encode(none, pieces.read_model()).count() == 0
