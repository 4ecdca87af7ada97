"""Collocations by best-first branch and bound over phrase prefixes.

Words are counted first, then the pairs of words that both occur often enough. From
there phrases grow word by word: whatever begins with a phrase scores at most what its
prefix counts allow. The open phrases of highest bound are sent to the texts, which
return the counts of all their extensions to the right, which are new phrases, and to
the left, which decide with the former whether a longer phrase absorbs them. This goes
on until no open bound reaches the 2000th surviving score of its language.

Inside tasks a word is a 64-bit id. The count of words shows whether two words share
an id; if one of them is frequent, all is counted anew under another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from marlpit.llm import distinct, tokens
from marlpit.runtime import discard, stage

# What ends a piece, what parts words, and the language of none.
BREAKS = ".,;:!?\n\v\f\r"
BLANKS = " \t"
NO_LANGUAGE = "und"

TOP = 2000
LEAST = 30
LONGEST = 4
SCALE = 2_000_000
# A phrase is absorbed from this share of its count on: ABSORBED[0] / ABSORBED[1].
ABSORBED = (80, 100)
# Phrases sent to the texts at once, over all languages; the first time, fewer.
BATCH = 1 << 18
FIRST_BATCH = 2 * TOP
# Buckets of word ids; those without a frequent word are left out.
BUCKET_BITS = 22
# Rows that a task holds before it combines equal ones.
HELD = 1 << 20
SLICE_BYTES = 1 << 21
SEEDS = 8
SURVIVOR = ("lang", "phrase", "a", "l", "r", "score")


def _mask(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


BREAK = _mask(BREAKS)
APART = _mask(BREAKS + BLANKS)


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class _Slice(NamedTuple):
    """Some whole texts as words: spelled once each, their ids, and what follows what."""

    spelled: pa.Array  # distinct words
    hashes: np.ndarray  # of those
    word: np.ndarray  # which of them each word is
    lang: np.ndarray  # which language it is in
    ids: np.ndarray
    joined: np.ndarray  # whether word i and i + 1 share a piece


def _slices(batch: pa.RecordBatch, langs: list[str], salts: np.ndarray, seed: int) -> Iterator[_Slice]:
    """`langs` lists the languages seen so far, `salts` what they add to hashes."""
    of_row = np.array([langs.index(lang) for lang in batch.column("lang").to_pylist()], np.int64)
    for texts in tokens.slices(batch.column("text"), SLICE_BYTES):
        data = tokens.LOWER[texts.data]
        found = tokens.words(texts, APART)
        if not len(found.starts):
            continue
        coded = distinct.parts(data, found.starts, found.ends).dictionary_encode()
        spelled = coded.dictionary
        flat = np.frombuffer(spelled.buffers()[2], np.uint8)
        stops = np.frombuffer(spelled.buffers()[1], np.int32)[: len(spelled) + 1].astype(np.int64)
        hashes = tokens.word_hashes(flat, tokens.Words(stops[:-1], stops[1:], stops, stops), seed)
        word, lang = coded.indices.to_numpy(), of_row[texts.first + found.text]
        piece = np.searchsorted(np.flatnonzero(BREAK[data]), found.starts)
        joined = (piece[1:] == piece[:-1]) & (found.text[1:] == found.text[:-1])
        yield _Slice(spelled, hashes, word, lang, tokens.mix(hashes[word] + salts[lang]), joined)


def _pieces(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[list[str], np.ndarray, _Slice]]:
    langs, salts = [], np.zeros(0, np.uint64)
    for batch in batches:
        for lang in batch.column("lang").unique().to_pylist():
            if lang not in langs:
                langs.append(lang)
                salts = np.append(salts, _salt(lang))
        for part in _slices(batch, langs, salts, seed):
            yield langs, salts, part


def _words(seed: int):
    held = HELD // 4

    def combined(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts).group_by(["x", "lang", "word"]).aggregate([("n", "sum")])
        return table.rename_columns(["x", "lang", "word", "n"])

    def run(batches):
        parts, rows = [], 0
        for langs, salts, part in _pieces(batches, seed):
            n = np.bincount(part.word * len(langs) + part.lang)
            code = np.flatnonzero(n)
            word, lang = np.divmod(code, len(langs))
            parts.append(
                pa.table(
                    {
                        "x": tokens.signed(tokens.mix(part.hashes[word] + salts[lang])), "lang": pa.array(langs, pa.string()).take(pa.array(lang)),
                        "word": part.spelled.take(pa.array(word)).cast(pa.string()), "n": n[code].astype(np.int64),
                    }
                )
            )
            rows += len(code)
            if rows > held:
                table = combined(parts)
                parts, rows = [table], table.num_rows
                if rows > held // 2:
                    yield from table.to_batches()
                    parts, rows = [], 0
        if parts:
            yield from combined(parts).to_batches()

    return run


class _Counts:
    """Rows of ids, equal ones combined from time to time."""

    def __init__(self, names: list[str], most: int):
        self.names, self.most, self.parts, self.rows = names, most, [], 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(columns)
            self.rows += len(columns[0])

    def full(self) -> bool:
        return self.rows >= self.most

    def take(self) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        self.parts, self.rows = [], 0
        key = np.zeros(len(columns[0]), np.uint64)
        for k, column in enumerate(columns):
            key += column * tokens.GRAM[k]
        order = np.argsort(tokens.mix(key))
        columns = [c[order] for c in columns]
        new = np.zeros(len(order), bool)
        new[0] = True
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(order)))
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens.signed(c[first])) for c in columns] + [pa.array(n.astype(np.int64))], names=[*self.names, "n"]
        )


def _frequent_buckets(words: DataFrame) -> np.ndarray:
    """For each bucket of ids, packed to bits, whether it holds a frequent word."""
    bucket = F.shiftrightunsigned("x", 64 - BUCKET_BITS).cast("int").alias("bucket")
    seen = words.select(bucket).distinct().toArrow()["bucket"].to_numpy()
    marks = np.zeros(1 << BUCKET_BITS, bool)
    marks[seen] = True
    return np.packbits(marks)


def _pairs(seed: int, shared):
    shift, held = np.uint64(64 - BUCKET_BITS), HELD

    def run(batches):
        frequent = np.unpackbits(shared.value).view(bool)
        counts = _Counts(["x", "y"], held)
        for *_, part in _pieces(batches, seed):
            good = frequent[part.ids >> shift]
            at = np.flatnonzero(part.joined & good[:-1] & good[1:])
            counts.add(part.ids[at], part.ids[at + 1])
            if counts.full():
                yield counts.take()
        if counts.rows:
            yield counts.take()

    return run


class _Lookup:
    """Finds phrases of one length in a run of word ids."""

    def __init__(self, phrases: np.ndarray):
        self.size = phrases.shape[1]
        keys = self._keys([phrases[:, k] for k in range(self.size)])
        order = np.argsort(keys)
        self.keys, self.phrases = keys[order], phrases[order]
        self.marks = np.zeros(1 << BUCKET_BITS, bool)
        self.marks[keys >> np.uint64(64 - BUCKET_BITS)] = True

    @staticmethod
    def _keys(columns) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.uint64)
        for k, column in enumerate(columns):
            total += column * tokens.GRAM[k]
        return tokens.mix(total)

    def places(self, ids: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """First words of all occurrences."""
        n = len(ids) - self.size + 1
        if n <= 0 or not len(self.keys):
            return np.zeros(0, np.int64)
        whole = np.ones(n, bool)
        for k in range(self.size - 1):
            whole &= joined[k : n + k]
        at = np.flatnonzero(whole)
        keys = self._keys([ids[at + k] for k in range(self.size)])
        likely = self.marks[keys >> np.uint64(64 - BUCKET_BITS)]
        at, keys = at[likely], keys[likely]
        spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = self.keys[spot] == keys
        for k in range(self.size):
            same &= self.phrases[spot, k] == ids[at + k]
        return at[same]


def _extensions(seed: int, shared):
    """Rows (a, b, c, side, x, n): word x right (side 1) or left (2) of a phrase; c is 0 for pairs."""
    shift, held = np.uint64(64 - BUCKET_BITS), HELD

    def run(batches):
        packed, phrases = shared.value
        frequent = np.unpackbits(packed).view(bool)
        lookups = [_Lookup(p) for p in phrases if len(p)]
        counts = _Counts(["a", "b", "c", "side", "x"], held)
        for *_, part in _pieces(batches, seed):
            ids, joined = part.ids, part.joined
            good = frequent[ids >> shift]
            for lookup in lookups:
                m, at = lookup.size, lookup.places(ids, joined)
                right = at[at + m < len(ids)]
                right = right[joined[right + m - 1] & good[right + m]]
                left = at[at > 0]
                left = left[joined[left - 1] & good[left - 1]]
                for side, place, other in ((1, right, right + m), (2, left, left - 1)):
                    third = ids[place + 2] if m == 3 else np.zeros(len(place), np.uint64)
                    counts.add(ids[place], ids[place + 1], third, np.full(len(place), side, np.uint64), ids[other])
            if counts.full():
                yield counts.take()
        if counts.rows:
            yield counts.take()

    return run


def _scored(rows: DataFrame) -> DataFrame:
    """Adds score, l and r of the cut that counts, by the known sides, and the bound of all longer phrases.

    `lefts` and `rights` are the counts of the first k and of the other words for
    k = 1, 2, ...; an unknown one is null and its cut is passed over.
    """
    score = f"CAST({SCALE}BD * CAST(a AS DECIMAL(19,0)) div CAST(%s AS DECIMAL(20,0)) AS BIGINT)"
    cuts = "filter(transform(lefts, (l, i) -> struct(i + 1 AS k, l, rights[i] AS r)), c -> c.r IS NOT NULL)"
    value = F.expr(f"transform({cuts}, c -> struct({score % '(c.l + c.r)'} AS score, c.k AS k, c.l AS l, c.r AS r))")
    return (
        rows.withColumn("cut", F.array_min(value))
        .withColumn("bound", F.expr(score % "(lefts[0] + a)"))
        .select(*rows.columns, "cut.score", "cut.l", "cut.r", "bound")
    )


def _counted_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """x, lang, word, n of all words, and the seed under which frequent words have ids of their own."""
    for seed in range(SEEDS):
        rows = docs.mapInArrow(_words(seed), "x long, lang string, word string, n long")
        words = stage(rows.repartition("x").groupBy("x", "lang", "word").agg(F.sum("n").alias("n")), "words")
        twice = words.groupBy("x").agg(F.count("*").alias("of"), F.sum("n").alias("n")).filter((F.col("of") > 1) & (F.col("n") >= LEAST))
        if twice.isEmpty():
            return words, seed
        discard(words)
    raise ValueError(f"words share ids under each of {SEEDS} seeds")


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first 2000 surviving phrases.

    `docs` has text and lang; other columns are ignored. Null and empty texts have no
    words, a null lang is `und`, repeated rows count each. Equal scores are ordered by
    count, then by the bytes of the phrase. A text may be of any length. A table
    without phrases of 30 occurrences gives no rows.
    """
    given = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    words, seed = _counted_words(given)
    totals = stage(words.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("n").alias("total")), "totals")
    frequent = words.filter(F.col("n") >= LEAST).select("x", "lang", "word", F.col("n").alias("f"))
    packed = _frequent_buckets(frequent)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(packed)
    # Tasks have combined equal pairs already, so rows are dealt first and then added up once.
    pairs = stage(
        given.mapInArrow(_pairs(seed, shared), "x long, y long, n long").repartition("x", "y")
        .groupBy("x", "y").agg(F.sum("n").alias("a")).filter(F.col("a") >= LEAST),
        "pairs",
    )
    shared.destroy()
    second = frequent.select(F.col("x").alias("y"), F.col("word").alias("word2"), F.col("f").alias("f2"))
    twos = stage(
        _scored(
            pairs.join(frequent, "x").join(second, "y").select(
                "lang", F.array("x", "y").alias("words"), F.concat_ws(" ", "word", "word2").alias("phrase"), "a",
                F.array("f").alias("lefts"), F.array("f2").alias("rights"),
            )
        ),
        "phrases",
    )
    of_two = twos.select(F.col("words").alias("tail"), F.col("a").alias("of_tail"))
    state = _State(twos)
    langs, quota, tries = max(1, totals.count()), FIRST_BATCH, 0
    while True:
        batch = stage(_batch(state.open, max(1, min(quota, BATCH // langs)), tries), "batch")
        sent = [tuple(row["words"]) for row in batch.select("words").collect()]
        tries += 1
        if not sent:
            if state.open.isEmpty():
                break
            continue
        quota *= 2
        arrays = [np.array([p for p in sent if len(p) == m], np.int64).reshape(-1, m).view(np.uint64) for m in (2, 3)]
        shared = context.broadcast((packed, arrays))
        rows = given.mapInArrow(_extensions(seed, shared), "a long, b long, c long, side long, x long, n long")
        key = F.when(F.col("c") == 0, F.array("a", "b")).otherwise(F.array("a", "b", "c"))
        found = stage(
            rows.groupBy("a", "b", "c", "side", "x").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
            .select(key.alias("words"), "side", "x", "n"),
            "extensions",
        )
        shared.destroy()
        made = stage(
            found.filter("side = 1").select("words", "x", F.col("n").alias("count")).join(batch, "words")
            .join(frequent.select("x", "word", "f"), "x")
            .select(
                "lang", F.concat("words", F.array("x")).alias("words"), F.concat_ws(" ", "phrase", "word").alias("phrase"),
                F.col("count").alias("a"), F.concat("lefts", F.array("a")).alias("lefts"), "f",
            )
            .withColumn("tail", F.slice("words", -2, 2)).join(of_two, "tail").drop("tail"),
            "children",
        )
        state.extend(batch, found, made)
        discard(found, made)
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = state.above(state.survivors, "score").withColumn("rank", F.row_number().over(place).cast("long")).filter(F.col("rank") <= TOP)
    return ranked.join(totals, F.col("lang") == F.col("of_lang")).select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )


class _State:
    """What is known of phrases; each part a written table that a round replaces.

    open: phrases that may be extended, by priority. survivors: phrases that no longer
    one absorbs. waiting: phrases of four words without the count of their last three.
    floors: the 2000th surviving score of languages that have as many. What lies below
    its floor is left out; floors only rise.
    """

    def __init__(self, twos: DataFrame):
        self.twos, self.open = twos, twos.withColumn("priority", F.col("bound"))
        self.survivors = twos.limit(0).select(*SURVIVOR)
        self.floors = twos.limit(0).select(F.col("lang").alias("of_lang"), F.col("score").alias("floor"))
        self.done, self.middles, self.waiting = [], [], None

    def above(self, rows: DataFrame, value: str) -> DataFrame:
        same = F.col("lang") == F.col("of_lang")
        return rows.join(self.floors, same, "left").filter(F.col(value) >= F.coalesce("floor", F.lit(0))).drop("of_lang", "floor")

    def extend(self, batch: DataFrame, found: DataFrame, made: DataFrame) -> None:
        """Take in the extensions of a batch, and the phrases of `made`, its right ones."""
        old = [self.open, self.survivors, self.floors]
        rights = {3: F.array("of_tail", "f"), 4: F.array("of_three", "of_tail", "f")}
        threes = stage(_scored(made.filter("size(words) = 3").withColumn("rights", rights[3]).drop("of_tail", "f")), "threes")
        self.done.append(batch.select("words"))
        self.middles.append(threes.select(F.col("words").alias("last3"), F.col("a").alias("of_three")))
        known = reduce(DataFrame.unionByName, self.middles)
        four = made.filter("size(words) = 4")
        if self.waiting is not None:
            four = four.unionByName(self.waiting)
        fours = stage(
            _scored(
                four.withColumn("last3", F.slice("words", 2, 3)).join(known, "last3", "left")
                .withColumn("rights", rights[4]).drop("last3", "of_three")
            ),
            "fours",
        )
        # Absorbed: longer / a >= share / whole, for the most frequent extension by one word.
        share, whole = ABSORBED
        most = found.groupBy("words").agg(F.max("n").alias("longer"))
        extended = batch.join(most, "words", "left").filter(F.coalesce("longer", F.lit(0)) * whole < F.col("a") * share)
        self.survivors = stage(
            self.above(
                self.survivors.unionByName(extended.select(*SURVIVOR))
                .unionByName(fours.filter("rights[0] IS NOT NULL").select(*SURVIVOR)), "score",
            ),
            "survivors",
        )
        by_score = self.survivors.groupBy("lang", "score").agg(F.count("*").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score")))
        self.floors = stage(
            by_score.withColumn("so_far", so_far).filter(F.col("so_far") >= TOP)
            .groupBy(F.col("lang").alias("of_lang")).agg(F.max("score").alias("floor")),
            "floors",
        )
        self.waiting = self.above(fours.filter("rights[0] IS NULL"), "score").select(*made.columns)
        # The first two of the missing three words are to be extended, whatever their bound.
        asked = self.above(fours.filter("rights[0] IS NULL"), "score").groupBy(F.slice("words", 2, 2).alias("words")).agg(F.max("score").alias("priority"))
        left = self.open.drop("priority").join(self.done[-1], "words", "left_anti").unionByName(threes)
        left = self.above(left.withColumn("priority", F.col("bound")), "priority")
        others = self.twos.join(asked, "words").join(reduce(DataFrame.unionByName, self.done), "words", "left_anti")
        both = left.unionByName(others.select(*left.columns))
        self.open = stage(both.dropDuplicates(["words"]) if not asked.isEmpty() else both, "open")
        discard(*old)


def _batch(open_: DataFrame, quota: int, salt: int) -> DataFrame:
    """The open phrases of highest priority, about `quota` of each language.

    Whole classes of equal priority are taken while they fit; if the first does not,
    a part of it by hash, and the rest later.
    """
    classes = open_.groupBy("lang", "priority").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("priority")))
    taken = (
        classes.withColumn("so_far", so_far).filter((F.col("so_far") <= quota) | (F.col("so_far") == F.col("n")))
        .select(F.col("lang").alias("of"), F.col("priority").alias("at"), F.ceil(F.col("n") / quota).alias("parts"))
    )
    rows = open_.join(taken, (F.col("lang") == F.col("of")) & (F.col("priority") == F.col("at")))
    part = F.pmod(F.xxhash64("words", F.lit(salt)), F.col("parts"))
    return rows.filter((F.col("parts") == 1) | (part == 0)).drop("of", "at", "parts", "priority", "rights", "bound")
