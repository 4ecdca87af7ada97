"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words, each followed by a blank, then an end mark. The
eight bits of a byte are decided one after another; for every context of up to
`depth` bytes before it and every bit prefix of the byte there is a node with
Krichevsky-Trofimov counts. The weighted probability of a context is half its own
estimate and half the product of its longer contexts' (Willems, Shtarkov and
Tjalkens, 1995); the weights that follow mix the predictions of all depths into one
code length per byte.

Counts of byte runs and of words are summed over all training rows, and the tree
holds every context of theirs. Contexts of up to `CROWN` bytes, at most as many as
there are such byte strings, are weighed together; each longer one belongs to the
subtree of its nearest CROWN + 1 bytes, and subtrees are dealt over the tasks. A run
of depth + 1 bytes has one log probability, so runs are scored once each. Words and
runs are looked up in bounded tables of the most frequent ones, all others by a join
with the full tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlpit.llm import labels as labelled, tokens
from marlpit.runtime import stage

DEPTH = 5
CROWN = 2
RUNS_PER_TASK = 250_000
FREQUENT = 1 << 20
END = 0xFF  # never a byte of UTF-8; also stands before the first word
END_TOKEN = int(tokens.mix(np.array([1], np.uint64)).view(np.int64)[0])


def _normal(texts: tokens.Texts, found: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the lower-cased words with blanks and end marks, and where each text begins."""
    lengths = found.ends - found.starts
    words_before = np.arange(len(lengths))
    n = np.bincount(found.text, weights=lengths + 1, minlength=texts.count).astype(np.int64) + 1
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.full(begin[-1], 32, np.uint8)
    out[begin[1:] - 1] = END
    if len(lengths):
        at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        source = at + np.repeat(found.starts, lengths)
        # A word stands after all bytes, blanks and end marks before it.
        target = np.cumsum(lengths) - lengths + words_before + found.text
        out[at + np.repeat(target, lengths)] = tokens.LOWER[texts.data[source]]
    return out, begin


def _history(data: np.ndarray, begin: np.ndarray, depth: int) -> np.ndarray:
    """The `depth` bytes before each byte as one number, the nearest lowest; END before a text."""
    context = np.zeros(len(data), np.int64)
    place = np.arange(len(data)) - np.repeat(begin[:-1], np.diff(begin))
    for k in range(1, depth + 1):
        before = np.full(len(data), END, np.int64)
        before[k:] = data[:-k] if k < len(data) + 1 else before[k:]
        before[place < k] = END
        context |= before << (8 * (k - 1))
    return context


def _runs(data: np.ndarray, begin: np.ndarray, depth: int) -> np.ndarray:
    """Each byte above the `depth` bytes before it."""
    return _history(data, begin, depth) | data.astype(np.int64) << (8 * depth)


def _sums(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def corpus_counts(docs: DataFrame, depth: int) -> DataFrame:
    """kind ('w' words, 'b' runs of depth + 1 bytes), key, and counts: n over the training
    rows of `docs` (text, held_out), met over all. Words are those of training rows."""

    def count(batches):
        kept = {"w": [], "b": []}
        held = 0
        for batch in batches:
            out = batch.column("held_out").to_numpy(zero_copy_only=False)
            for texts in tokens.slices(batch.column("text")):
                found = tokens.words(texts)
                hashes = tokens.signed(tokens.word_hashes(tokens.LOWER[texts.data], found))
                data, begin = _normal(texts, found)
                left_out = out[texts.first : texts.first + texts.count]
                kept["w"].append(_sums(np.append(hashes[~left_out[found.text]], np.full((~left_out).sum(), END_TOKEN))))
                # The lowest bit says whether the text is held out.
                kept["b"].append(_sums(_runs(data, begin, depth) << 1 | np.repeat(left_out, np.diff(begin))))
                held += sum(len(parts[-1][0]) for parts in kept.values())
                if held > 2_000_000:  # what was met so far is summed, then handed on if still large
                    kept = {kind: [_merge(parts)] for kind, parts in kept.items()}
                    held = sum(len(parts[0][0]) for parts in kept.values())
                    if held > 1_000_000:
                        yield from rows(kept)
                        kept, held = {"w": [], "b": []}, 0
        yield from rows({kind: [_merge(parts)] for kind, parts in kept.items() if parts})

    def rows(kept):
        for kind, parts in kept.items():
            for keys, met in parts:
                n = met if kind == "w" else met * (1 - (keys & 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(keys)), pa.array(keys if kind == "w" else keys >> 1), pa.array(n, pa.int64()), pa.array(met, pa.int64())],
                    names=["kind", "key", "n", "met"],
                )

    counted = docs.select("text", "held_out").mapInArrow(count, "kind string, key long, n long, met long")
    return stage(counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("met").alias("met")), "counts")


class Level:
    """Nodes of the contexts of one length that training met: sorted codes (context and
    bit prefix), counts of zeros and ones, and the sums of the longer contexts' weighted logs."""

    def __init__(self, codes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.codes, at = np.unique(codes, return_inverse=True)
        self.zeros, self.ones = (np.bincount(at, x, len(self.codes)) for x in (zeros, ones))
        estimate = _log_kt(self.zeros, self.ones)
        self.kt = (self.ones + 0.5) / (self.zeros + self.ones + 1.0)
        if below is None:
            self.weighted, self.share = estimate, np.ones_like(estimate)
        else:
            self.weighted = np.logaddexp(estimate, np.bincount(at, below, len(self.codes))) - np.log(2)
            self.share = np.exp(estimate - np.log(2) - self.weighted)

    @classmethod
    def of(cls, arrays: dict) -> Level:
        """A level from its `vars`."""
        level = cls.__new__(cls)
        level.__dict__.update(arrays)
        return level

    def shorter(self, d: int) -> np.ndarray:
        """Codes of the same prefixes after the d nearest bytes."""
        return (self.codes >> 8 & ((1 << 8 * d) - 1)) << 8 | self.codes & 255

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return at, self.codes[at] == codes

    def mix(self, before: np.ndarray, remaining: np.ndarray) -> None:
        """The mixture of the depths so far, and the weight that is left for longer contexts."""
        self.mixed, self.left = before + remaining * self.share * self.kt, remaining * (1 - self.share)


def leaves(keys: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, zeros and ones of the eight bit prefixes of each run."""
    context, byte = keys & ((1 << 8 * depth) - 1), keys >> (8 * depth)
    codes = np.concatenate([context << 8 | 1 << k | byte >> (8 - k) for k in range(8)])
    ones, n = np.concatenate([byte >> (7 - k) & 1 for k in range(8)]), np.tile(n, 8)
    return codes, n * (1 - ones), n * ones


def grow(codes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None, top: int, bottom: int) -> dict[int, Level]:
    """The levels of `top` to `bottom` bytes, weighed from the longest contexts up."""
    levels = {}
    for d in range(bottom, top - 1, -1):
        levels[d] = level = Level(codes, zeros, ones, below)
        codes, zeros, ones, below = level.shorter(d - 1) if d else None, level.zeros, level.ones, level.weighted
    return levels


def spread_down(levels: dict[int, Level], top: int, bottom: int) -> None:
    """Mix the levels of `top` to `bottom` bytes; the one above `top` is mixed already."""
    for d in range(top, bottom + 1):
        if not d:
            levels[d].mix(np.zeros(len(levels[d].codes)), np.ones(len(levels[d].codes)))
        else:
            at, _ = levels[d - 1].find(levels[d].shorter(d - 1))
            levels[d].mix(levels[d - 1].mixed[at], levels[d - 1].left[at])


def run_logs(keys: np.ndarray, levels: dict[int, Level], depth: int) -> np.ndarray:
    """Log10 probability of the last byte of each run, whether training met the run or not."""
    byte, total, known = keys >> (8 * depth), np.zeros(len(keys)), None
    for k in range(8):
        mixed, left, last = np.zeros(len(keys)), np.ones(len(keys)), np.full(len(keys), 0.5)
        deepest, todo = np.full(len(keys), -1), np.arange(len(keys))
        for d in range(depth, -1, -1):
            at, hit = levels[d].find((keys[todo] & ((1 << 8 * d) - 1)) << 8 | 1 << k | byte[todo] >> (8 - k))
            at, found = at[hit], todo[hit]
            mixed[found], left[found], last[found], deepest[found] = levels[d].mixed[at], levels[d].left[at], levels[d].kt[at], d
            todo = todo[~hit]
        known = deepest if known is None else known  # the longest context met
        # Longer contexts that never met this prefix give even chances; where none is, the last estimate stands.
        one = np.clip(mixed + left * np.where(known > deepest, 0.5, last), 1e-6, 1 - 1e-6)
        total += np.log10(np.where(byte >> (7 - k) & 1, one, 1 - one))
    return total


def log_table(counts: DataFrame, depth: int) -> DataFrame:
    """key, log and met of every run of `counts`."""
    runs = counts.filter("kind = 'b'").select("key", "n", "met")
    tasks = max(1, -(-runs.count() // RUNS_PER_TASK))
    top = min(CROWN, depth)
    subtree = F.col("key").bitwiseAND(F.lit((1 << 8 * (top + 1)) - 1 if top < depth else (1 << 8 * (depth + 1)) - 1))
    dealt = runs.withColumn("subtree", subtree).repartition(tasks, "subtree").drop("subtree")

    def together(batches):
        parts = list(batches)
        if not parts:
            return None
        return [np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(3)]

    def subtrees(keys, n):
        met = n > 0
        return grow(*leaves(keys[met], n[met], depth), None, top + 1, depth)

    def upward(batches):
        given = together(batches)
        if given is None:
            return
        keys, n, _ = given
        if top < depth:
            level = subtrees(keys, n)[top + 1]
            codes, zeros, ones, below = level.shorter(top), level.zeros, level.ones, level.weighted
        else:
            codes, zeros, ones = leaves(keys[n > 0], n[n > 0], depth)
            below = np.zeros(len(codes))
        distinct, at = np.unique(codes, return_inverse=True)
        sums = [pa.array(np.bincount(at, x, len(distinct))) for x in (zeros, ones, below)]
        yield pa.RecordBatch.from_arrays([pa.array(distinct), *sums], names=["code", "zeros", "ones", "below"])

    # At most 255 nodes for each string of CROWN bytes.
    summed = (
        dealt.mapInArrow(upward, "code long, zeros double, ones double, below double").groupBy("code")
        .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
    )
    codes, zeros, ones, below = (summed.column(i).to_numpy() for i in range(4))
    levels = grow(codes, zeros, ones, below if top < depth else None, 0, top)
    spread_down(levels, 0, top)
    # As plain arrays: executors need no copy of this package to read them.
    crown = counts.sparkSession.sparkContext.broadcast({d: vars(level) for d, level in levels.items()})

    def downward(batches):
        given = together(batches)
        if given is None:
            return
        keys, n, met = given
        levels = {d: Level.of(arrays) for d, arrays in crown.value.items()} | (subtrees(keys, n) if top < depth else {})
        spread_down(levels, top + 1, depth)
        logs = run_logs(keys, levels, depth)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(logs), pa.array(met)], names=["key", "log", "met"])

    return stage(dealt.mapInArrow(downward, "key long, log double, met long"), "logs")


class Lookup:
    """A hash table of arrays; keys that find their place taken go to the next, smaller one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        """Keys are not negative; of those that meet, the last is found first."""
        self.tables = []
        while len(keys):
            bits = (2 * len(keys)).bit_length()
            own, slots = np.full(1 << bits, -1, np.int64), self._slots(keys, bits)
            own[slots] = keys
            placed = own[slots] == keys
            value = np.zeros(1 << bits)
            value[slots[placed]] = values[placed]
            self.tables.append((bits, own, value))
            keys, values = keys[~placed], values[~placed]

    def _slots(self, keys: np.ndarray, bits: int, nth: int | None = None) -> np.ndarray:
        salt = np.uint64(len(self.tables) if nth is None else nth) << np.uint64(56)
        return (tokens.mix(keys.view(np.uint64) ^ salt) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of `keys`, 0 for those that are not there, and the places of these."""
        out, todo = np.zeros(len(keys)), np.arange(len(keys))
        for nth, (bits, own, value) in enumerate(self.tables):
            wanted = keys[todo] if nth else keys
            slots = self._slots(wanted, bits, nth)
            hit = own[slots] == wanted
            out[todo[hit]] = value[slots[hit]]
            todo = todo[~hit]
        return out, todo


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones, some rows at a time."""
    out = np.empty_like(zeros)
    for at in range(0, len(zeros), 1024):
        a, b = zeros[at : at + 1024], ones[at : at + 1024]
        out[at : at + 1024] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving small arguments up by eight."""
    shift = np.where(x < 8, 8, 0)
    product = np.ones_like(x)
    for k in range(8):
        product = np.where(shift > 0, product * (x + k), product)
    y = x + shift
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def frequent_keys(table: DataFrame, count: str, value: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of all rows above the count that at most `most` rows reach, rarest first."""
    # The histogram has at most as many rows as there are different counts.
    sizes = table.select(F.least(count, F.lit(1 << 16)).alias("n")).groupBy("n").count().orderBy(F.desc("n")).collect()
    total, least = 0, 1 << 62
    for n, many in sizes:
        total += many
        if total > most:
            break
        least = n
    kept = table.filter(F.col(count) >= least).select("key", F.col(value).alias("v"), F.col(count).alias("n")).toArrow()
    order = np.argsort(kept.column("n").to_numpy(), kind="stable")
    return kept.column("key").to_numpy()[order], kept.column("v").to_numpy()[order]


def language_scores(docs: DataFrame, depth: int = DEPTH, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bytes, bits_per_byte.

    Rows whose crc32(doc_id) mod 7 is 2 are held out of training. Null, empty and
    blank texts are the end mark alone. Repeated rows give a row each; ids may
    repeat or be null (never held out); other columns are ignored. With nothing to
    learn from, base counts are 0 and every bit costs one bit.
    """
    given = docs.select("doc_id", "text", labelled.held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    counts = corpus_counts(given, depth)
    words = counts.filter("kind = 'w'")
    runs = log_table(counts, depth)
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    spark = docs.sparkSession
    keys, seen = frequent_keys(words, "n", "n", frequent)
    order = np.argsort(keys)
    model = spark.sparkContext.broadcast((keys[order], seen[order], *frequent_keys(runs, "met", "log", frequent)))

    def run(batches):
        keys, seen, *common = model.value
        logs_of = Lookup(*common)
        for batch in batches:
            for texts in tokens.slices(batch.column("text")):
                found = tokens.words(texts)
                hashes = np.append(tokens.signed(tokens.word_hashes(tokens.LOWER[texts.data], found)), np.full(texts.count, END_TOKEN))
                owner = np.append(found.text, np.arange(texts.count))
                data, begin = _normal(texts, found)
                at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
                hit = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
                logs = np.log10((seen[at] if len(keys) else np.zeros(len(hashes))) * hit + 1.0)
                rare = np.flatnonzero(~hit)
                rare = rare[np.argsort(owner[rare], kind="stable")]
                many = np.bincount(owner[rare], minlength=texts.count)
                run_keys = _runs(data, begin, depth)
                each, deep = logs_of.find(run_keys)
                deep_many = np.diff(np.searchsorted(deep, begin))
                part = batch.slice(texts.first, texts.count).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array(np.bincount(owner, minlength=texts.count).astype(np.int64)),
                        pa.array(np.bincount(owner[hit], minlength=texts.count).astype(np.int64)),
                        pa.array(np.bincount(owner, weights=logs * hit, minlength=texts.count)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(hashes[rare])),
                        pa.array(np.add.reduceat(each, begin[:-1])),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(deep_many)]), pa.int32()), pa.array(run_keys[deep])),
                        pa.array(np.diff(begin).astype(np.int64)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "common", "logs", "rare", "met_logs", "deep", "bytes"],
                )

    schema = (
        f"doc_id {given.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, common long, "
        "logs double, rare array<long>, met_logs double, deep array<long>, bytes long"
    )
    scored = stage(given.select("doc_id", "held_out", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    words = words.select("key", F.col("n").alias("c"))
    found = (
        scored.filter(F.size("rare") > 0).select("row", F.explode("rare").alias("key"))
        .join(words, "key").groupBy("row")
        .agg(F.count("*").alias("known"), F.sum(F.log10(F.col("c") + 1.0)).alias("more"))
    )
    # A run that repeats within a text is looked up once.
    rest = (
        scored.filter(F.size("deep") > 0).select("row", F.explode("deep").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
        .join(runs.select("key", "log"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("deeper"))
    )
    score = F.col("met_logs") + F.coalesce("deeper", F.lit(0.0))
    base = F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return scored.join(found, "row", "left").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("common") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), "bytes",
        (score * -F.log2(F.lit(10.0)) / F.col("bytes")).alias("bits_per_byte"),
    )
