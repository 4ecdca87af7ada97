"""Quality classifier: averaged subword embeddings with a softmax, trained by numpy SGD.

Words, pairs of words and character n-grams are hashed into one table of learned
vectors. A document is the mean of the vectors of all its n-grams; a softmax over
two classes follows. N-grams that repeat within a document also count for one
learned vector of their own, since a mean cannot tell repetition from variety.

The softmax of two classes depends on the difference of their outputs only, and
the mean is linear: for scoring, the table is multiplied by that difference once,
and each n-gram adds a single number.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlpit.llm import labels as labelled, tokens

TABLE = 1 << 18
SIZE = 8
CHARACTERS = (3, 5)
PER_CLASS = 2000
MAX_BYTES = 1 << 15
EPOCHS = 6
CHUNK = 256
RATE = 0.5
CHARACTER_VALUES = np.random.default_rng(17).integers(0, 2**32, (max(CHARACTERS), 256), dtype=np.uint64).astype(np.uint32)


class Grams(NamedTuple):
    """Table rows of n-grams, the text of each, and repeated pairs by text."""

    rows: list[np.ndarray]
    texts: list[np.ndarray]
    repeats: np.ndarray
    totals: np.ndarray


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (tokens.mix(hashes) >> np.uint64(46)).astype(np.int32)


def grams(texts: tokens.Texts) -> Grams:
    found = tokens.words(texts)
    hashes = tokens.word_hashes(texts.data, found)
    rows, owners = [_bucket(hashes)], [found.text]
    repeats = np.zeros(texts.count, np.int64)
    if len(hashes) > 1:
        pairs = hashes[:-1] * tokens.GRAM[0] + hashes[1:] * tokens.GRAM[1]
        inside = found.text[:-1] == found.text[1:]
        pairs, owner = pairs[inside], found.text[:-1][inside]
        rows.append(_bucket(pairs))
        owners.append(owner)
        own = tokens.mix(pairs) + owner.astype(np.uint64) * tokens.ODD
        _, first = np.unique(own, return_index=True)
        repeats = np.bincount(owner, minlength=texts.count) - np.bincount(owner[first], minlength=texts.count)
    data = np.where(tokens.SPACE[texts.data], 32, texts.data)
    for size in CHARACTERS:
        if len(data) < size:
            continue
        mixed = CHARACTER_VALUES[0][data[: len(data) - size + 1]].copy()
        for k in range(1, size):
            mixed += CHARACTER_VALUES[k][data[k : len(data) - size + 1 + k]]
        mixed *= np.uint32(2654435761)
        # Runs of bytes across two texts belong to neither.
        begin = texts.offsets[:-1]
        counts = np.maximum(np.diff(texts.offsets) - size + 1, 0)
        at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        rows.append((mixed[at] >> np.uint32(14)).astype(np.int32))
        owners.append(np.repeat(np.arange(texts.count), counts))
    totals = sum(np.bincount(o, minlength=texts.count) for o in owners)
    return Grams(rows, owners, repeats, totals + repeats)


class Model(NamedTuple):
    values: np.ndarray  # what each n-gram adds to the difference of the outputs
    repeat: float
    bias: float


def score(model: Model, texts: tokens.Texts) -> np.ndarray:
    """Probability of label 1 for each text; an empty text has the bias alone."""
    found = grams(texts)
    total = found.repeats * model.repeat
    for rows, owner in zip(found.rows, found.texts):
        total = total + np.bincount(owner, weights=model.values[rows], minlength=texts.count)
    mean = total / np.maximum(found.totals, 1)
    return 1 / (1 + np.exp(-(mean + model.bias)))


def _bags(rows: list[tuple[str, int]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Table rows, their shares, and the label of each text; views of a few large arrays."""
    bags = []
    for first in range(0, len(rows), CHUNK):
        ids, shares = [], []
        for text, _ in rows[first : first + CHUNK]:
            (texts,) = tokens.slices(pa.array([text], pa.large_string()), max(1, 1 << 30))
            found = grams(texts)
            own, counts = np.unique(np.concatenate(found.rows), return_counts=True)
            counts = np.append(counts, found.repeats[0])
            ids.append(np.append(own, TABLE).astype(np.int32))
            shares.append((counts / max(1, found.totals[0])).astype(np.float32))
        ends = np.cumsum([len(x) for x in ids])[:-1]
        parts = zip(np.split(np.concatenate(ids), ends), np.split(np.concatenate(shares), ends))
        bags += [(i, s, label) for (i, s), (_, label) in zip(parts, rows[first:])]
    return bags


def train(rows: list[tuple[str, int]], seed: int = 5) -> Model:
    """Learn vectors and softmax from (text, label) rows by plain SGD, one row at a time."""
    if not rows:
        return Model(np.zeros(TABLE), 0.0, 0.0)
    bags = _bags(rows)
    random = np.random.default_rng(seed)
    table = (random.random((TABLE + 1, SIZE), np.float32) - 0.5) / SIZE
    outputs = np.zeros((2, SIZE), np.float32)
    outputs[1] = random.normal(0, 0.5, SIZE)
    outputs[0] = -outputs[1]
    bias = np.zeros(2, np.float32)
    ones = sum(label for *_, label in bags)
    if ones in (0, len(bags)):  # one class only: its share, smoothed
        return Model(np.zeros(TABLE), 0.0, float(np.log((ones + 1) / (len(bags) - ones + 1))))
    steps, step = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(bags)):
            ids, share, label = bags[i]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = share @ table[ids]
            logits = outputs @ hidden + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[label] -= 1
            back = chance @ outputs
            outputs -= rate * np.outer(chance, hidden)
            bias -= 0.1 * rate * chance
            table[ids] -= (rate * 20) * share[:, None] * back
    values = table @ (outputs[1] - outputs[0])
    return Model(values[:TABLE].astype(np.float64), float(values[TABLE]), float(bias[1] - bias[0]))


def quality_scores(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, carry: tuple = ()
) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns in `carry`, a row for each row of `docs`.

    Learns from a bounded sample of labelled rows that are not held out (see
    `labels.sample`) and scores every whole text. Null and empty texts get the
    score of a text without n-grams. Without labelled rows every score is 0.5.
    Repeated rows score alike; other columns are ignored.
    """
    learned = train(labelled.sample(docs, labels, "quality", per_class, max_bytes))
    # As a plain tuple: executors need no copy of this package to read it.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(learned))

    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            for texts in tokens.slices(batch.column("text")):
                part = batch.slice(texts.first, texts.count).drop_columns(["text"])
                yield part.append_column("score", pa.array(score(model, texts)))

    given = docs.select("doc_id", labelled.held_out(F.col("doc_id"), 3, 1).alias("held_out"), *carry, "text")
    schema = given.drop("text").schema.add("score", "double")
    return given.mapInArrow(run, schema).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *carry
    )
