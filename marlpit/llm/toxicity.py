"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A window of words is read in both directions by gated recurrent units; attention
pools the states, a logistic output follows. A word enters as a learned vector of
its hash and the mean of learned vectors of its character trigrams. Every text is
scored over all its overlapping windows: the odds of its worst window and the number
of toxic windows together decide, by a logistic output that is learned last, since a
word that is harmless once may be toxic when it goes on.

Labels belong to whole texts, so training alternates: the network learns on
windows, then the windows it finds most toxic in a toxic text stand for it. Each toxic
text keeps some; those that are missed are drawn more often.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlpit.llm import labels as labelled, tokens

WINDOW = 24
STRIDE = 12
UNITS = 8
WORD_ROWS, WORD_SIZE = 1 << 14, 6
CHAR_ROWS, CHAR_SIZE = 1 << 12, 10
INPUT = WORD_SIZE + CHAR_SIZE
PER_CLASS = 1500
MAX_BYTES = 1 << 13
AT_ONCE = 2048  # windows that go through the network together
THRESHOLD = 0.7
ROUNDS = 13
CLIP = 8.0  # odds beyond count as this
CLOSE = (0.3, 0.9)  # scores between which every word begins a window
NEAR = 3.0  # windows of a toxic text within so much of its worst stand for it
BALANCE = 2.0  # weight of the clean rows where the pooling is fitted; the toxic ones have 0.5


def _separators() -> np.ndarray:
    """All bytes but ASCII letters, digits and those of other scripts."""
    table = np.ones(256, bool)
    for first, last in ((48, 57), (65, 90), (97, 122), (128, 255)):
        table[first : last + 1] = False
    return table


SEPARATORS = _separators()


class Vocabulary:
    """The distinct words of some texts: word row, and character rows with their owners."""

    def __init__(self, texts: tokens.Texts):
        data = tokens.LOWER[texts.data]
        found = tokens.words(texts, SEPARATORS)
        hashes = tokens.word_hashes(data, found)
        distinct, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.bounds = found.bounds
        self.rows = (distinct >> np.uint64(50)).astype(np.int32)
        starts, ends = found.starts[first], found.ends[first]
        # Trigrams of the word between two marks.
        counts = np.maximum(ends - starts, 1)
        owner = np.repeat(np.arange(len(first)), counts)
        at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
        edge = np.concatenate([data, [0]]).astype(np.uint64)
        before = np.where(at == starts[owner], 1, edge[at - 1])
        after = np.where(at + 1 >= ends[owner], 2, edge[np.minimum(at + 1, len(data))])
        grams = before + (edge[at] << np.uint64(8)) + (after << np.uint64(16))
        self.chars = (tokens.mix(grams) >> np.uint64(52)).astype(np.int32)
        self.owner, self.counts = owner, counts

    def windows(self, texts: np.ndarray | None = None, stride: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all windows (-1 beyond a text's end) of some texts, by default
        of all, and which of these texts each window is of."""
        stride, texts = stride or STRIDE, np.arange(len(self.bounds) - 1) if texts is None else texts
        begin = self.bounds[:-1][texts]
        lengths = self.bounds[1:][texts] - begin
        each = np.maximum(1, -(-(lengths - WINDOW) // stride) + 1)
        text = np.repeat(np.arange(len(lengths)), each)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
        place = (nth * stride)[:, None] + np.arange(WINDOW)
        inside = place < lengths[text][:, None]
        at = np.where(inside, begin[text][:, None] + place, 0)
        if not len(self.word):
            return np.full(at.shape, -1), text
        return np.where(inside, self.word[at], -1), text


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def fresh(seed: int = 3) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    shape = {"word": (WORD_ROWS, WORD_SIZE), "char": (CHAR_ROWS, CHAR_SIZE), "out": (2 * UNITS,), "attend": (2 * UNITS,)}
    for side in "fb":
        shape |= {f"x{side}": (INPUT, 3 * UNITS), f"h{side}": (UNITS, 3 * UNITS), f"c{side}": (3 * UNITS,)}
    scale = {"word": 0.3, "char": 0.6, "out": 0.5, "attend": 0.5, "xf": 0.35, "xb": 0.35, "hf": 0.35, "hb": 0.35, "cf": 0, "cb": 0}
    net = {k: (random.normal(0, 1, v) * scale[k]).astype(np.float32) for k, v in shape.items()}
    return net | {"bias": np.full(1, -1.0, np.float32)}


def inputs(net: dict, words: Vocabulary) -> np.ndarray:
    """Input vectors of the distinct words; one more row of zeros stands for no word."""
    x = np.zeros((len(words.rows) + 1, INPUT), np.float32)
    if len(words.rows):
        x[:-1, :WORD_SIZE] = net["word"][words.rows]
        sums = np.add.reduceat(net["char"][words.chars], np.cumsum(words.counts) - words.counts)
        x[:-1, WORD_SIZE:] = sums / words.counts[:, None]
    return x


def forward(net: dict, x: np.ndarray, windows: np.ndarray, keep: bool = False):
    """Log odds of each window; with `keep` also what the backward pass needs."""
    n = len(windows)
    states, saved = np.zeros((WINDOW, n, 2 * UNITS), np.float32), {}
    for side, steps in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
        gates = x @ net[f"x{side}"] + net[f"c{side}"]
        h = np.zeros((n, UNITS), np.float32)
        place = slice(0, UNITS) if side == "f" else slice(UNITS, 2 * UNITS)
        for t in steps:
            ids = windows[:, t]
            a = gates[ids]
            r = h @ net[f"h{side}"]
            zr = _sigmoid(a[:, : 2 * UNITS] + r[:, : 2 * UNITS])
            z, q = zr[:, :UNITS], zr[:, UNITS:]
            new = np.tanh(a[:, 2 * UNITS :] + q * r[:, 2 * UNITS :])
            live = (ids >= 0)[:, None]
            after = np.where(live, h + z * (new - h), h)
            if keep:
                saved[side, t] = (h, z, q, new, r[:, 2 * UNITS :], live)
            h = after
            states[t, :, place] = h
    energy = np.where(windows.T >= 0, states @ net["attend"], -30)
    weight = np.exp(energy - energy.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    return pooled @ net["out"] + net["bias"][0], (states, weight, pooled, saved) if keep else None


def gradients(net: dict, x: np.ndarray, windows: np.ndarray, labels: np.ndarray) -> tuple[dict, np.ndarray]:
    """Mean gradients of the log loss for the weights, and for the rows of `x`."""
    logit, (states, weight, pooled, saved) = forward(net, x, windows, keep=True)
    n = len(windows)
    d = ((_sigmoid(logit) - labels) / n).astype(np.float32)
    grad = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
    d_pooled = d[:, None] * net["out"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = (states * d_pooled).sum(axis=2)
    d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0)) * (windows.T >= 0)
    grad["attend"] = np.einsum("tn,tnu->u", d_energy, states)
    d_states += d_energy[:, :, None] * net["attend"]
    d_x = np.zeros_like(x)
    for side, steps in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
        place = slice(0, UNITS) if side == "f" else slice(UNITS, 2 * UNITS)
        d_gates = np.zeros((len(x), 3 * UNITS), np.float32)
        d_rec = np.zeros_like(net[f"h{side}"])
        d_h = np.zeros((n, UNITS), np.float32)
        for t in steps:
            h, z, q, new, r_new, live = saved[side, t]
            d_h = d_h + d_states[t, :, place]
            d_after = np.where(live, d_h, 0)
            d_new = d_after * z * (1 - new**2)
            d_z = d_after * (new - h) * z * (1 - z)
            d_q = d_new * r_new * q * (1 - q)
            a = np.concatenate([d_z, d_q, d_new], axis=1)
            r = np.concatenate([d_z, d_q, d_new * q], axis=1)
            np.add.at(d_gates, windows[:, t], a)
            d_rec += h.T @ r
            d_h = np.where(live, d_after * (1 - z), d_h) + r @ net[f"h{side}"].T
        d_gates[-1] = 0
        grad[f"x{side}"], grad[f"h{side}"], grad[f"c{side}"] = x.T @ d_gates, d_rec, d_gates.sum(axis=0)
        d_x += d_gates @ net[f"x{side}"].T
    return grad, d_x


class Trainer:
    """Adam over the weights and, by rows that occur, over the two tables."""

    def __init__(self, net: dict, rate: float = 0.01):
        self.net, self.rate, self.step = net, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in net.items()}
        self.second = {k: np.zeros_like(v) for k, v in net.items()}

    def update(self, name: str, grad: np.ndarray, rows=slice(None)) -> None:
        first = self.first[name][rows] = 0.9 * self.first[name][rows] + 0.1 * grad
        second = self.second[name][rows] = 0.99 * self.second[name][rows] + 0.01 * grad**2
        first, second = first / (1 - 0.9**self.step), second / (1 - 0.99**self.step)
        self.net[name][rows] -= self.rate * first / (np.sqrt(second) + 1e-6)

    def learn(self, words: Vocabulary, windows: np.ndarray, labels: np.ndarray) -> None:
        used, local = np.unique(windows, return_inverse=True)
        used = used[used >= 0]
        lower = len(np.unique(windows)) - len(used)  # 1 where some places hold no word
        local = local.reshape(windows.shape) - lower
        part = Vocabulary.__new__(Vocabulary)
        begin = np.cumsum(words.counts) - words.counts
        part.rows, part.counts = words.rows[used], words.counts[used]
        at = np.repeat(begin[used] - (np.cumsum(part.counts) - part.counts), part.counts) + np.arange(int(part.counts.sum()))
        part.chars = words.chars[at]
        grad, d_x = gradients(self.net, inputs(self.net, part), local, labels)
        self.step += 1
        for name, value in grad.items():
            self.update(name, value)
        for name, rows, values in (
            ("word", part.rows, d_x[:-1, :WORD_SIZE]),
            ("char", part.chars, np.repeat(d_x[:-1, WORD_SIZE:] / part.counts[:, None], part.counts, axis=0)),
        ):
            distinct, back = np.unique(rows, return_inverse=True)
            total = np.zeros((len(distinct), values.shape[1]), np.float32)
            np.add.at(total, back, values)
            self.update(name, total, distinct)


def window_odds(net: dict, words: Vocabulary, windows: np.ndarray) -> np.ndarray:
    x = inputs(net, words)
    parts = [forward(net, x, windows[i : i + AT_ONCE])[0] for i in range(0, len(windows), AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def _pool(odds: np.ndarray, text: np.ndarray, texts: int, stride: int | None = None) -> np.ndarray:
    """Of each text: the highest odds, and the logarithm of how many windows apart are toxic."""
    first = np.searchsorted(text, np.arange(texts))
    worst = np.maximum.reduceat(odds, first).astype(np.float64)
    many = np.add.reduceat(_sigmoid(odds.astype(np.float64)), first) * (stride or STRIDE) / WINDOW
    return np.stack([np.clip(worst, -CLIP, CLIP), np.log(many + 0.01)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 0.05) -> np.ndarray:
    """Weights and bias, both classes weighing alike, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), BALANCE / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (share * (p - y)) + ridge * 0.01 * np.append(w[:-1], 0)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 1e-3
        w -= np.clip(np.linalg.solve(curve, gradient), -1, 1)
    return w


def train(rows: list[tuple[str, int]], rounds: int | None = None, batch: int = 256, seed: int = 3) -> dict | None:
    """Weights from (text, label) rows; None where one class is missing.

    The pooling is fitted on every third row by a network that learned from the others.
    """
    if len({label for _, label in rows}) < 2:
        return None
    rounds, third = rounds or ROUNDS, np.arange(len(rows)) % 3 == 0
    parts = [[row for row, t in zip(rows, third) if t == side] for side in (False, True)]
    net = _train_windows(rows, rounds, batch, seed)
    pool = None
    if all(len({label for _, label in part}) == 2 for part in parts):
        other = _train_windows(parts[0], rounds, batch, seed)
        pool = _logistic(_features(other, parts[1]), np.array([y for _, y in parts[1]]))
    if pool is None:
        pool = _logistic(_features(net, rows), np.array([y for _, y in rows]))
    return net | {"pool": pool}


def _prepared(rows: list[tuple[str, int]]):
    (texts,) = tokens.slices(pa.array([text for text, _ in rows], pa.large_string()), 1 << 40)
    words = Vocabulary(texts)
    return words, *words.windows()


def text_scores(net: dict, words: Vocabulary) -> np.ndarray:
    """The toxicity of each text.

    Windows begin at every `STRIDE`-th word, and at every word of the texts whose score
    then lies between the bounds of `CLOSE`.
    """
    count = len(words.bounds) - 1
    pool = net["pool"]
    windows, text = words.windows()
    scores = _sigmoid(_pool(window_odds(net, words, windows), text, count) @ pool[:-1] + pool[-1])
    close = np.flatnonzero((scores > CLOSE[0]) & (scores < CLOSE[1]))
    if len(close):
        windows, text = words.windows(close, 1)
        scores[close] = _sigmoid(_pool(window_odds(net, words, windows), text, len(close), 1) @ pool[:-1] + pool[-1])
    return scores


def _features(net: dict, rows: list[tuple[str, int]]) -> np.ndarray:
    words, windows, text = _prepared(rows)
    return _pool(window_odds(net, words, windows), text, len(rows))


def _train_windows(rows: list[tuple[str, int]], rounds: int, batch: int, seed: int) -> dict:
    words, windows, text = _prepared(rows)
    label = np.array([y for _, y in rows])
    random = np.random.default_rng(seed)
    net = fresh(seed)
    trainer = Trainer(net)
    zeros, toxic = np.flatnonzero(label[text] == 0), np.flatnonzero(label == 1)
    first = np.searchsorted(text, np.arange(len(rows) + 1))
    chance, odds = np.full(len(toxic), 1 / len(toxic)), None
    for turn in range(rounds):
        size = 4000 if turn == 0 else 2500
        # A toxic text, then one of its windows: any at first, later one near its worst.
        drawn = random.choice(toxic, size, p=chance)
        if odds is None:
            ones = first[drawn] + (random.random(size) * (first[drawn + 1] - first[drawn])).astype(np.int64)
        else:
            ones = np.array([random.choice(near[t]) for t in drawn])
        chosen = [ones, random.choice(zeros, 2 * size)]
        if turn:  # with the clean windows that look worst
            chosen.append(zeros[np.argsort(-odds[zeros], kind="stable")[: size // 2]])
        chosen = np.concatenate(chosen)
        wanted = label[text[chosen]].astype(np.float32)
        trainer.rate = 0.02 if turn < rounds // 2 else 0.006
        order = random.permutation(len(chosen))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            trainer.learn(words, windows[chosen[part]], wanted[part])
        odds = window_odds(net, words, windows)
        near, worst = {}, np.zeros(len(toxic))
        for k, t in enumerate(toxic):
            own = odds[first[t] : first[t + 1]]
            worst[k] = own.max()
            near[t] = first[t] + np.flatnonzero(own >= worst[k] - NEAR)
        chance = 0.2 + 0.8 * _sigmoid(-worst)
        chance /= chance.sum()
    return net


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs` (doc_id, text).

    Learns from a bounded sample of labelled rows that are not held out (see
    `labels.sample`; all of its labels count), and scores every window of every whole
    text. A text without words is one empty window. Where labels of one class
    are missing every score is their share. Repeated rows score alike; other
    columns are ignored.
    """
    rows = labelled.sample(docs, labels, "toxic", per_class, max_bytes)
    net = docs.sparkSession.sparkContext.broadcast(train(rows))
    share = (sum(y for _, y in rows) + 1) / (len(rows) + 2)

    def run(batches):
        for batch in batches:
            for texts in tokens.slices(batch.column("text")):
                if net.value is None:
                    scores = np.full(texts.count, share)
                else:
                    scores = text_scores(net.value, Vocabulary(texts))
                part = batch.slice(texts.first, texts.count).drop_columns(["text"])
                yield part.append_column("score", pa.array(scores))

    given = docs.select("doc_id", labelled.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    return given.mapInArrow(run, given.drop("text").schema.add("score", "double")).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
