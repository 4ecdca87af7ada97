"""The network against plain loops and finite differences, and labels that windows alone cannot tell."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from marlpit.llm import tokens, toxicity

TEXTS = ["one two three", "alpha beta " * 30, "", "x", "wörter und worte " * 9]


def some():
    (texts,) = tokens.slices(pa.array(TEXTS, pa.large_string()), 1 << 30)
    words = toxicity.Vocabulary(texts)
    windows, text = words.windows()
    return words, windows, text


def plain(net, x, window):
    """Log odds of one window, a unit at a time."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    u, ids = toxicity.UNITS, [i for i in window if i >= 0]
    states = [[0.0] * (2 * u) for _ in ids]
    for side, steps, at in (("f", range(len(ids)), 0), ("b", range(len(ids) - 1, -1, -1), u)):
        h = [0.0] * u
        wx, wh, c = (net[f"{k}{side}"] for k in "xhc")
        for t in steps:
            gate = [sum(x[ids[t]][i] * wx[i][k] for i in range(toxicity.INPUT)) + c[k] for k in range(3 * u)]
            rec = [sum(h[i] * wh[i][k] for i in range(u)) for k in range(3 * u)]
            h = [
                h[k] + sig(gate[k] + rec[k]) * (math.tanh(gate[2 * u + k] + sig(gate[u + k] + rec[u + k]) * rec[2 * u + k]) - h[k])
                for k in range(u)
            ]
            states[t][at : at + u] = h
    if not ids:
        return float(net["bias"][0])
    energy = [sum(s * a for s, a in zip(state, net["attend"])) for state in states]
    weight = [math.exp(e - max(energy)) for e in energy]
    pooled = [sum(w * s[k] for w, s in zip(weight, states)) / sum(weight) for k in range(2 * u)]
    return sum(p * o for p, o in zip(pooled, net["out"])) + float(net["bias"][0])


def test_forward_is_that_of_plain_loops():
    net = toxicity.fresh(5)
    words, windows, _ = some()
    x = toxicity.inputs(net, words)
    got = toxicity.forward(net, x, windows)[0]
    assert np.allclose(got, [plain(net, x, w) for w in windows.tolist()], atol=2e-4)


@pytest.mark.parametrize("name", ["out", "bias", "attend", "xf", "xb", "hf", "hb", "cf", "cb"])
def test_gradients_are_finite_differences(name):
    net = {k: v.astype(np.float64) for k, v in toxicity.fresh(7).items()}
    words, windows, _ = some()
    x = toxicity.inputs(net, words).astype(np.float64)
    labels = (np.arange(len(windows)) % 2).astype(np.float64)

    def loss():
        odds = toxicity.forward(net, x, windows)[0].astype(np.float64)
        return np.mean(np.logaddexp(0, odds) - labels * odds)

    grad = toxicity.gradients(net, x, windows, labels)[0][name]
    flat, value = np.ravel(grad), net[name].reshape(-1)
    for i in np.random.default_rng(1).choice(len(value), min(6, len(value)), replace=False):
        keep, step = value[i], 1e-2
        value[i] = keep + step
        up = loss()
        value[i] = keep - step
        down = loss()
        value[i] = keep
        assert abs((up - down) / (2 * step) - flat[i]) < 2e-4 + 0.03 * abs(flat[i])


def test_pooling_counts_windows_apart():
    odds = np.array([-8, 3, -8, 0, 0], np.float32)
    text = np.array([0, 0, 1, 2, 2])
    got = toxicity._pool(odds, text, 3)
    assert np.allclose(got[:, 0], [3, -8, 0])
    share = toxicity.STRIDE / toxicity.WINDOW
    sig = lambda v: 1 / (1 + np.exp(-v))
    assert np.allclose(np.exp(got[:, 1]) - 0.01, [(sig(-8) + sig(3)) * share, sig(-8) * share, 2 * sig(0) * share], atol=1e-6)


def test_every_toxic_label_counts():
    """Two kinds of toxic texts, one of them rare: both are found in texts not learned from."""
    random_ = random.Random(2)
    plain_words = ["".join(random_.choices("aeioulnrst", k=random_.randrange(2, 7))) for _ in range(400)]

    def text(kind):
        words = random_.choices(plain_words, k=random_.randrange(30, 90))
        for stem, n in {"common": (("grolp", 4),), "rare": (("zwickim", 4),), "clean": ()}[kind]:
            for _ in range(n):
                words.insert(random_.randrange(len(words)), stem + random_.choice(["a", "en", "is", "ot"]))
        return " ".join(words)

    rows = [(text("common"), 1) for _ in range(120)] + [(text("rare"), 1) for _ in range(24)] + [(text("clean"), 0) for _ in range(300)]
    random_.shuffle(rows)
    net = toxicity.train(rows)
    scores = {
        kind: toxicity._sigmoid(toxicity._features(net, [(text(kind), 0) for _ in range(40)]) @ net["pool"][:-1] + net["pool"][-1])
        for kind in ("common", "rare", "clean")
    }
    assert (scores["common"] >= 0.7).mean() > 0.9 and (scores["rare"] >= 0.7).mean() > 0.8
    assert (scores["clean"] >= 0.7).mean() < 0.05
