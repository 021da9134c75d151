"""Learned models against plain forms of their definitions."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cartolith.llm import quality, toxicity


def plain_features(word):
    """Three-letter subsequences with gaps of at most two and their weights, by three loops."""
    w, out = f"^{word}$", defaultdict(float)
    for i in range(len(w)):
        for j in range(i + 1, min(i + 4, len(w))):
            for k in range(j + 1, min(j + 4, len(w))):
                out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
    return out


def plain_kernel(a, b):
    x, y = plain_features(a), plain_features(b)
    dot = lambda p, q: sum(v * q.get(k, 0.0) for k, v in p.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def test_subsequence_kernel():
    words = ["idiot", "idixot", "i", "ab", "abc", "idiots", "toidi", "häßlich", "zzzzzz", "idiotidiot"]
    kernel = toxicity.Kernel(words)
    got = kernel.similarity(words, kernel.whole)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(got[i, j] - plain_kernel(a, b)) < 1e-9, (a, b)


def test_decision_values_of_sentences():
    """bias + sum over words and landmarks, and over neighbouring words and pairs of landmarks."""
    rng = random.Random(6)
    singles, pairs = ["idiot", "dummkopf", "plain"], [("block", "head"), ("hot", "air")]
    scorer = toxicity.Scorer(singles, pairs)
    weights = np.array([2.5, 1.7, -0.8, 3.0, 1.1])
    scorer.use(weights, -0.9)

    def k(a, b):
        s = plain_kernel(a, b)
        return s**toxicity.POWER if s >= toxicity.NEAR else 0.0

    vocab = ["idiot", "idixot", "dummkopff", "plains", "planet", "block", "blocks", "head", "heads", "hot", "hotair", "air", "house", "tree", "kopf", "dumm"]
    kernel = {(a, b): k(a, b) for a in vocab for b in {*singles, *[x for p in pairs for x in p]}}
    reach = lambda w: any(kernel[w, n] > 0 and (n not in singles or weights[singles.index(n)] > 0) for n in scorer.names)

    def value(sentence):
        gains = [sum(weights[i] * kernel[w, s] for i, s in enumerate(singles)) if reach(w) else 0.0 for w in sentence]
        total = -0.9 + sum(g for g in gains if abs(g) >= toxicity.LEAST_GAIN)
        for i, a in enumerate(sentence):
            for b in sentence[i + 1 : i + 3]:
                if reach(a) and reach(b):
                    # at most one word that is near a landmark or not stands between
                    total += sum(weights[3 + n] * kernel[a, p] * kernel[b, q] for n, (p, q) in enumerate(pairs))
        return total

    for _ in range(200):
        sentence = [rng.choice(vocab) for _ in range(rng.randrange(1, 9))]
        text = pa.array([" ".join(sentence) + "."], pa.string())
        assert abs(scorer.texts(text)[0] - max(-0.9, value(sentence))) < 1e-9, sentence


def test_pairwise_loss_is_least():
    """The weights are as good, over all pairs, as those that plain descent over all pairs finds."""
    rng = np.random.default_rng(4)
    y = (np.arange(80) % 2).astype(float)
    x = rng.normal(size=(80, 4)) + y[:, None] * [0.8, -0.5, 0.0, 0.2]
    model = quality.fit(x, y)
    z = (x - model["mean"]) / model["scale"]
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 4)
    loss = lambda w: np.log1p(np.exp(-(d @ w))).mean() + 5e-5 * (w @ w)
    w = np.zeros(4)
    for _ in range(6000):
        w -= 0.2 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(0) + 1e-4 * w)
    assert loss(model["w"]) < loss(w) + 2e-3
    s = z @ model["w"]
    assert abs(np.mean([(s[y == 1][:, None] > s[y == 0]).mean()]) - np.mean([((z @ w)[y == 1][:, None] > (z @ w)[y == 0]).mean()])) < 0.01
    better = lambda c: (s[y == 1] >= c).mean() + (s[y == 0] < c).mean()
    assert better(model["cut"]) >= max(better(c) for c in np.quantile(s, np.linspace(0.005, 0.995, 199))) - 1e-9


@pytest.mark.parametrize("part", [1, 3])
def test_quality_features_do_not_depend_on_neighbours(part):
    texts = [None, "", "One sentence. Another, with 3 words!", "a a a a b", "x" * 5000, "Ä ö 漢字 !!", "http://a.b/c?d=e", "word " * 4000, "\n\n- item\n- item"] * 2
    whole = quality.features(pa.array(texts, pa.string()))
    for i in range(0, len(texts), part):
        assert np.allclose(quality.features(pa.array(texts[i : i + part], pa.string())), whole[i : i + part], atol=1e-12, rtol=0)
