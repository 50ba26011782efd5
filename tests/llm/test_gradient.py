"""The toxicity classifier's step and score against plain loops."""

import math

import numpy as np
import pytest

from pixelweft.llm import toxicity
from pixelweft.llm.common import word_ngrams

from .test_scale import slow_risk


def corpus(hard):
    rng = np.random.default_rng(4)
    words = ["alpha", "bravo", "charly", "delta", "echo", "golf", "hotel"]
    docs = []
    for i in range(90):
        d = [str(x) for x in rng.choice(words, 4)]
        docs.append(d + (["zwiffle"] if (i < 40 and rng.random() < 0.9) or (i >= 40 and rng.random() < hard) else []))
    return docs, np.arange(40), np.arange(40, 90)


@pytest.mark.parametrize(("hard", "prior"), [(0.2, 0.2), (0.02, 0.7)])
def test_a_step_is_the_gradient_by_finite_differences(hard, prior):
    """Both branches: the usual step, and the one that raises a negative part."""
    docs, pos, unl = corpus(hard)
    sample = toxicity._Sample(docs)
    w0 = toxicity.log_ratios(sample, pos, unl)
    assert (w0 > 0).sum() > 5
    rate = 1e-4
    w1, b1 = toxicity.nnpu(sample, pos, unl, prior, 1, rate)
    plus, rest = slow_risk(docs, w0, -1.0, pos, unl, prior)
    assert (rest < 0) == (prior == 0.7)

    def wanted(w, b):
        plus, free = slow_risk(docs, w, b, pos, unl, prior)
        return plus + free if rest >= 0 else -free

    # The first step of Adam moves by rate * g / (|g| + 1e-3), so it tells g.
    moved = np.append(w0 - w1, -1.0 - b1) / rate
    got = np.sign(moved) * 1e-3 * np.abs(moved) / (1 - np.abs(moved))
    h = 1e-4
    touched = np.flatnonzero(w0)
    assert set(np.flatnonzero(np.abs(moved[:-1]) > 1e-12)) <= set(range(len(w0)))
    for k in [*touched[:: max(1, len(touched) // 25)], len(w0)]:
        up, down = (w0.copy() for _ in range(2))
        bu = bd = -1.0
        if k == len(w0):
            bu, bd = -1.0 + h, -1.0 - h
        else:
            up[k] += h
            down[k] -= h
        assert got[k] == pytest.approx((wanted(up, bu) - wanted(down, bd)) / (2 * h), rel=2e-3, abs=2e-6)


def test_a_score_is_the_largest_word_score():
    rng = np.random.default_rng(7)
    weights = rng.normal(size=1 << toxicity.BITS).astype(np.float32)
    model = toxicity.ToxicModel(weights, 0.8, -0.3, 0.1)
    texts = ["One two, three!", "(zwiffle) and\tmore", "", None, "...", "x " * 5000 + "Last"]

    def slow(t):
        best = 0.0
        for w in (t or "").lower().split():
            w = w.strip(toxicity.EDGE) or w
            best = max(best, sum(float(weights[f]) for _, fs in word_ngrams([w], toxicity.SIZES, toxicity.BITS) for f in fs))
        return 1 / (1 + math.exp(-(0.8 * math.log1p(best) - 0.3)))

    assert toxicity.Scorer(model)(texts) == pytest.approx([slow(t) for t in texts], rel=1e-6)
