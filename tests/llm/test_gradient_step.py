"""A gradient step of the language model adds up each row's gradients as a plain loop does."""

import numpy as np

from riskloom.llm import lm


def test_step_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    hashed, leaf = rng.integers(0, 50, 300).astype(np.uint64), rng.integers(0, lm.LEAVES, 300)
    feats = lm.Model.rows(hashed, np.array([40, 41, 300]))
    model, memory = lm.Model(), [np.zeros((lm.ROWS, lm.CLASSES), np.float32) for _ in range(2)]
    model.train(feats, leaf, memory)
    plain, cls = lm.Model(), leaf // lm.CLASSES
    for w, at, want in ((plain.top, plain.places(feats, None), cls), (plain.low, plain.places(feats, cls), leaf % lm.CLASSES)):
        g = plain.softmax(w, at)
        g[np.arange(300), want] -= 1
        total = np.zeros_like(w)
        for a in at:
            for row in np.unique(a):
                grad = g[a == row].sum(axis=0) / 64
                total[row] += grad * grad
                w[row] -= lm.RATE * grad / np.sqrt(total[row] + 1e-4)
    assert np.allclose(model.top, plain.top, atol=1e-5) and np.allclose(model.low, plain.low, atol=1e-5)
    assert np.abs(model.low).max() > 0.01
