"""Likeness of texts whose sizes differ little."""

import numpy as np

from riskloom.llm import fingerprint


def test_texts_on_both_sides_of_512_bytes():
    rng = np.random.default_rng(3)
    body = " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(200)).encode()
    texts = [body[:500], body[:520], body[:1200], body[:1180]]
    prints = fingerprint.sketch(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    near = fingerprint.likeness(prints[[0, 2]], prints[[1, 3]])
    assert near[0] > 0.8 and near[1] > 0.8
