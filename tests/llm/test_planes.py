"""Numbers packed by planes come back as they were and take less room."""

import numpy as np

from quadrille.llm import sentencepiece_ops as sp


def test_planes():
    for a in ([], [5], [0, 1, -3, 1 << 30, 255, 256]):
        assert sp._from_planes(sp._planes(np.array(a, np.int64))).tolist() == a
    numbers = np.random.default_rng(1).zipf(1.3, 100_000).clip(max=150_000)
    assert len(sp._pack(sp._planes(numbers))) < 0.9 * len(sp._pack(numbers.astype("<u4")))
