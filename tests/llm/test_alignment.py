"""Matching blocks and chains of op7: the same results as their plain forms, at less work."""

import difflib

import numpy as np

from siftlog.llm import passages


def test_matching_blocks_are_those_of_difflib():
    rng = np.random.default_rng(7)
    for t in range(400):
        x, y = (rng.integers(0, int(rng.integers(1, 30)), int(rng.integers(0, 60))).astype(np.uint32) for _ in "xy")
        if t % 2:
            y = np.where(rng.random(len(x)) < 0.2, 99, x).astype(np.uint32)
        expected = [tuple(m) for m in difflib.SequenceMatcher(None, x.tolist(), y.tolist(), autojunk=False).get_matching_blocks()]
        assert passages.matching_blocks(x, y) == passages.matching_blocks(x, y, most=-1) == expected


def test_alignment_leaves_difflib_to_texts_with_very_many_equal_pairs(monkeypatch):
    """One word in eight is changed, so that the passage goes through matching blocks."""
    x = np.arange(1, 401, dtype=np.uint32)
    y = np.where(np.arange(400) % 8 == 5, x + 1000, x).astype(np.uint32)
    expected = passages.align(x, y, 100, 140, 100, 140, min_words=50, identity=0.8)
    assert expected == (0, 397, 0, 397, 397 - 49)  # the two words behind the last change are no block

    class Unused:
        def __init__(self, *_, **__):
            raise AssertionError("difflib was asked")

    monkeypatch.setattr(passages, "SequenceMatcher", Unused)
    assert passages.align(x, y, 100, 140, 100, 140, min_words=50, identity=0.8) == expected


def test_chains_that_rise_in_both_texts():
    """Scores by trying all earlier matches; the best chain ends at the best score."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        pos, at = (np.cumsum(rng.choice([1, 2, 5, 70], 30)) for _ in "xy")
        f = []
        for i in range(30):
            f.append(4 + max([0.0, *(f[j] - 0.05 * (pos[i] - pos[j] + at[i] - at[j]) for j in range(i))]))
        found = passages.chains(pos, at, 4, 0.05, 10**6)
        assert abs(max(4 * n - 0.05 * (b - a + d - c) for a, b, c, d, n in found) - max(f)) < 1e-9
        assert sum(c[4] for c in found) == 30
