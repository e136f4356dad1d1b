"""Word and shingle hashes of whole texts, computed over a slice of texts at once with numpy.

A word is a run of bytes other than blank and \\t to \\r, with A-Z in lower case. Its hash is a mixed
polynomial in an odd base modulo 2^64, taken from running sums; a shingle's mixes those of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_bytes = np.arange(256, dtype=np.uint8)
_INK = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))
_LOW = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint64) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = (made[0], made[1])
    return _powers


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and ``bounds``: text i has words bounds[i] to bounds[i + 1]."""
    texts = texts.fill_null("")
    large = texts.type == pa.large_string()
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    ink = _INK[raw]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] |= ink[inner]
    last[inner - 1] |= ink[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers_to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOW[raw] * power[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(starts, offsets)


def shingles(texts: pa.Array, k: int):
    """For each text the hashes of its word k-grams in order; a shorter text with words has one."""
    hashes, bounds = words(texts)
    scaled = hashes.copy()
    n = len(hashes)
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams[: n - j] += scaled[j:] * np.uint64(pow(_BASE, j, 1 << 64)) if j < n else np.uint64(0)
    grams = mix(grams)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            yield grams[a : b - k + 1]
        elif b > a:
            whole = sum(int(h) * pow(_BASE, j, 1 << 64) for j, h in enumerate(hashes[a:b])) + (b - a)
            yield mix(np.array([whole % (1 << 64)], np.uint64))
        else:
            yield grams[:0]
