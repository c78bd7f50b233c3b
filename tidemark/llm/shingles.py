"""Word n-grams of texts as 64-bit hashes, for a batch of texts at a time."""

from __future__ import annotations

import numpy as np

#: Fixed seeds: hashes must agree between tasks and runs.
_RANDOM = np.random.default_rng(20240613)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_powers: list[np.ndarray] = []
_last: list = [None, None]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; the sums and powers are those of the last ``data`` seen."""
    if _last[0] is not data:
        up, _ = _power_table(len(data) + 1)
        _last[:] = [data, np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])]
    sums, down = _last[1], _power_table(len(data) + 1)[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text). Words: bytes that are not ASCII white space."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return span_hashes(data, starts, ends), np.diff(np.searchsorted(starts, bounds))


def ngram_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct n-gram hashes of each text, sorted, one text after the other; their numbers).

    A text of one to n - 1 words has one n-gram, all its words; a text without words has none.
    """
    words, counts = word_hashes(texts)
    total = len(words)
    ends = np.cumsum(counts)
    starts = ends - counts
    grams = np.zeros(total, np.uint64)
    reach = np.repeat(ends, counts) - np.arange(total)  # words from here to the text's end
    for k in range(n):
        shifted = np.zeros(total, np.uint64)
        if total > k:
            shifted[: total - k] = words[k:]
        grams = np.where(reach > k, grams * _STEP + mix(shifted + np.uint64(k + 1)), grams)
    keep = (reach >= n) | ((np.arange(total) == np.repeat(starts, counts)) & (np.repeat(counts, counts) < n))
    owner = np.repeat(np.arange(len(texts)), counts)[keep]
    grams = mix(grams[keep])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=len(texts))
