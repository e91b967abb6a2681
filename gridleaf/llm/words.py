"""Words, word hashes and word windows of one text, as arrays."""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash

#: Odd multiplier of the polynomial over word hashes (arithmetic modulo 2 ** 64).
BASE = np.uint64(0x9E3779B97F4A7C15)


def split(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text; none for null."""
    return text.split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; words that occur again are hashed once."""
    known: dict[bytes, int] = {}
    digest = xxhash.xxh64_intdigest
    for w in words:
        if w not in known:
            known[w] = digest(w, 7)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of a multiplicative hash)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every window of ``size`` words, by doubling; empty where there are fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, step, width = hashes, BASE, 1  # hash of every window of `width`, BASE ** width
    out, out_width = None, 0
    left = size
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out, out_width = power, width
                else:  # the longer window goes in front of what is there
                    shift = base_power(out_width)
                    m = len(hashes) - out_width - width + 1
                    out = power[:m] * shift + out[width : width + m]
                    out_width += width
            left >>= 1
            if left:
                m = len(power) - width
                power = power[:m] * step + power[width:]
                step = step * step
                width *= 2
        return mix(out[:n])


def base_power(k: int) -> np.uint64:
    return np.uint64(pow(int(BASE), k, 1 << 64))


def repeated_words(words: list[bytes], size: int) -> int:
    """Words covered by windows of ``size`` words that are found twice or more in the text, the first included.

    Hashes only tell which texts have no repeated window; where one repeats, the windows themselves decide.
    """
    n = len(words) - size + 1
    if n < 2:
        return 0
    hashed = window_hashes(word_hashes(words), size)
    _, inverse, counts = np.unique(hashed, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    starts = np.flatnonzero(again)
    found = Counter(tuple(words[i : i + size]) for i in starts)
    edges = np.zeros(len(words) + 1, np.int64)
    for i in starts:
        if found[tuple(words[i : i + size])] > 1:
            edges[i] += 1
            edges[i + size] -= 1
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))
