"""Character n-grams of lower-cased letters, hashed to a fixed number of dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .words import mix

#: Characters of a text that are worked on at once.
PIECE = 1 << 20
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """True for each code point that is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def codes(text: str, overlap: int) -> Iterator[np.ndarray]:
    """Code points of the lower-cased text with 0 for all that isn't a letter, in pieces that share ``overlap`` places; a 0 stands at both ends."""
    table = letters()
    for i in range(0, max(len(text), 1), PIECE):
        part = text[max(0, i - overlap) : i + PIECE].lower()
        raw = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        out = np.where(table[raw], raw, 0).astype(np.uint64)
        yield np.concatenate([np.zeros(int(i == 0), np.uint64), out, np.zeros(int(i + PIECE >= len(text)), np.uint64)])


def gram_ids(text: str, size: int, bits: int) -> Iterator[np.ndarray]:
    """Hashed ids of the n-grams whose second to last-but-one places are letters (word ends count as one place)."""
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        for c in codes(text, size - 1):
            n = len(c) - size + 1
            if n <= 0:
                continue
            h, inside = np.zeros(n, np.uint64), np.ones(n, bool)
            for j in range(size):
                h = h * np.uint64(0x100000001B3) + c[j : j + n]
                if 0 < j < size - 1:
                    inside &= c[j : j + n] != 0
            yield (mix(h[inside]) >> shift).astype(np.int64)


def gram_counts(text: str | None, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``ids, counts`` of the whole text; both empty where it has no letter."""
    total = None
    for ids in gram_ids(text or "", size, bits):
        found = np.bincount(ids, minlength=1 << bits)
        total = found if total is None else total + found
    if total is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(total)
    return at, total[at]
