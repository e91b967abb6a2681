"""Document fingerprints from prefix polynomial hashes.

The prefix arrays of a text (sums of code point times power, modulo two primes) give the hash of any span from two
entries, so equality of spans takes constant time and the longest common extension of two places a binary search. A
fingerprint keeps, for each of ``BINS`` bins of the span hashes, the smallest one; the share of bins on which two
fingerprints agree estimates how much text they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .batches import map_rows
from .words import mix

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
BINS = 64
#: Kinds of texts: least code points, span, letter in the fingerprint.
KINDS = [(64, 16, "l"), (16, 4, "s"), (2, 2, "t"), (1, 1, "w"), (0, 0, "e")]
PIECE = 1 << 20
#: Ranges of ids at most; rows of one range aimed at.
RANGES, RANGE_ROWS = 10_000, 4096
_EMPTY = (1 << 64) - 1
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(58)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_to(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASES[k] ** i`` and its inverse modulo ``PRIMES[k]`` for i below n, kept for the next text."""
    if k not in _powers or len(_powers[k][0]) < n:
        p, size = PRIMES[k], 1 << max(12, int(n).bit_length())
        found = []
        for b in (BASES[k], pow(BASES[k], -1, p)):
            line, step = np.ones(1, np.uint64), b
            while len(line) < size:  # the second half is the first one times a power
                line = np.concatenate([line, line * np.uint64(step) % np.uint64(p)])
                step = step * step % p
            found.append(line)
        _powers[k] = tuple(found)
    return _powers[k]


class Prefix:
    """Prefix arrays of one text, which may start with another text's first ``keep`` code points and share their entries."""

    def __init__(self, codes: np.ndarray, head: "Prefix | None" = None, keep: int = 0):
        self.codes = codes
        self.sums = []
        for k, p in enumerate(PRIMES):
            power = _powers_to(k, len(codes) + 1)[0]
            terms = codes[keep:].astype(np.uint64)
            terms += np.uint64(1)
            terms *= power[keep : len(codes)]
            terms %= np.uint64(p)
            first = head.sums[k][: keep + 1] if head else np.zeros(1, np.uint64)
            self.sums.append(np.concatenate([first, first[-1] + np.cumsum(terms, dtype=np.uint64)]))

    def __len__(self) -> int:
        return len(self.codes)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Hash of one span, the same wherever the span stands."""
        return tuple(int(s[end] - s[start]) % p * int(_powers_to(k, len(self) + 1)[1][start]) % p for k, (s, p) in enumerate(zip(self.sums, PRIMES)))

    def spans(self, size: int, start: int, end: int) -> np.ndarray:
        """Mixed 64-bit hashes of the spans of ``size`` code points that start in ``start .. end - 1``."""
        out = np.zeros(max(0, end - start), np.uint64)
        for k, p in enumerate(PRIMES):
            apart = self.sums[k][start + size : end + size] - self.sums[k][start:end]
            apart %= np.uint64(p)
            apart *= _powers_to(k, len(self) + 1)[1][start:end]
            apart %= np.uint64(p)
            out = (out << np.uint64(31)) ^ apart
        with np.errstate(over="ignore"):
            return mix(out)


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Code points on which the texts agree from place i of a and place j of b on, by binary search."""
    low, high = 0, min(len(a) - i, len(b) - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, i + middle) == b.span(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def span_size(n: int) -> int:
    return next(size for least, size, _ in KINDS if n >= least)


def span_hashes(text: Prefix, size: int, start: int = 0) -> np.ndarray:
    """Hashes of all spans from ``start`` on; empty for the empty text."""
    last = len(text) - size + 1 if size else 0
    return np.concatenate([np.empty(0, np.uint64), *[text.spans(size, i, min(i + PIECE, last)) for i in range(start, last, PIECE)]])


def bins(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin. A span that occurs again counts as another one, so long repeats weigh by their length."""
    line = np.sort(hashes)
    again = np.flatnonzero(line[1:] == line[:-1]) + 1
    lines = [line]
    if len(again):
        first = np.r_[True, line[1:] != line[:-1]]
        turn = np.arange(len(line)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        with np.errstate(over="ignore"):
            lines.append(np.sort(mix(line[again] + turn[again].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))))
    least = np.full(BINS, _EMPTY, np.uint64)
    for x in lines:
        at = np.searchsorted(x, _EDGES)
        used = at < np.append(at[1:], len(x))
        least[used] = np.minimum(least[used], x[at[used]])
    return least


def written(n: int, least: np.ndarray) -> str:
    """The fingerprint: the kind of span, then 16 bits of each bin's smallest hash, ``----`` for an empty bin."""
    kind = next(letter for bound, _, letter in KINDS if n >= bound)
    return kind + "".join(["----" if v == _EMPTY else f"{v & 0xFFFF:04x}" for v in least.tolist()])


class Marked:
    """A text with its prefix arrays, span hashes and fingerprint; the first ``safe`` spans outlast an edit of its last quarter."""

    def __init__(self, text: str | None):
        self.prefix = Prefix(code_points(text or ""))
        n = len(self.prefix)
        self.keep, self.size = n - n // 4, span_size(n)
        self.safe = max(0, self.keep - self.size + 1) if self.size else 0
        self.hashes = span_hashes(self.prefix, self.size)
        self.fingerprint = written(n, bins(self.hashes))


def fingerprint(text: str | None) -> str:
    """Fingerprint of a whole text; null counts as empty, and equal texts have equal fingerprints."""
    return Marked(text).fingerprint


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of text that the fingerprints have in common; 1 for equal ones."""
    if a == b:
        return 1.0
    if a[0] != b[0]:
        return 0.0
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(1, len(a), 4)]
    used = sum(x != "----" or y != "----" for x, y in pairs)
    same = sum(x == y != "----" for x, y in pairs)
    return 2 * same / (used + same) if used else 0.0


def compared(text: Marked, following: Marked) -> tuple:
    """``n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, prefix_edited, prefix_next``.

    The edited text has its last quarter replaced by as many first code points of the following one.
    """
    own, n = text.prefix, len(text.prefix)
    twin = Prefix(np.concatenate([own.codes[: text.keep], following.prefix.codes[: n - text.keep]]), own, text.keep)
    m = len(twin)
    size = span_size(m)
    start = text.safe if size == text.size else 0  # the spans inside the kept part are the text's own
    edited = written(m, bins(np.concatenate([text.hashes[:start], span_hashes(twin, size, start)])))
    digest = hashlib.sha256(twin.codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return (
        n, digest, text.fingerprint, edited, likeness(text.fingerprint, edited), likeness(text.fingerprint, following.fingerprint),
        common_extension(own, 0, twin, 0), common_extension(own, 0, following.prefix, 0),
    )


def in_ranges(docs: DataFrame) -> DataFrame:
    """``range, ahead, doc_id, text`` sorted by them: each range of ids, then (``ahead``) the document that follows it.

    The last range is followed by the first document. The split points are approximate quantiles of the ids, a list of
    bounded length; one first id for each range comes to the driver. The text is shuffled once.
    """
    ship(docs.sparkSession)
    parts = max(1, min(RANGES, -(-docs.count() // RANGE_ROWS)))
    points = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    cuts = np.unique(np.array(points or [], float))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        found = np.searchsorted(cuts, ids.to_numpy(float, na_value=-np.inf), "right")
        return pd.Series(np.where(ids.isna().to_numpy(), -1, found).astype("int32"))

    ids = docs.select("doc_id", place("doc_id").alias("range")).groupBy("range").agg(F.min("doc_id").alias("first")).collect()
    order = sorted(ids, key=lambda r: r.range)
    before = {None if r.first is None else str(r.first): order[i - 1].range for i, r in enumerate(order)}  # the range before: the last one for the first

    @F.pandas_udf("int")
    def ahead_of(ids: pd.Series) -> pd.Series:  # ids as text: pandas would round long ones beside nulls
        return pd.Series([before.get(x) for x in ids.where(ids.notna(), None)], dtype="Int32")

    spots = F.array(F.struct(place("doc_id").alias("range"), F.lit(False).alias("ahead")), F.struct(ahead_of(F.col("doc_id").cast("string")).alias("range"), F.lit(True).alias("ahead")))
    dealt = docs.select("doc_id", "text", F.explode(spots).alias("spot")).where(F.col("spot.range").isNotNull())
    return dealt.select("spot.range", "spot.ahead", "doc_id", "text").repartition("range").sortWithinPartitions("range", "ahead", "doc_id", F.xxhash64("text"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, prefix_edited, prefix_next``.

    One row for each document. The next document is the next one by id (equal ids: by hash of the text, nulls first);
    the first one follows the last one, and a single document follows itself. Null texts count as empty: their
    fingerprint is that of the empty text and their edited text is empty too. An empty table gives no rows; other columns
    are not read. A task holds the arrays of three texts.
    """

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = None  # (range, doc_id, text), waiting for the next one
        for spot, ahead, doc_id, text in rows:
            if held is None and ahead:
                continue  # further texts ahead with the same id
            now = Marked(text)
            if held is not None and held[0] == spot:
                yield (held[1], *compared(held[2], now))
            held = None if ahead else (spot, doc_id, now)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, prefix_edited bigint, prefix_next bigint"
    )
    return map_rows(in_ranges(docs.select("doc_id", "text")), work, schema)
