"""Vector bin packing of training examples into sequences.

A sequence has limits on tokens, on segments and on loss-bearing tokens at once. An open sequence takes, of the pieces
that fit all limits, the one whose demand vector has the largest dot product with the room that is left (both measured
in parts of the limits). Pieces wait in a pool of bounded size, so a task holds a pool and one text, and nothing is
shuffled; each task numbers its own sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows
from .tokens import encoder

END = (1).to_bytes(4, "little")


@dataclass(frozen=True)
class Limits:
    """Limits of one sequence; ``pool``: pieces that wait at most (more where they don't reach a limit together), ``least``: shortest piece that is cut off to fill up."""

    tokens: int = 2048
    segments: int = 1024
    loss: int = 2048
    pool: int = 512
    least: int = 8


class Pool:
    """Pieces that wait for a place. A piece is (label, start, ids or None, tokens, loss)."""

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cut = limits, cut
        self.items: list[tuple | None] = []
        self.need = np.zeros((2 * max(limits.pool, limits.segments) + 2, 3))
        self.parts = np.array([limits.tokens, limits.segments, limits.loss], float)

    def __len__(self) -> int:
        return len(self.items)

    def full(self) -> bool:
        """More than ``pool`` pieces wait, and they reach a limit of a sequence: short ones wait on for company."""
        return len(self) > self.limits.pool and bool((self.need[: len(self)].sum(axis=0) >= self.parts).any())

    def add(self, item: tuple) -> None:
        self.need[len(self.items)] = (item[3], 1, item[4])
        self.items.append(item)

    def take(self, i: int) -> tuple:
        """Remove piece ``i``; the last one moves to its place."""
        item, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i] = last
            self.need[i] = self.need[len(self.items)]
        return item

    def fill(self) -> list[tuple]:
        """The pieces of one new sequence."""
        room, placed = self.parts.copy(), []
        while self.items and room[0] > 0 and room[1] > 0:
            need = self.need[: len(self.items)]
            fits = (need <= room).all(axis=1)
            if fits.any():
                worth = (need / self.parts) @ (room / self.parts)
                item = self.take(int(np.argmax(np.where(fits, worth, -1.0))))
            elif self.cut and min(room[0], room[2]) >= self.limits.least:
                item = self.split(int(np.argmax(need[:, 0])), int(min(room[0], room[2])))
            else:
                break
            placed.append(item)
            room -= (item[3], 1, item[4])
        return placed

    def split(self, i: int, size: int) -> tuple:
        """Cut the first ``size`` ids off piece ``i``; the rest waits on. Each id of such a piece bears loss."""
        label, start, ids, tokens, _ = self.take(i)
        self.add((label, start + size, ids[4 * size :], tokens - size, tokens - size))
        return label, start, ids[: 4 * size], size, size


def power_runs(total: int) -> list[int]:
    """``total`` as falling powers of two."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


def drained(pool: Pool) -> Iterator[list[tuple]]:
    """Sequences until the pool is empty. Where pieces may be cut, the last ids of the stream go into sequences whose
    lengths are powers of two, which need no padding."""
    limits = pool.limits
    while len(pool):
        rest = int(pool.need[: len(pool), 0].sum())
        if not pool.cut or rest > min(limits.tokens, limits.loss) or len(pool) + rest.bit_length() > limits.segments:
            yield pool.fill()
            continue
        for size in power_runs(rest):
            sequence, left = [], size
            while left:
                last = len(pool) - 1
                piece = pool.take(last) if pool.need[last, 0] <= left else pool.split(last, left)
                sequence.append(piece)
                left -= piece[3]
            yield sequence


def numbered() -> Iterator[int]:
    """Sequence ids of this task: its partition in the high bits."""
    context = TaskContext.get()
    first = (context.partitionId() if context else 0) << 33
    while True:
        yield first
        first += 1


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits()) -> DataFrame:
    """Whole texts cut and packed: one row for each piece.

    ``doc_id``, ``start`` (ids of its document before it), ``length``, ``ids_crc32`` (of the little-endian unsigned
    32-bit ids), ``doc_tokens`` (with the closing id 1), ``sequence_id``, ``offset`` (its place there). A document of a
    sequence's length or more gives whole sequences first, and what is left waits in the pool. Null texts count as
    empty and give the closing id alone; null and repeated ``doc_id`` are carried as they are; an empty table gives no
    rows; other columns are not read. A long text costs memory for itself only.
    """

    size = min(limits.tokens, limits.loss)

    def sequences(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        encode, pool = encoder(tokenizer).ids, Pool(limits, True)
        for doc_id, text in rows:
            ids, start = encode(text or "") + END, 0
            n = len(ids) // 4
            while n - start >= size:
                yield [((doc_id, n), start, ids[4 * start : 4 * (start + size)], size, size)]
                start += size
            if start < n:
                pool.add(((doc_id, n), start, ids[4 * start :], n - start, n - start))
            while pool.full():
                yield pool.fill()
        yield from drained(pool)

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for name, sequence in zip(numbered(), sequences(rows)):
            offset = 0
            for (doc_id, n), start, ids, length, _ in sequence:
                yield doc_id, start, length, zlib.crc32(ids), n, name, offset
                offset += length

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return map_rows(docs.select("doc_id", "text"), work, schema)


def pack_examples(examples: DataFrame, limits: Limits, key: str, tokens: str, loss: str) -> DataFrame:
    """Whole examples (never cut) with known sizes: ``key, tokens, loss, sequence_id, offset, segment``.

    An example that exceeds a limit alone has ``sequence_id`` null. Null sizes count as zero; rows that repeat are
    packed each for itself; an empty table gives no rows.
    """

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        number, pool = numbered(), Pool(limits, False)

        def placed(sequence: list[tuple]) -> Iterator[tuple]:
            name, offset = next(number), 0
            for i, (label, _, _, n, m) in enumerate(sequence):
                yield label, n, m, name, offset, i
                offset += n

        for name, n, m in rows:
            n, m = int(n or 0), int(m or 0)
            if n > limits.tokens or m > limits.loss:
                yield name, n, m, None, None, None
                continue
            pool.add((name, 0, None, n, m))
            while pool.full():
                yield from placed(pool.fill())
        for sequence in drained(pool):
            yield from placed(sequence)

    kind = examples.select(F.col(key)).schema[0].dataType.simpleString()
    schema = f"key {kind}, tokens bigint, loss bigint, sequence_id bigint, offset bigint, segment bigint"
    return map_rows(examples.select(key, tokens, loss), work, schema).withColumnRenamed("key", key)
