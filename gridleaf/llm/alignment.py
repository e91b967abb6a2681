"""Two tokenizers aligned over a corpus, each distinct text once.

Texts meet by their full content in a shuffle, so a text that comes a thousand times is tokenised once and its pairs
count a thousand times. Both token streams spell the text's bytes; offsets where tokens of both end cut it into
groups, and tokens whose bytes overlap are linked. What a pair of ids counts (documents that hold it linked) is summed
over the corpus and goes back to the distinct texts, whose measures a join brings to all their documents.

Neither tokenizer joins anything across a single space between two other characters. So a text is the row of
its units cut at such spaces, and a unit is tokenised and aligned once while a worker remembers it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .batches import map_rows, read, stored
from .tokens import _visible_bytes

#: Ids of the second tokenizer are below 2 ** LOW, so a pair is one number of 32 bits.
LOW = 15
#: Units that a worker remembers (at most twice as many), texts whose unknown units are tokenised together.
CACHE, TEXTS = 100_000, 64
#: Pairs that are sent to all tasks at most (17 bytes each); more are joined by a shuffle.
HELD = 1 << 22
#: Pair occurrences that are counted in a task at once.
WINDOW = 1 << 22

_CUT = re.compile(r"(?<=\S) (?=\S)")
Unit = tuple[int, int, int, str, bytes]  # tokens of both, groups, groups as text, links as pair numbers


@dataclass
class Alignment:
    """Measures of one text; ``None`` in place of it stands for a text without tokens."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: np.ndarray


def align(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> Unit:
    """From (id, bytes) of the tokens on both sides, which spell the same bytes."""
    i, j, at, end_a, end_b = 0, 0, 0, a[0][1], b[0][1]
    links, groups, left, right = [], [], [str(a[0][0])], [str(b[0][0])]
    while True:
        links.append(a[i][0] << LOW | b[j][0])
        at = min(end_a, end_b)
        step_a, step_b = end_a == at, end_b == at
        if step_a and step_b:
            groups.append(f"{','.join(left)}|{','.join(right)}")
            left, right = [], []
        if step_a:
            i += 1
            if i < len(a):
                end_a += a[i][1]
                left.append(str(a[i][0]))
        if step_b:
            j += 1
            if j < len(b):
                end_b += b[j][1]
                right.append(str(b[j][0]))
        if i == len(a) or j == len(b):
            return len(a), len(b), len(groups), ";".join(groups), np.array(links, np.uint32).tobytes()


class Aligner:
    """Both tokenizers, and the units met of late."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        byte_of = {c: b for b, c in _visible_bytes().items()}
        self.bytes_a = {i: bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode() for piece, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(pieces) > 1 << LOW or max(self.bytes_a) >= 1 << (32 - LOW):
            raise ValueError("a pair of ids must fit 32 bits")
        #: Whether no piece goes on over a space, so that a text can be cut into units.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.young: dict[str, Unit | None] = {}
        self.old: dict[str, Unit | None] = {}

    def _encode(self, units: list[str]) -> list[Unit | None]:
        out: list[Unit | None] = []
        for unit, a, b in zip(units, self.a.encode_batch([" " + u for u in units], add_special_tokens=False), self.b.encode(units, num_threads=1)):
            ids = a.ids
            left, right = [self.bytes_a[i] for i in ids], [self.bytes_b[i] for i in b]
            whole = (" " + unit).encode()
            same = b"".join(left) == whole == b"".join(right)
            out.append(align([*zip(ids, map(len, left))], [*zip(b, map(len, right))]) if same else None)
        return out

    def units(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def aligned(self, texts: list[str]) -> list[Alignment | None]:
        cut = [self.units(t) for t in texts]
        known: dict[str, Unit | None] = {}
        missing: dict[str, None] = {}
        for units in cut:
            for u in units:
                if u in known or u in missing:
                    continue
                if u in self.young:
                    known[u] = self.young[u]
                elif u in self.old:
                    known[u] = self.young[u] = self.old[u]
                else:
                    missing[u] = None
        if missing:
            for u, found in zip(missing, self._encode(list(missing))):
                known[u] = found
                if len(u) < 100:
                    self.young[u] = found
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        return [self._joined([known[u] for u in units]) for units in cut]

    def _joined(self, units: list[Unit | None]) -> Alignment | None:
        if None in units:
            return None
        a, b, n, groups, links = zip(*units)
        return Alignment(sum(a), sum(b), sum(n), ";".join(groups), np.frombuffer(b"".join(links), np.uint32))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    key = (bytes_path, pieces_path)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _aligned_texts(texts: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """``key, times, measures, pairs, occurrences`` of distinct ``text, times``; texts without tokens give no row."""

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        it = aligner(*paths)

        def out(held):
            for (text, times), found in zip(held, it.aligned([t for t, _ in held])):
                if found is not None:
                    pairs, counts = np.unique(found.links, return_counts=True)
                    digest = hashlib.sha256(found.groups.encode()).hexdigest()
                    yield hashlib.sha256(text.encode()).digest(), times, found.n_a, found.n_b, found.n_groups, len(found.links), digest, pairs.tobytes(), counts.astype(np.uint32).tobytes()

        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[0])
            if len(held) >= TEXTS or size >= 1 << 20:
                yield from out(held)
                held, size = [], 0
        if held:
            yield from out(held)

    kind = "key binary, times bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, occurrences binary"
    return map_rows(texts.select("text", "times"), work, kind)


def _pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count, best``: documents that hold a pair linked, and whether no pair of its first id counts more."""

    def work(batches):
        def out(parts, weights):
            values, at = np.unique(np.concatenate(parts), return_inverse=True)
            sums = np.zeros(len(values), np.int64)
            np.add.at(sums, at, np.repeat(np.array(weights, np.int64), [len(p) for p in parts]))
            return pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(sums)], names=["pair", "count"])

        parts, weights, size = [], [], 0
        for pairs, times in read(batches):
            parts.append(np.frombuffer(pairs, np.uint32))
            weights.append(times)
            size += len(parts[-1])
            if size >= WINDOW:
                yield out(parts, weights)
                parts, weights, size = [], [], 0
        if parts:
            yield out(parts, weights)

    ship(aligned.sparkSession)
    counts = stored(aligned.select("pairs", "times").mapInArrow(work, "pair bigint, count bigint").groupBy("pair").agg(F.sum("count").alias("count")), "pairs")
    first = F.shiftright("pair", LOW).alias("first")
    most = counts.groupBy(first).agg(F.max("count").alias("most"))
    return stored(counts.withColumn("first", first).join(most, "first").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "counts")


def _held(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``key, n_best, count_sum`` with the counts in every task."""
    rows = counts.sort("pair").toArrow()  # HELD rows at most
    pair, count, best = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "count", "best"))
    shared = aligned.sparkSession.sparkContext.broadcast((pair.astype(np.uint32), count, best))

    def work(batches: Iterator[tuple]) -> Iterator[tuple]:
        pair, count, best = shared.value
        for key, pairs, occurrences in batches:
            at = np.searchsorted(pair, np.frombuffer(pairs, np.uint32))
            n = np.frombuffer(occurrences, np.uint32).astype(np.int64)
            yield key, int(n[best[at]].sum()), int(n @ count[at])

    return map_rows(aligned.select("key", "pairs", "occurrences"), work, "key binary, n_best bigint, count_sum bigint")


def _joined(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``key, n_best, count_sum`` by a join on the pair."""

    def work(batches: Iterator[tuple]) -> Iterator[tuple]:
        for key, pairs, occurrences in batches:
            for pair, n in zip(np.frombuffer(pairs, np.uint32).tolist(), np.frombuffer(occurrences, np.uint32).tolist()):
                yield key, pair, n

    rows = map_rows(aligned.select("key", "pairs", "occurrences"), work, "key binary, pair bigint, n bigint").join(counts.hint("merge"), "pair")
    return rows.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))


def alignments(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: one row for each document.

    ``bytes_path`` is a byte-level vocabulary (A, given space + text), ``pieces_path`` one of pieces (B, which adds the space
    itself). Null and empty texts, and those that the tokens of A or of B don't spell byte by byte, have no tokens: zeros and an
    empty digest. ``n_best`` are the links whose pair counts as much as any of its first id, ``count_sum`` the sum of the
    counts over the links. Repeated rows stay repeated and count again; rows with a null ``doc_id`` take part; an empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("times"))
    aligned = stored(_aligned_texts(texts, (bytes_path, pieces_path)), "aligned")
    counts = _pair_counts(aligned)
    measured = (_held if counts.count() <= HELD else _joined)(aligned, counts)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    whole = stored(aligned.select("key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(measured.hint("merge"), "key"), "measured")
    keyed = docs.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"))
    out = keyed.join(whole.hint("merge"), "key", "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in columns], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
