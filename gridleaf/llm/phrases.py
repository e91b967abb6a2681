"""Phrases of several words that hold together, mined with Rabin-Karp fingerprints of all n-grams.

A batch of texts is one byte array; the prefix sums of byte times power of the base (modulo 2 ** 64) give the
polynomial hash of any span, so numpy hashes every n-gram of a batch at once. Three passes over the texts:

1. fingerprints of all words and word pairs with their counts, summed by a shuffle; those found often enough stay;
2. the same for three and four words, only where every pair in them may be frequent;
3. every n-gram with a frequent fingerprint is compared, byte by byte, with the text at its batch's first occurrence pointer;
   what differs is a collision and becomes a phrase of its own. Only now phrases are texts: their exact counts are summed, and
   the smallest pointer (document, word) stays with each.

The frequent fingerprints reach the tasks as filters of a bounded size (``bloom``). What a filter or a collision lets through
too much costs time; it can't change a count, since the third pass counts phrases as texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship
from . import bloom
from .batches import read, stored
from .words import BASE, mix

LONGEST, LEAST, TOP = 4, 30, 2000
#: A candidate inside a longer one with this share of its count (percent) is part of it.
PART = 80
#: Bytes of text in one array (a longer piece without punctuation is one array), and fingerprints counted in a task at once.
BATCH, WINDOW = 1 << 20, 1 << 21
#: Bits of a fingerprint (tests take few, so that many collide).
FOLD = 64

#: A-Z in lower case; everything that ends a piece is a line feed; a tab is a space.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_INVERSE = pow(int(BASE), -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BATCH + (1 << 16))
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)]) for base in (BASE, np.uint64(_INVERSE))]
    return _powers


@dataclass
class Grams:
    """The words of one array of texts. Word i is ``data[starts[i]:ends[i]]``; a space follows each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    piece: np.ndarray
    doc: np.ndarray  # the text of each word
    order: np.ndarray  # place of each word in its text
    tongue: np.ndarray  # the language of each word, as its place in langs
    langs: list[str]

    @staticmethod
    def of(pieces: list[tuple[bytes, int, int, str]]) -> Grams:
        """From translated texts: (bytes, number of the text, words before it in its text, language)."""
        raw = np.frombuffer(b"\n".join([p[0] for p in pieces]) + b"\n", np.uint8)
        word = (raw != 10) & (raw != 32)
        before = np.r_[False, word[:-1]]
        at = np.flatnonzero(word & ~before)
        data = np.where(word, raw, np.uint8(32))[word | before]
        lengths = np.flatnonzero(~word & before) - at
        ends = np.cumsum(lengths + 1) - 1
        text = np.searchsorted(np.cumsum([len(p[0]) + 1 for p in pieces]), at, "right")
        first = np.searchsorted(text, np.arange(len(pieces)), "left")
        langs = sorted({p[3] for p in pieces})
        number, skipped, tongue = (np.array(x, np.int64) for x in ([p[1] for p in pieces], [p[2] for p in pieces], [langs.index(p[3]) for p in pieces]))
        return Grams(data, ends - lengths, ends, np.cumsum(raw == 10)[at], number[text], np.arange(len(at)) - first[text] + skipped[text], tongue[text], langs)

    def prefix(self) -> np.ndarray:
        """Sums of byte times power before each place."""
        power = _power_tables(len(self.data) + 1)[0]
        with np.errstate(over="ignore"):
            return np.r_[np.uint64(0), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)])]

    def span(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n words from each place on begin and end."""
        m = max(0, len(self.starts) - n + 1)
        return self.starts[:m], self.ends[n - 1 : n - 1 + m]

    def inside(self, n: int) -> np.ndarray:
        """Whether n words from each place on lie in one piece."""
        m = max(0, len(self.starts) - n + 1)
        return self.piece[:m] == self.piece[n - 1 : n - 1 + m]

    def prints(self, prefix: np.ndarray, n: int, fold: int) -> np.ndarray:
        """Fingerprints of ``fold`` bits of n words from each place on, with the language in them."""
        a, b = self.span(n)
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode(), 11) for x in self.langs], np.uint64)
        with np.errstate(over="ignore"):
            out = mix((prefix[b] - prefix[a]) * _power_tables(len(self.data) + 1)[1][a] + seeds[self.tongue[: len(a)]])
        return out if fold == 64 else mix(out >> np.uint64(64 - fold))


def _pieces(rows: Iterator[tuple], batch: int) -> Iterator[tuple[list, list]]:
    """Batches of translated texts, and the ``doc_id`` of each text by number. Very long texts are cut where a piece ends."""
    held, size, names = [], 0, []
    for doc_id, lang, text in rows:
        names.append(doc_id)
        rest, done = (text or b"").translate(_TABLE), 0
        while rest:
            cut = rest.rfind(b"\n", 0, batch) if len(rest) > batch else len(rest)
            cut = rest.find(b"\n", batch) if cut < 0 else cut
            cut = len(rest) if cut < 0 else cut
            part, rest = rest[:cut], rest[cut + 1 :]
            held.append((part, len(names) - 1, done, lang or "und"))
            done += len(part.split()) if rest else 0
            size += len(part) + 1
            if size >= batch:
                yield held, names
                held, size, names = [], 0, names[-1:]
    if held:
        yield held, names


def _sums(parts: list[np.ndarray]) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["print", "count"])


def _frequent(docs: DataFrame, least: int, pairs=None) -> DataFrame:
    """``print, count`` of the fingerprints found ``least`` times: of one and two words or, with the filter of pairs, of three and more."""

    batch, window, fold = BATCH, WINDOW, FOLD

    def work(batches):
        parts, size = [], 0
        for pieces, _ in _pieces(read(batches), batch):
            grams = Grams.of(pieces)
            prefix = grams.prefix()
            if pairs is None:
                found = [grams.prints(prefix, n, fold)[grams.inside(n)] for n in (1, 2)]
            else:
                two = pairs.value.has(grams.prints(prefix, 2, fold)) & grams.inside(2)
                found = []
                for n in range(3, LONGEST + 1):
                    m = max(0, len(grams.starts) - n + 1)
                    good = np.logical_and.reduce([two[j : j + m] for j in range(n - 1)])
                    found.append(grams.prints(prefix, n, fold)[good])
            parts += found
            size += sum(map(len, found))
            if size >= window:
                yield _sums(parts)
                parts, size = [], 0
        if size:
            yield _sums(parts)

    out = docs.mapInArrow(work, "print bigint, count bigint").groupBy("print").agg(F.sum("count").alias("count"))
    return stored(out.where(F.col("count") >= least), "prints")


def differing(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which spans of equal length, from ``a`` and from ``b`` on, aren't the same bytes."""
    out = np.zeros(len(a), bool)
    ends = np.cumsum(lengths)
    i = 0
    while i < len(a):  # a bounded number of bytes at once
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20), "right")))
        n = lengths[i:j]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        unequal = data[np.repeat(a[i:j], n) + step] != data[np.repeat(b[i:j], n) + step]
        out[i:j] = np.add.reduceat(unequal, np.cumsum(n) - n) > 0 if len(step) else False
        i = j
    return out


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    n = ends - starts
    offsets = np.r_[0, np.cumsum(n)]
    gathered = data[np.repeat(starts - offsets[:-1], n) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(gathered.tobytes()))


def _materialised(docs: DataFrame, wanted) -> DataFrame:
    """``lang, phrase, words, count, doc, word``: the n-grams that ``wanted`` lets through, batch by batch, as texts compared with the
    text at their pointer; and all words of each language with ``words`` 0."""
    kind = docs.select("doc_id").schema[0].dataType
    names = ["lang", "phrase", "words", "count", "doc", "word"]
    arrow, batch, fold = to_arrow_type(kind), BATCH, FOLD

    def work(batches):
        for pieces, ids in _pieces(read(batches), batch):
            pieces.sort(key=lambda p: (ids[p[1]] is None, ids[p[1]] if ids[p[1]] is not None else 0))  # the first occurrence is the smallest
            grams = Grams.of(pieces)
            prefix = grams.prefix()

            def out(phrases, words, places, counts):
                langs = [grams.langs[k] for k in grams.tongue[places].tolist()]
                docs_ = pa.array([ids[k] for k in grams.doc[places].tolist()], arrow)
                return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), phrases, pa.array(np.full(len(langs), words, np.int32)), pa.array(np.asarray(counts, np.int64)), docs_, pa.array(grams.order[places])], names=names)

            first, counts = np.unique(grams.tongue, return_index=True, return_counts=True)[1:]
            yield out(pa.array([""] * len(first), pa.string()), 0, first, counts)
            for n in range(1, LONGEST + 1):
                prints = grams.prints(prefix, n, fold)
                at = np.flatnonzero(grams.inside(n) & wanted.value.has(prints))
                if not len(at):
                    continue
                starts, ends = grams.span(n)
                pointer, same = np.unique(prints[at], return_index=True, return_inverse=True)[1:]
                pointer = at[pointer]
                mine = pointer[same]
                bad = (ends[at] - starts[at] != ends[mine] - starts[mine]) | (grams.tongue[at] != grams.tongue[mine])
                fine = np.flatnonzero(~bad)
                bad[fine] = differing(grams.data, starts[at[fine]], starts[mine[fine]], ends[at[fine]] - starts[at[fine]])
                yield out(_texts(grams.data, starts[pointer], ends[pointer]), n, pointer, np.bincount(same[~bad], minlength=len(pointer)))
                others: dict[tuple[int, bytes], list[int]] = {}
                for k in at[bad].tolist():  # collisions
                    others.setdefault((int(grams.tongue[k]), grams.data[starts[k] : ends[k]].tobytes()), []).append(k)
                if others:
                    heads = np.array([v[0] for v in others.values()])
                    yield out(_texts(grams.data, starts[heads], ends[heads]), n, heads, [len(v) for v in others.values()])

    return docs.mapInArrow(work, f"lang string, phrase string, words int, count bigint, doc {kind.simpleString()}, word bigint")


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, phrase, words, f, first``: every phrase of one to four words found ``least`` times in its language, with its exact count
    and its smallest pointer ``(doc, word)``; and for each language a row with ``words`` 0 and the count of all its words."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select("doc_id", "lang", F.col("text").cast("binary").alias("text"))
    short = _frequent(texts, least)
    pairs = spark.sparkContext.broadcast(bloom.build(short.select("print"), short.count()))
    both = stored(short.unionByName(_frequent(texts, least, pairs)).select("print"), "wanted")
    wanted = spark.sparkContext.broadcast(bloom.build(both, both.count()))
    pointer = F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "word"))).alias("first")
    counted = _materialised(texts, wanted).groupBy("lang", "words", "phrase").agg(F.sum("count").alias("f"), pointer)
    return stored(counted.where((F.col("f") >= least) | (F.col("words") == 0)), "phrases")


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, part: int = PART) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score, first``: the ``top`` phrases of two to four words in each language.

    Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends; words are what spaces and tabs separate; null
    texts have none, a null ``lang`` is ``und``. A candidate is found ``a >= least`` times. Its score is the lowest over its cuts
    in two parts, found l and r times: floor(2000000 a / (l + r)), ties to the first cut. Candidates inside a longer
    one with at least ``part`` percent of their count are dropped. Ranks go by score and a, descending, then by the bytes of
    the phrase. ``first`` is (doc_id, word number) of an occurrence with the smallest id, null where all have a null ``doc_id``.
    Repeated rows count as often as they come; an empty table gives no rows; other columns are not read.
    """
    known = frequent_phrases(docs, least)
    phrases = known.where("words >= 1")
    candidates = phrases.where("words >= 2")
    cuts = F.expr("transform(sequence(1, words - 1), k -> named_struct('k', k, 'head', substring_index(phrase, ' ', k), 'tail', substring_index(phrase, ' ', k - words)))")
    cut = candidates.select("lang", "phrase", F.col("f").alias("a"), "first", F.explode(cuts).alias("cut")).select("*", "cut.*")
    heads, tails = (phrases.select("lang", F.col("phrase").alias(p), F.col("f").alias(c)) for p, c in (("head", "l"), ("tail", "r")))
    parted = cut.join(heads.hint("merge"), ["lang", "head"]).join(tails.hint("merge"), ["lang", "tail"])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = parted.withColumn("score", score).groupBy("lang", "phrase", "a", "first").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    inner = F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> array_join(slice(split(phrase, ' '), s, m), ' '))))"
    )
    longer = phrases.where("words >= 3").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    alone = F.col("longest").isNull() | (_exact("longest") * 100 < _exact("a") * part)
    kept = scored.join(longer.hint("merge"), ["lang", "phrase"], "left").where(alone).select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score", "first")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    totals = known.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "first")
