"""Substring deduplication by relative Lempel-Ziv parsing.

Each document is parsed against the documents before it (smaller ids): greedily into factors that are copies of a
reference. The index holds every block of ``WINDOW`` words that can repeat, under the first document that has it. At a
factor's end the next block is looked up anew, also where it overlaps the factor, so a copy that goes on in another
reference is not lost. Factors have at least ``WINDOW`` words and are the duplicate spans.

To index only blocks that can repeat, each block is represented by its anchor, the shingle of ``ANCHOR`` words with the
smallest hash inside it: equal blocks have equal anchors. One pass finds the anchors that more than one document has
(about six in a hundred words are anchors), a second one hashes the blocks around those, a third parses. Hashes have 64
bits; two blocks are taken as equal when both their anchors and their own hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, read, stored
from .words import split, window_hashes, word_hashes

WINDOW, ANCHOR = 50, 18
_PLACE = np.uint64((1 << 24) - 1)


def window_anchors(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a text: the place of its anchor. And the hashes of all shingles.

    The anchor is the shingle with the smallest hash in the window, the first of equals, so it depends on the window alone.
    """
    shingles = window_hashes(hashes, anchor)
    span = window - anchor + 1
    n = len(shingles) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), shingles
    # the upper bits of the hash, then the place: one minimum finds both (places repeat far beyond any window)
    low = (shingles & ~_PLACE) | (np.arange(len(shingles), dtype=np.uint64) & _PLACE)
    width, least = 1, low
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    least = np.minimum(least[:n], least[rest : rest + n])
    starts = np.arange(n)
    return starts + ((least & _PLACE).astype(np.int64) - starts) % (1 << 24), shingles


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc`` (null ids after all others), ``row`` (equal only for equal rows) and ``data``, the UTF-8 text."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("data"),
    )


def _with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Documents with the list found for them (null: none); the text is shuffled once, by document."""
    return docs.join(lists.hint("merge"), ["doc", "row"], "left")


def repeated_blocks(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The index as seen from each document: ``doc, row, found``, an array of ``(start, ref)``: the starts of the
    document's blocks that an earlier document has too, with the first such document."""
    keyed = _keyed(docs)

    def anchors(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, row, data in rows:
            at, shingles = window_anchors(word_hashes(split(data)), window, anchor)
            for h in np.unique(shingles[at]).view(np.int64).tolist() if len(at) else ():
                yield doc, row, h

    marks = stored(map_rows(keyed, anchors, "doc bigint, row bigint, anchor bigint"), "anchors")
    shared = stored(marks.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("anchor"), "shared")
    lists = stored(marks.join(shared.hint("merge"), "anchor").groupBy("doc", "row").agg(F.collect_set("anchor").alias("anchors")), "lists")

    def blocks(batches):
        schema = pa.schema([("block", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32())])
        for doc, row, data, wanted in read(batches):
            if not wanted:
                continue
            hashes = word_hashes(split(data))
            at, shingles = window_anchors(hashes, window, anchor)
            hit = np.flatnonzero(np.isin(shingles[at], np.array(wanted, np.int64).view(np.uint64)))
            found = window_hashes(hashes, window)[hit].view(np.int64)
            for i in range(0, len(hit), 1 << 16):
                n = len(hit[i : i + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(found[i : i + n]), pa.array(np.full(n, doc)), pa.array(np.full(n, row)), pa.array(hit[i : i + n].astype(np.int32))], schema=schema)

    candidates = stored(_with_lists(keyed, lists).select("doc", "row", "data", "anchors").mapInArrow(blocks, "block bigint, doc bigint, row bigint, start int"), "blocks")
    index = stored(candidates.groupBy("block").agg(F.min("doc").alias("ref"), F.max("doc").alias("last")).where("ref < last").select("block", "ref"), "index")
    hits = candidates.join(index.hint("merge"), "block").where("ref < doc")
    return hits.groupBy("doc", "row").agg(F.collect_set(F.struct("start", "ref")).alias("found"))


def factors(found: list, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Greedy parse of one document: ``(start, length, ref)`` of its factors, from its blocks with a reference.

    A factor runs on while the next block has the same reference; at its end the block there opens a new one.
    """
    out: list[list[int]] = []
    end = -1
    for start, ref in sorted((f["start"], f["ref"]) for f in found):
        if out and start == end + 1 and ref == out[-1][2]:
            out[-1][1] += 1
        else:
            out.append([start, window, ref])
        end = start
    return [tuple(f) for f in out]


def covered(spans: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """True for each of ``n`` words inside a factor."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, _ in spans:
        edges[start] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:-1] > 0


def parsed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, start, length, ref_doc``: the factors of every document that has one."""
    found = stored(repeated_blocks(docs, window), "found")

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, hits in rows:
            for start, length, ref in factors(hits, window):
                yield doc, start, length, ref

    return map_rows(found.select("doc", "found"), work, "doc_id bigint, start bigint, length bigint, ref_doc bigint")


def deduplicated(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept`` with ``texts``), one row for each document.

    A word goes when a window of ``window`` words over it also starts in a document with a smaller ``doc_id``; windows
    are judged on the input. ``kept`` holds the other words joined by one space. Null and blank texts have no words and
    keep the empty text. A null ``doc_id`` comes after all others. Rows with the same id don't remove from each other;
    repeated rows stay repeated. Texts shorter than the window lose nothing; an empty table gives no rows; other columns
    are not read. A task holds one document's words at a time.
    """
    found = stored(repeated_blocks(docs, window), "found")
    schema = "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * texts

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, data, hits in rows:
            words = split(data)
            gone = 0
            kept = words
            if hits:
                out = covered(factors(hits, window), len(words))
                gone = int(out.sum())
                kept = [w for w, o in zip(words, out.tolist()) if not o]
            joined = b" ".join(kept)
            name = None if doc == (1 << 63) - 1 else doc
            yield (name, len(words), gone, hashlib.sha256(joined).hexdigest(), *([joined.decode("utf-8", "replace")] * texts))

    rows = _with_lists(_keyed(docs), found).select("doc", "data", "found")
    return map_rows(rows, work, schema).withColumnRenamed("doc", "doc_id").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all their columns, their texts without the duplicate spans; texts that lose nothing stay as they are."""
    found = stored(repeated_blocks(docs, window), "found")  # ships the package too
    key = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("doc_id", "text").alias("row")]
    rows = docs.select(*key, F.struct(*docs.columns).alias("whole")).join(found.hint("merge"), ["doc", "row"], "left").select("whole", "found")
    chars = "n_chars" in docs.columns

    def run(batches):
        for batch in batches:
            whole = dict(zip(docs_columns, batch.column(0).flatten()))
            texts = []
            for text, hits in zip(whole["text"], batch.column(1)):
                text, hits = text.as_py(), hits.as_py()
                if hits:
                    words = split(text.encode("utf-8", "surrogatepass"))
                    gone = covered(factors(hits, window), len(words)).tolist()
                    text = b" ".join([w for w, g in zip(words, gone) if not g]).decode("utf-8", "replace")
                texts.append((text, bool(hits)))
            whole["text"] = pa.array([t for t, _ in texts], whole["text"].type)
            if chars:
                sizes = [len(t) if cut else n.as_py() for (t, cut), n in zip(texts, whole["n_chars"])]
                whole["n_chars"] = pa.array(sizes, whole["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(whole.values()), names=docs_columns)

    docs_columns = docs.columns
    return rows.mapInArrow(run, docs.schema)
