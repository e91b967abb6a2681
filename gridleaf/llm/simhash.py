"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius through sharded BK-trees.

Two fingerprints that differ in at most three bits agree on at least two of five bit blocks, so each fingerprint goes to
ten shards (a pair of blocks and their bits) and every link lies whole in one of them. A shard is a BK-tree: children
hang on integer distances to their parent, and a search follows only the edges within the radius. The trees are built
where their shard's fingerprints meet instead of being sent to all tasks, so none has to fit a broadcast. Shards above a
bound go through a finer split (five of eight blocks), and what is still large is dealt into pairs of bounded chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import ship
from .batches import map_rows, stored
from .components import components

RADIUS = 3
#: Fingerprints in one tree at most.
SHARD = 8192
#: (blocks, blocks that must agree): radius 3 leaves at least blocks - 3 blocks untouched.
SPLITS = [(5, 2), (8, 5)]
#: Pairs of a search front, and rows of one tree forest, that are held at once.
FRONT, FOREST = 1 << 18, 1 << 17


# --- fingerprints ----------------------------------------------------------


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash of the 3-word shingles (repeats count) of the lower-cased whole text; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) < 3:
        return digest(joined, 42)
    ends = list(accumulate(len(w) + 1 for w in words))
    hashes = [digest(joined[a:b], 42) for a, b in zip([0, *ends], [e - 1 for e in ends[2:]])]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > len(hashes)).tolist())


def _prints(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` but for the last, a binary text, and ``fp`` in its place."""

    def work(held: Iterator[tuple]) -> Iterator[tuple]:
        for *names, value in held:
            bits = fingerprint(value)
            yield *names, bits - (1 << 64) if bits >> 63 else bits

    return map_rows(rows, work, StructType([*rows.schema.fields[:-1], StructField("fp", LongType())]))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp`` (the 64 bits as a signed long), one row for each document. Null and blank texts have 0."""
    return _prints(docs.select(F.col(key), F.col(text).cast("binary").alias("fp")))


# --- BK-trees --------------------------------------------------------------


class Forest:
    """BK-trees of many groups at once, as arrays. ``groups`` is sorted; bits are distinct within a group."""

    def __init__(self, groups: np.ndarray, bits: np.ndarray):
        n = len(bits)
        self.bits = bits
        first = np.r_[True, groups[1:] != groups[:-1]]
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]
        parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64)
        active = np.flatnonzero(~first)
        at = self.root[active]
        while len(active):  # one level of all trees
            apart = np.bitwise_count(bits[active] ^ bits[at]).astype(np.int64)
            _, head, inverse = np.unique(at * 65 + apart, return_index=True, return_inverse=True)
            parent[active[head]], edge[active[head]] = at[head], apart[head]
            rest = np.ones(len(active), bool)
            rest[head] = False
            at, active = active[head][inverse][rest], active[rest]
        nodes = np.flatnonzero(~first)
        order = np.argsort(parent[nodes] * 65 + edge[nodes], kind="stable")
        self.child, self.slot = nodes[order], (parent[nodes] * 65 + edge[nodes])[order]

    def near(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, query > node, in pieces of bounded size."""
        n = len(self.bits)
        fronts = [(np.arange(i, min(n, i + FRONT // 8)), self.root[i : i + FRONT // 8]) for i in range(0, n, FRONT // 8)]
        while fronts:
            query, node = fronts.pop()
            if len(query) > FRONT:
                half = len(query) // 2
                fronts += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            apart = np.bitwise_count(self.bits[query] ^ self.bits[node]).astype(np.int64)
            hit = (apart <= radius) & (query > node)
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.slot, node * 65 + np.maximum(apart - radius, 1), "left")
            count = np.searchsorted(self.slot, node * 65 + np.minimum(apart + radius, 64), "right") - low
            ends = np.cumsum(count)
            if len(ends) and ends[-1]:
                step = np.arange(ends[-1]) - np.repeat(ends - count, count)
                fronts.append((np.repeat(query, count), self.child[np.repeat(low, count) + step]))

    def links(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links: every linked entry with the first one it reaches."""
        label = np.arange(len(self.bits))
        for a, b in self.near(radius):
            while True:
                high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
                open_ = high != low
                if not open_.any():
                    break
                np.minimum.at(label, high[open_], low[open_])
                while not np.array_equal(again := label[label], label):
                    label = again
        linked = np.flatnonzero(label != np.arange(len(label)))
        return linked, label[linked]


def shard_links(shards: DataFrame, radius: int) -> DataFrame:
    """``u, v``: a spanning forest of the links inside each shard of ``shard, fp``, one row for each linked entry."""

    def run(batches):
        held_keys, held_bits, held = [], [], 0

        def solve(keys: np.ndarray, bits: np.ndarray):
            same = keys[1:] == keys[:-1]
            busy = np.r_[False, same] | np.r_[same, False]
            if busy.any():
                bits = bits[busy]
                a, b = Forest(keys[busy], bits).links(radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(bits[a].view(np.int64)), pa.array(bits[b].view(np.int64))], names=["u", "v"])

        for batch in batches:
            held_keys.append(batch.column(0).to_numpy(zero_copy_only=False))
            held_bits.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            held += batch.num_rows
            if held >= FOREST:
                keys, bits = np.concatenate(held_keys), np.concatenate(held_bits)
                cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last shard may go on
                yield from solve(keys[:cut], bits[:cut])
                held_keys, held_bits, held = [keys[cut:]], [bits[cut:]], len(keys) - cut
        if held:
            yield from solve(np.concatenate(held_keys), np.concatenate(held_bits))

    ship(shards.sparkSession)
    return shards.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "u bigint, v bigint")


def shard_keys(fp: Column, blocks: int, agree: int) -> Column:
    """The shards of a fingerprint: for each choice of ``agree`` blocks, the choice's number and those blocks' bits."""
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for number, choice in enumerate(combinations(range(blocks), agree)):
        key: Column = F.lit(number).cast("bigint")
        for i in choice:
            width = ends[i + 1] - ends[i]
            part = F.shiftrightunsigned(fp, ends[i]).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
            key = F.shiftleft(key, width).bitwiseOR(part)
        keys.append(key)
    return F.array(*keys)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints ``fp`` that connect all within the radius (3 at most)."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius {radius}: the splits hold for 0 to {RADIUS}")
    found, rest = [], fps
    for blocks, agree in SPLITS:
        keyed = rest.select("fp", F.explode(shard_keys(F.col("fp"), blocks, agree)).alias("shard"))
        sizes = stored(keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards")
        busy = keyed.join(sizes.hint("merge"), "shard")
        found.append(stored(shard_links(busy.where(F.col("n") <= SHARD), radius), "links"))
        if sizes.where(F.col("n") > SHARD).isEmpty():
            break
        rest = stored(busy.where(F.col("n") > SHARD).select("fp").distinct(), "large")
    else:
        # chunk i meets chunk j in the shard (i, j): bounded trees, as many as the square of the chunks
        chunks = F.ceil(F.col("n") * 4 / SHARD).cast("int")
        dealt = busy.where(F.col("n") > SHARD).withColumn("c", F.pmod(F.xxhash64("fp"), chunks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1)))
        pairs = dealt.select("fp", F.xxhash64("shard", F.least("c", "o"), F.greatest("c", "o")).alias("shard"))
        found.append(stored(shard_links(pairs, radius), "links"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# --- documents -------------------------------------------------------------


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``key, fp, component_id``: one row for each document; the component is named by its smallest ``key``.

    Documents link when their fingerprints differ in ``radius`` bits or fewer. Null and blank texts have the
    fingerprint 0 and link like any other. Equal texts are one fingerprint, so a group of copies costs one entry in the
    trees. Rows with a null ``key`` take part; a component of null keys alone has a null name. Repeated rows stay
    repeated; an empty table gives no rows; other columns are not read.
    """
    marked = stored(fingerprints(docs, key, text), "fingerprints")
    names = stored(marked.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    rooted = _rooted(names, radius)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.select("fp", "root").join(least.hint("merge"), "root").select("fp", "component_id"), "named")
    return marked.join(named.hint("merge"), "fp").select(key, "fp", "component_id")


def _rooted(names: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints with ``root``: equal for all that links connect."""
    roots = stored(components(links(names.select("fp"), radius)).select(F.col("node").alias("fp"), "root"), "roots")
    return stored(names.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest ``key``, and of several the smallest text hash.

    A row is known by its ``key`` and its text, so different texts that share a ``key`` are judged one by one, and each group
    keeps exactly one row. Null keys come last: a group has one of these only where it has no other. Rows that agree in
    both are one; their other columns are those of any of them. All columns stay as they are, whatever their names.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("id"), F.xxhash64(F.col(text).cast("binary")).alias("hash"))
    marked = stored(_prints(docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text).cast("binary")).alias("hash"), F.col(text).cast("binary").alias("fp"))), "fingerprints")
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "hash")
    first = stored(marked.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    kept = stored(_rooted(first, RADIUS).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("kept"), F.col("first.hash").alias("by")), "kept")
    same = F.col("id").eqNullSafe(F.col("kept")) & (F.col("hash") == F.col("by"))
    return rows.join(kept.hint("merge"), same, "left_semi").dropDuplicates(["id", "hash"]).select("row.*")
