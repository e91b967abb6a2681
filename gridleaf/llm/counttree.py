"""Near-duplicates by the Jaccard index of word shingles, through R-trees over count vectors.

A document is the set of its distinct 3-word shingles, each a 64-bit hash. Hash ranges are groups, and the counts of a
document's shingles in the groups are a point. Two sets share at most the sum of the smaller counts, and whatever lies in
two boxes of an R-tree at most the sum of the smaller upper edges, which prunes pairs of boxes and then pairs of points;
what survives is verified on the sets.

No tree could hold a corpus, so documents first meet in *cells*. Sets with a Jaccard index of ``PERCENT`` or more and H shingles
at most differ in k = 2 H (100 - PERCENT) / (100 + PERCENT) shingles at most. Cut into k + 1 + SPARE groups they have at
least 1 + SPARE groups in common, and one of these isn't empty unless both have more than SPARE empty groups. The hash
of a group's content is a cell. The documents that cells connect form a block, and a block is one tree, or where it is
large trees over pairs of its chunks. Every link lies in a block, so none is lost; cells that connect documents by
mistake cost time only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .batches import map_rows, stored
from .components import components
from .words import mix

PERCENT, SHINGLE = 90, 3
#: Ratio of the size classes, and empty groups that a document may have without a cell for them.
RATIO, SPARE = 1.4, 2
#: Documents and shingles in one chunk of a block at most (a longer document is a chunk of its own).
CHUNK, SHINGLES = 4096, 1 << 22
#: Entries of a node, and pairs that are bounded at once.
FAN, FRONT = 16, 1 << 14


# --- sets and cells --------------------------------------------------------


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a lower-cased UTF-8 text; with fewer words, of the whole sequence; empty without words."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh3_64_intdigest
    if len(words) < size:
        return np.array([digest(joined)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    found = {joined[a:b] for a, b in zip([0, *ends], [e - 1 for e in ends[size - 1 :]])}
    return np.unique(np.fromiter(map(digest, found), np.uint64, len(found)))


def groups(hashes: np.ndarray, n: int) -> np.ndarray:
    """The group of each hash out of n: equal ranges, so sorted hashes have sorted groups."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def cells(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The cells of a set. Sets that link share one in the size class of the larger."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    out, spread = [], mix(hashes)
    size_class = 0
    while RATIO ** (size_class + 1) <= n:
        size_class += 1
    # the class of its own size, and the classes of the larger sets that it could link with
    while 100 * n >= percent * RATIO**size_class:
        most = int(RATIO ** (size_class + 1)) + 1
        parts = 2 * most * (100 - percent) // (100 + percent) + 1 + SPARE
        at = groups(hashes, parts)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        with np.errstate(over="ignore"):
            name = mix(at[first].astype(np.uint64) + np.uint64((size_class + 1) << 40))
            out.append(mix(np.add.reduceat(spread, first) + name))
            if parts - len(first) > SPARE:
                empty = np.setdiff1d(np.arange(parts), at[first]).astype(np.uint64)
                out.append(mix(mix(empty + np.uint64((size_class + 1) << 40))))
        size_class += 1
    return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link: 100 times the intersection is at least ``percent`` times the union."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


# --- the tree --------------------------------------------------------------


class CountTree:
    """An R-tree over count vectors, packed level by level: sorted by size, then by the coarse halves of the vector."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent, self.sets = percent, sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        width = 16
        while width < 512 and width * 16 < self.sizes.max(initial=0):
            width *= 2
        vectors = np.stack([np.bincount(groups(s, width), minlength=width) for s in sets]).astype(np.int32)
        half = vectors[:, : width // 2].sum(axis=1)
        self.order = np.lexsort((half, (np.log(self.sizes) * 20).astype(int)))
        low = high = vectors[self.order]
        sizes = self.sizes[self.order]
        #: From the points up: lower and upper edges, and the smallest and greatest size below a node.
        self.levels = [(low, high, sizes, sizes)]
        while len(low) > 1:
            cut = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((low, high, np.minimum.reduceat(self.levels[-1][2], cut), np.maximum.reduceat(self.levels[-1][3], cut)))

    def _near(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether points below two nodes could share enough: the sum of the smaller upper edges against what the smallest sizes need."""
        _, high, least, most = self.levels[level]
        shared = np.minimum(np.minimum(high[a], high[b]).sum(axis=1, dtype=np.int64), np.minimum(most[a], most[b]))
        return (100 + self.percent) * shared >= self.percent * (least[a] + least[b])

    def candidates(self, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places whose bound allows a link, in pieces; pairs that ``label`` (by place in the tree) joins by then are left out."""
        top = len(self.levels) - 1
        fronts = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while fronts:
            level, a, b = fronts.pop()
            if len(a) > FRONT:
                half = len(a) // 2
                fronts += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            if level == 0:
                open_ = (a < b) & (label[a] != label[b])
                a, b = a[open_], b[open_]
            keep = self._near(level, a, b)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            below = len(self.levels[level - 1][2])
            step = np.arange(FAN)
            x = np.repeat(a[:, None] * FAN + step, FAN, axis=1).ravel()
            y = np.tile(b[:, None] * FAN + step, (1, FAN)).ravel()
            inside = (x < below) & (y < below) & (x <= y)
            fronts.append((level - 1, x[inside], y[inside]))

    def links(self) -> list[tuple[int, int]]:
        """A spanning forest of the links, as pairs of positions in ``sets``; each pair in it was verified on the sets."""
        label, found = np.arange(len(self.sets)), []
        for a, b in self.candidates(label):
            for i, j in zip(a.tolist(), b.tolist()):
                if label[i] != label[j] and linked(self.sets[self.order[i]], self.sets[self.order[j]], self.percent):
                    label[label == label[j]] = label[i]
                    found.append((int(self.order[i]), int(self.order[j])))
        return found


# --- documents -------------------------------------------------------------


def _marked(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """``key, n, sig, hashed, cells``: the set's size and 128-bit signature, the text's hash; cells once for each set and task."""

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        seen: set[bytes] = set()
        for name, value in rows:
            found = shingles(value)
            if not len(found):
                yield name, 0, None, None, []
                continue
            sig = xxhash.xxh3_128_digest(found.tobytes())
            new = sig not in seen
            seen.add(sig)
            yield name, len(found), sig, xxhash.xxh3_64_intdigest(value) - (1 << 63), cells(found, percent).view(np.int64).tolist() if new else []

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    return map_rows(docs.select(F.col(key), F.col(text).cast("binary")), work, f"key {kind}, n int, sig binary, hashed bigint, cells array<bigint>")


def _blocks(marked: DataFrame) -> DataFrame:
    """``sig, n, hashed, id, block, chunks``: one row for each set that a cell connects with another."""
    brief = F.xxhash64("sig").alias("brief")
    dealt = marked.select(brief, F.explode("cells").alias("cell"))
    # aggregated before the shuffle; what joins a much shared cell can be split
    busy = dealt.groupBy("cell").agg(F.min("brief").alias("least"), F.max("brief").alias("most")).where("least <> most").drop("most")
    edges = dealt.join(busy.hint("merge"), "cell").where("brief <> least").select("brief", "least").distinct()
    roots = stored(components(edges.toDF("u", "v")), "blocks")
    nodes = roots.select(F.col("node").alias("brief"), F.col("root").alias("block")).unionByName(roots.select(F.col("root").alias("brief"), F.col("root").alias("block")).distinct())
    sets = marked.where("n > 0").groupBy("sig", "n").agg(F.min("hashed").alias("hashed")).withColumn("brief", brief)
    members = stored(sets.join(nodes.hint("merge"), "brief").drop("brief").withColumn("id", F.monotonically_increasing_id()), "members")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("chunks")
    sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("sets"), chunks).where("sets > 1").drop("sets")
    return stored(members.join(sizes.hint("merge"), "block"), "sized")


def _links(docs: DataFrame, members: DataFrame, text: str, percent: int) -> DataFrame:
    """``u, v``: links between the sets of ``members`` (by id) that connect all that link."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(bloom.build(members.select("hashed"), members.count()))

    def sets(batches: Iterator[tuple]) -> Iterator[tuple]:
        seen: set[int] = set()
        for (value,) in batches:
            hashed = xxhash.xxh3_64_intdigest(value)
            if hashed not in seen and wanted.value.has(np.array([hashed], np.uint64) ^ np.uint64(1 << 63))[0]:
                seen.add(hashed)
                found = shingles(value)
                yield hashed - (1 << 63), xxhash.xxh3_128_digest(found.tobytes()), found.tobytes()

    found = map_rows(docs.where(F.col(text).isNotNull()).select(F.col(text).cast("binary")), sets, "hashed bigint, sig binary, found binary")
    whole = found.join(members.hint("merge"), ["hashed", "sig"])
    dealt = whole.withColumn("c", F.pmod(F.xxhash64("id"), "chunks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # chunk i meets chunk j under (i, j)
    shards = dealt.select("block", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "id", "found").repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "id")

    def solve(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, ids, known = None, [], []
        for block, i, j, id_, value in rows:
            if (block, i, j) != held:
                yield from _solved(ids, known, percent)
                held, ids, known = (block, i, j), [], []
            if not ids or ids[-1] != id_:  # copies of a text come once from each task
                ids.append(id_)
                known.append(np.frombuffer(value, np.uint64))
        yield from _solved(ids, known, percent)

    return map_rows(shards, solve, "u bigint, v bigint")


def _solved(ids: list[int], known: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    if len(ids) == 2:
        return [tuple(ids)] if linked(*known, percent) else []
    return [(ids[i], ids[j]) for i, j in CountTree(known, percent).links()] if len(ids) > 2 else []


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``key, n_shingles, component_id``: one row for each document; the component is named by its smallest ``key``.

    Documents link when 100 times the size of the intersection of their shingle sets is at least ``percent`` times that of the
    union. Null and blank texts have no shingle and link with nothing: their component is their own ``key``. Equal sets
    are one entry of a tree, so a group of copies costs no more than one document. Rows with a null ``key`` take part; a
    component of null keys alone has a null name. Repeated rows stay repeated and texts that share a ``key`` are judged one by
    one; an empty table gives no rows; other columns are not read. Shingles are compared as 64-bit hashes: two sets of s
    shingles are misjudged with a probability below s ** 2 / 2 ** 63.
    """
    if not 50 <= percent <= 100:
        raise ValueError(f"percent {percent}: 50 to 100 are possible")
    marked = stored(_marked(docs, key, text, percent), "marked")
    members = _blocks(marked)
    roots = components(_links(docs, members, text, percent))
    least = marked.where("n > 0").groupBy("sig").agg(F.min("key").alias("least"))
    named = stored(members.select("sig", "id").join(roots.hint("merge"), F.col("id") == F.col("node"), "left").select("sig", F.coalesce("root", "id").alias("root")), "rooted")
    of_sets = stored(least.join(named.hint("merge"), "sig", "left"), "least")
    of_roots = of_sets.where("root is not null").groupBy("root").agg(F.min("least").alias("name"))
    # the many sets that no cell connects with another keep out of the join
    names = of_sets.where("root is not null").join(of_roots.hint("merge"), "root").select("sig", "name").unionByName(of_sets.where("root is null").select("sig", F.col("least").alias("name")))
    out = marked.drop("cells", "hashed").join(names.hint("merge"), "sig", "left")
    return out.select(F.col("key").alias(key), F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("name")).alias("component_id"))
