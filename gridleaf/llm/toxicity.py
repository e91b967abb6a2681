"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Texts are vectors of character 5-grams within words (hashed, sublinear counts, inverse document frequency over all
documents). Every gram of the sampled examples counts, more so the more the labels depend on it: none is cut. The
examples are a bounded sample of the labelled rows, ``EXAMPLES`` of each class, taken by hash.

Examples stand in blocks of like vectors, and the index knows each gram's greatest weight in each block. A query adds up
the postings of its rarer grams; what the common ones can add to any example of a block is bounded by the block's
greatest weights. Blocks are completed in the order of these bounds, the best first, and those whose bound falls short of
the nearest examples so far are skipped: the neighbours are exact. The neighbours vote with weights that grow with the
cosine and undo the sampling of the classes; their ids are the evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .batches import map_rows, read
from .grams import gram_ids
from .langid import remainder

SIZE, BITS = 5, 18
#: Sampled examples of a class, their grams in all (8 bytes each), neighbours that vote, blocks: bounds of the model.
EXAMPLES, GRAMS, NEAREST, BLOCKS = 2048, 1 << 23, 15, 64
#: Rounds of the clustering that makes the blocks, and the share of blocks (one in FIRST) that is completed first.
ROUNDS, FIRST = 8, 8
#: Texts that are scored at once.
QUERIES = 32
#: A gram that more than one in DENSE examples has is held as a full row.
DENSE = 16
#: Chi-squared value against the labels at which a gram has half of its weight, and weight of the share of toxic rows in a vote.
DEPENDS, PRIOR = 20.0, 0.05
#: Chi-squared value that every gram has besides its own, so that even one that tells nothing keeps a weight.
LEAST = 0.1


@dataclass
class Postings:
    """Gram by gram the (column, value) pairs of a matrix with few values: 8 bytes for each. Rows where more than one in
    DENSE columns has a value are full, at 4 * DENSE bytes a value at most."""

    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    columns: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    full: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # row -> place among the full ones, or -1
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    @staticmethod
    def of(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int, width: int) -> Postings:
        many = np.flatnonzero(np.bincount(rows, minlength=n) * DENSE > width)
        full = np.full(n, -1, np.int32)
        full[many] = np.arange(len(many))
        table = np.zeros((len(many), width), np.float32)
        inside = full[rows] >= 0
        table[full[rows[inside]], columns[inside]] = values[inside]
        rows, columns, values = rows[~inside], columns[~inside], values[~inside]
        order = np.lexsort((columns, rows))
        starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int64)
        return Postings(starts, columns[order].astype(np.int32), values[order].astype(np.float32), full, table)

    def sparse(self, rows: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """The sums of ``w`` times the rows that aren't full, over n columns."""
        begin, size = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.columns[at], weights=np.repeat(w, size) * self.values[at], minlength=n).astype(float)


def blocks(vectors: np.ndarray, n: int) -> np.ndarray:
    """A block out of n for each row, by spherical clustering from evenly spaced rows."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.maximum(norm, 1e-9)
    centres = unit[np.arange(n) * len(unit) // n]
    for _ in range(ROUNDS):
        mine = (unit @ centres.T).argmax(axis=1)
        for k in range(n):
            total = unit[mine == k].sum(axis=0)
            if np.any(total):
                centres[k] = total / np.linalg.norm(total)
    return mine


@dataclass
class Index:
    """The examples' weights by gram and block of examples, the greatest of them, and the labels."""

    place: np.ndarray = field(default_factory=lambda: np.full(1 << BITS, -1, np.int32))  # gram -> row, or -1
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # times the part that the labels' dependence gives
    postings: Postings = field(default_factory=Postings)
    edges: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # where the blocks begin, and the end of the last
    tables: list[np.ndarray] = field(default_factory=list)  # of each block the weights by common gram
    tops: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # and the greatest of them
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    votes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    prior: float = 0.0  # share of toxic rows among texts without any of the grams

    def hold(self, vectors: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """The index of the examples' vectors (rows, weights) over n grams; the order in which it keeps them."""
        lengths = np.array([len(at) for at, _ in vectors])
        owner = np.repeat(np.arange(len(vectors)), lengths)
        plain = Postings.of(np.concatenate([v[0] for v in vectors]), owner, np.concatenate([v[1] for v in vectors]), n, len(vectors))
        block = blocks(plain.table.T, min(BLOCKS, len(vectors)))
        order = np.argsort(block, kind="stable")
        self.edges = np.searchsorted(block[order], np.arange(block.max() + 2))
        self.edges = np.unique(self.edges)  # no empty blocks
        grams, values = (np.concatenate([vectors[e][k] for e in order]) for k in (0, 1))
        self.postings = Postings.of(grams, np.repeat(np.arange(len(vectors)), lengths[order]), values, n, len(vectors))
        self.tables = [np.ascontiguousarray(self.postings.table[:, a:b]) for a, b in zip(self.edges, self.edges[1:])]
        self.tops = np.stack([t.max(axis=1) for t in self.tables], axis=1)
        self.postings.table = np.zeros((0, 0), np.float32)
        return order

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and normalised weights of a whole text; empty where it has none of the grams."""
        found = [at[at >= 0] for at in (self.place[ids] for ids in gram_ids(text or "", SIZE, BITS))]
        rows, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int32), np.empty(0))
        if not len(rows):
            return rows, np.empty(0, np.float32)
        w = (1 + np.log(counts)) * self.idf[rows]
        return rows, (w / np.linalg.norm(w)).astype(np.float32)

    def nearest(self, queries, k, only: int | None = None):
        """For each query the k examples with the greatest cosine above zero (ties: the smaller place), nearest first; and the cosines.

        ``queries`` are vectors (rows, weights); ``nearest(rows, weights, k)`` gives the answer for one vector.
        """
        if only is not None:
            return self.nearest([(queries, k)], only)[0]
        common = np.zeros((len(queries), len(self.tops)), np.float32)
        total = np.empty((len(queries), len(self.names)))
        for i, (rows, w) in enumerate(queries):
            full = self.postings.full[rows]
            common[i, full[full >= 0]] = w[full >= 0]
            total[i] = self.postings.sparse(rows[full < 0], w[full < 0], len(self.names))
        bound = np.maximum.reduceat(total, self.edges[:-1], axis=1) + common @ self.tops
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, : -(-bound.shape[1] // FIRST)], True, axis=1)
        done = np.zeros(bound.shape, bool)
        for part in (first, ~first):
            open_ = part & (bound >= self._least(total, k)[:, None] - 1e-5) & (bound > 0)
            for b in np.flatnonzero(open_.any(axis=0)).tolist():
                mine = np.flatnonzero(open_[:, b])
                total[mine, self.edges[b] : self.edges[b + 1]] += common[mine] @ self.tables[b]
            done |= open_
        chosen = (total >= self._least(total, k)[:, None] - 1e-5) & (total > 0) & np.repeat(done, np.diff(self.edges), axis=1)
        out = []
        for cosines, mine in zip(np.round(total, 6), chosen):  # equal examples may differ in the last bits of their sums
            places = np.flatnonzero(mine)
            best = places[np.lexsort((places, -cosines[places]))[:k]]
            out.append((best, cosines[best]))
        return out

    @staticmethod
    def _least(total: np.ndarray, k: int) -> np.ndarray:
        """The k-th greatest sum of each query so far."""
        return np.partition(total, -k, axis=1)[:, -k] if total.shape[1] > k else np.zeros(len(total))

    def score(self, texts: list[str | None]) -> list[tuple[float, list[int], list[float]]]:
        """Probability of label 1, and the neighbours with their cosines."""
        vectors = [self.vector(t) for t in texts]
        known = [i for i, (rows, _) in enumerate(vectors) if len(rows) and len(self.names)]
        found = dict(zip(known, self.nearest([vectors[i] for i in known], NEAREST))) if known else {}
        out = []
        for i in range(len(texts)):
            at, cosines = found.get(i, ((), ()))
            if not len(at):
                out.append((self.prior, [], []))
                continue
            vote = self.votes[at] * cosines**2
            score = (float(vote @ self.toxic[at]) + PRIOR * self.prior) / (float(vote.sum()) + PRIOR)
            out.append((min(1.0, max(0.0, score)), self.names[at].tolist(), cosines.tolist()))
        return out


def examples(labels: DataFrame, size: int = EXAMPLES) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, label`` of the sample (rows that aren't held out, ``size`` of each class at most), and all rows of each class.

    A document with several labels counts with the greatest one; null labels and ids are left out.
    """
    known = labels.where((remainder(F.col("doc_id")) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(0.0)
    for label, n in totals.items():
        rate = F.when(F.col("label") == label, F.lit(min(1.0, (1.2 * size + 50) / n))).otherwise(rate)
    near = known.withColumn("rank", F.xxhash64("doc_id", F.lit(3))).where(F.col("rank") / F.lit(2.0**64) + F.lit(0.5) <= rate)
    order = Window.partitionBy("label").orderBy("rank", "doc_id")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).select("doc_id", "label"), totals


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """The index. Document frequencies cover all of ``docs``; labels come from the sample only."""
    spark = docs.sparkSession
    ship(spark)
    sample, totals = examples(labels)
    chosen = {r.doc_id: r.label for r in sample.collect()}  # 2 * EXAMPLES rows at most
    count = {c: sum(v == c for v in chosen.values()) for c in (0, 1)}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    if not count[0] or not count[1]:
        return Index(prior=share)
    shared = spark.sparkContext.broadcast(chosen)

    def frequencies(batches):
        names = ["dim", "n", "pos", "neg"]
        seen, last = np.zeros((3, 1 << BITS), np.int64), np.zeros(1 << BITS, np.int64)
        docs_seen, labelled = 0, [0, 0]
        for doc_id, text in read(batches):
            parts = list(gram_ids(text or "", SIZE, BITS))
            docs_seen += 1
            ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
            turn = np.arange(len(ids))
            last[ids] = turn
            once = ids[last[ids] == turn]
            seen[0, once] += 1
            label = shared.value.get(doc_id)
            if label is not None:
                labelled[label] += 1
                seen[2 - label, once] += 1
        at = np.flatnonzero(seen[0])
        for i in range(0, len(at), 1 << 16):
            d = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), *[pa.array(s[d]) for s in seen]], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *[pa.array([v], pa.int64()) for v in (docs_seen, labelled[1], labelled[0])]], names=names)

    grams = docs.select("doc_id", "text").mapInArrow(frequencies, "dim int, n bigint, pos bigint, neg bigint").groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "pos", "neg")])
    a, b = F.col("pos"), F.col("neg")
    # every gram of a sampled example: 2 ** BITS rows at most
    rows = grams.where((F.col("dim") < 0) | (a + b > 0)).toArrow().sort_by("dim")
    dims, n, pos, neg = (rows.column(c).to_numpy() for c in ("dim", "n", "pos", "neg"))
    p, q = (float(x[dims < 0].sum()) for x in (pos, neg))  # labelled rows, repeated ones too
    apart = (pos * (q - neg) - neg * (p - pos)) ** 2.0
    chi = (p + q) * apart / np.maximum(1.0, p * q * (pos + neg) * np.maximum(1.0, p + q - pos - neg))
    total, (dims, n, chi) = int(n[dims < 0].sum()), (x[dims >= 0] for x in (dims, n, chi))
    index = Index(prior=share)
    if not len(dims):
        return index
    index.place[dims] = np.arange(len(dims))
    tells = (chi + LEAST) / (chi + LEAST + DEPENDS)
    index.idf = ((np.log((1 + total) / (1 + n)) + 1) * tells).astype(np.float32)
    model = spark.sparkContext.broadcast(index)

    def vectors(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            at, w = model.value.vector(text)
            yield doc_id, at.astype("<i4").tobytes(), w.astype("<f4").tobytes()

    mine = docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    made = map_rows(mine, vectors, "doc_id bigint, at binary, w binary").groupBy("doc_id").agg(F.min(F.struct("at", "w")).alias("v")).select("doc_id", "v.*")
    # of each class the first by hash whose grams the model has room for
    so_far = F.sum(F.length("at") / 4).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id"))
    got = made.join(F.broadcast(sample), "doc_id").withColumn("so_far", so_far).where(F.col("so_far") <= GRAMS // 2).select("doc_id", "at", "w").collect()
    plain = {c: sum(not r.at and chosen[r.doc_id] == c for r in got) for c in (0, 1)}
    scale = {c: totals[c] / max(1, sum(chosen[r.doc_id] == c for r in got)) for c in (0, 1)}
    if plain[0] or plain[1]:
        index.prior = plain[1] * scale[1] / (plain[0] * scale[0] + plain[1] * scale[1])
    held = sorted(((r.doc_id, np.frombuffer(r.at, "<i4"), np.frombuffer(r.w, "<f4")) for r in got if r.at), key=lambda h: h[0])
    if not held:
        return index
    order = index.hold([(at, w) for _, at, w in held], len(dims))
    held = [held[e] for e in order]
    least = min(scale.values())
    index.names = np.array([h[0] for h in held], np.int64)
    index.toxic = np.array([chosen[i] for i, _, _ in held], float)
    index.votes = np.array([scale[chosen[i]] / least for i, _, _ in held])
    return index


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence, cosines``: one row for each document.

    ``score`` estimates the probability of ``labels.toxic = 1``; ``evidence`` are the ids of the voting examples, nearest
    first. Labels, lang, source and doc_id never enter a score. Texts without a gram of an example (null and empty ones too)
    get the share of toxic rows among such texts. Without labelled rows of both classes all scores are the share of
    class 1 (0 without labels). A null ``doc_id`` is not held out and has no label. Repeated rows stay repeated; an empty
    table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        while held := list(islice(rows, QUERIES)):
            for (doc_id, _), (score, names, cosines) in zip(held, shared.value.score([text for _, text in held])):
                yield doc_id, score, int(score >= 0.5), names, cosines

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_rows(docs.select("doc_id", "text"), work, f"doc_id {kind}, score double, predicted int, evidence array<bigint>, cosines array<double>")
    return out.withColumn("held_out", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)))
