"""Language identification by the nearest of several centroids per language.

A text is a TF-IDF vector of character 3-grams (hashed, sublinear counts, length one). Document frequencies come from
all learning rows. The centroids come from a bounded sample of them: ``Model.sample`` documents per language, taken by
hash, clustered by cosine on the executors. A text whose cosine to its nearest centroid is far below what that language
showed for texts of its size is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import map_rows
from .grams import gram_counts

SIZE, BITS = 3, 14
#: Dense vectors that are copied at once.
PART = 32
#: Size classes of texts, by the power of two of their distinct grams.
CLASSES = BITS + 1
#: Sampled texts of a language and size class from which their lowest cosine is taken as a floor.
ENOUGH = 20
#: A text of FEW distinct grams or more with a smaller cosine than FAR shares next to nothing with any language.
FEW, FAR = 8, 0.02
#: Part of its floor that a text has to reach. Short clean texts full of names and numbers come down to a third of it.
SLACK = 0.15


@dataclass
class Model:
    """What a prediction needs: languages x clusters x 2 ** BITS floats, about 64 KB for each centroid."""

    langs: list[str] = field(default_factory=list)  # of each centroid
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    idf: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    floor: np.ndarray = field(default_factory=lambda: np.zeros((0, CLASSES)))  # lowest cosine seen, by centroid and size class


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids, weights`` of the normalised TF-IDF vector."""
    ids, counts = gram_counts(text, SIZE, BITS)
    weights = (1 + np.log(counts)) * idf[ids] if len(ids) else np.empty(0)
    norm = np.sqrt((weights * weights).sum())
    return ids, (weights / norm if norm else weights).astype(np.float32)


def size_class(n: int) -> int:
    return max(0, int(n).bit_length() - 1)


def _total(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``rows[at].sum(axis=0)``, added in the same order, without a copy of all those rows."""
    total = rows[at[:1]].sum(axis=0)
    for i in range(1, len(at), PART):
        total = np.concatenate([total[None], rows[at[i : i + PART]]]).sum(axis=0)
    return total


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts: ``centroids, labels``. Fewer rows or equal rows give fewer centroids."""
    picks = [0]
    best = rows @ rows[0]
    while len(picks) < k and best.min() < 0.999:
        picks.append(int(best.argmin()))
        best = np.maximum(best, rows @ rows[picks[-1]])
    centres = rows[picks]
    for _ in range(rounds):
        labels = (rows @ centres.T).argmax(axis=1)
        means = [_total(rows, np.flatnonzero(labels == i)) for i in range(len(centres)) if (labels == i).any()]
        centres = np.stack([m / max(np.linalg.norm(m), 1e-9) for m in means])
    return centres, (rows @ centres.T).argmax(axis=1)


def remainder(key: Column) -> Column:
    """``crc32(key as text) mod 5``; null for a null key."""
    return F.when(key.isNotNull(), F.crc32(key.cast("string").cast("binary")) % 5)


def fit(docs: DataFrame, learn: Column, sample: int = 1000, clusters: int = 4) -> Model:
    """Learn from the rows of ``docs (text, lang)`` where ``learn`` holds and text and lang are not null.

    Document frequencies and language counts cover all those rows; centroids come from ``sample`` distinct texts per
    language at most (the smallest hashes; copies count once). Without such rows the model knows no language.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")

    def frequencies(batch: Iterator[tuple]) -> Iterator[tuple]:
        df, langs = np.zeros((1 << BITS) + 1, np.int64), {}
        for text, lang in batch:
            ids, _ = gram_counts(text, SIZE, BITS)
            if len(ids):
                df[ids] += 1
                df[-1] += 1
                langs[lang] = langs.get(lang, 0) + 1
        for i in np.flatnonzero(df).tolist():
            yield i, None, int(df[i])
        for lang, n in langs.items():
            yield None, lang, n

    seen = map_rows(rows, frequencies, "dim int, lang string, n bigint").groupBy("dim", "lang").agg(F.sum("n").alias("n")).collect()
    df = np.zeros((1 << BITS) + 1)
    for r in seen:
        if r.dim is not None:
            df[r.dim] = r.n
    langs = {r.lang: r.n for r in seen if r.dim is None}
    if not langs:
        return Model()
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    hashed = rows.withColumn("rank", F.xxhash64("text", F.lit(5)))
    counted = hashed.select("lang", "rank").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    distinct = {r.lang: r.n for r in counted.collect() if r.lang in langs}
    rates = F.create_map(*[F.lit(x) for lang, n in distinct.items() for x in (lang, min(1.0, (1.5 * sample + 20) / n))])
    rate = F.coalesce(F.try_element_at(rates, F.col("lang")), F.lit(0.0))
    order = Window.partitionBy("lang").orderBy("rank", F.length("text"))
    near = hashed.where((F.col("rank") / F.lit(2.0**64) + F.lit(0.5)) <= rate).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    ranked = near.select("lang", "rank", "text").withColumn("place", F.row_number().over(order))
    picked = ranked.where(F.col("place") <= sample).select("lang", "text")

    def vectors(batch: Iterator[tuple]) -> Iterator[tuple]:
        for lang, text in batch:
            ids, weights = vector(text, idf)
            if len(ids):
                yield lang, ids.astype("<i4").tobytes(), weights.astype("<f4").tobytes()

    def centres(group: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((len(group), 1 << BITS), np.float32)
        sizes = []
        for i, (ids, weights) in enumerate(zip(group.ids, group.weights)):
            at = np.frombuffer(ids, "<i4")
            dense[i, at] = np.frombuffer(weights, "<f4")
            sizes.append(size_class(len(at)))
        found, labels = cluster(dense, clusters)
        cosines = np.concatenate([(dense[i : i + PART] * found[labels[i : i + PART]]).sum(axis=1) for i in range(0, len(dense), PART)])
        sizes = np.array(sizes)
        # longer texts come nearer: a size class with too few texts in the sample has the floor of the next smaller one
        line, held = [], 0.0
        for k in range(CLASSES):
            held = float(cosines[sizes == k].min()) if (sizes == k).sum() >= ENOUGH else held
            line.append(held)
        return pd.DataFrame({"lang": group.lang.iloc[0], "centre": [c.astype("<f4").tobytes() for c in found], "floor": [line] * len(found)})

    made = map_rows(picked, vectors, "lang string, ids binary, weights binary").groupBy("lang").applyInPandas(centres, "lang string, centre binary, floor array<double>")
    out = sorted(made.collect(), key=lambda r: (r.lang, r.centre))
    if not out:
        return Model()
    return Model([r.lang for r in out], np.stack([np.frombuffer(r.centre, "<f4") for r in out], axis=1), idf, np.array([r.floor for r in out]))


def nearest(text: str | None, model: Model, slack: float = SLACK) -> tuple[str, float, bool]:
    """Language, cosine, and whether the cosine is near enough."""
    ids, weights = vector(text, model.idf)
    if not len(ids) or not model.langs:
        return "und", 0.0, bool(len(ids))
    cosines = weights @ model.centroids[ids]
    best = int(cosines.argmax())
    score = float(min(1.0, max(0.0, cosines[best])))
    floor = max(slack * float(model.floor[best, size_class(len(ids))]), FAR if len(ids) >= FEW else 0.0)
    return model.langs[best], score, score >= floor


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", slack: float = SLACK) -> DataFrame:
    """``key, lang_pred, score, accepted``: one row for each document.

    ``score`` is the cosine to the nearest centroid; ``accepted`` is false for texts without a letter and where the score
    is under ``slack`` times the lowest one of the sample for that size of text. Null texts and texts without a letter
    are ``und`` with score 0; a model without languages calls every text ``und`` and accepts those with a letter. Ties
    go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see Model

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for name, value in rows:
            yield (name, *nearest(value, shared.value, slack))

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    return map_rows(docs.select(key, text), work, f"key {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("key", key)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out (``crc32(doc_id) mod 5 <> 0``) and predict every row of ``docs``.

    ``lang``, ``source`` and ``doc_id`` never enter a prediction; other columns are not read. A null ``doc_id`` is
    neither learnt from nor held out. Repeated rows stay repeated; an empty table gives no rows.
    """
    model = fit(docs, remainder(F.col("doc_id")) != 0)
    out = predict(docs, model)
    return out.withColumn("held_out", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose language is recognised; see ``identify`` and ``predict``."""
    model = fit(docs, remainder(F.col("doc_id")) != 0)  # ships the package too
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see Model

    def run(batches):
        for batch in batches:
            keep = [nearest(value.as_py(), shared.value)[2] for value in batch.column("text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
