"""Mixing sources to target weights by pivotal dependent rounding.

A source's target gives each of its documents the same number of copies, whole ones plus a fraction. The fractions are
rounded in pairs: mass (words) moves from one document to the other, in the direction drawn so that expectations stay,
until one of the two is a whole copy or none; the other goes on to the next pair. The words of a source therefore add
up to its target at every step. Documents are dealt into bounded groups by hash; each group leaves one fractional
document at most, and these meet in a reduction tree of fixed fan-in. What is left at the root, one document of a
source, is taken in part, so the target is met to the word.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .batches import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in one group of the first level, groups that meet in one of the next.
GROUP, FAN = 4096, 64


def ranked(sources: DataFrame) -> DataFrame:
    """``rank``: the place of each source by code point, null last. Sorted in ranges; only one count for each range meets in one task."""
    spread = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    before = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return spread.join(before.drop("n"), "part").withColumn("rank", F.col("before") + inside - 1).drop("part", "before")


def targets(sources: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """``source, source_size, n, target`` from ``source, source_size, n``.

    Together the targets are ``share`` times all sizes, in proportion to the weights (dealt in order of the source's
    name, repeating), and none exceeds ``most`` times its source's size: what is above is shared anew by weight among
    the rest. The level is found by sums over the table of sources, which rises until no source changes sides.
    """
    choice = F.array(*[F.lit(float(w)) for w in weights])
    table = stored(ranked(sources).withColumn("weight", F.element_at(choice, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("most", F.lit(float(most)) * F.col("source_size")), "sources")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, before = 0.0, -1.0
    while level > before:
        full = F.lit(level) * F.col("weight") >= F.col("most")
        capped, free = table.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        before = level
        if free:
            level = max(level, (total - capped) / free)
    return table.select("source", "source_size", "n", F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"))


def pivotal(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Round ``p`` (0 to 1) so that the sum of ``p * size`` stays; one entry at most stays between 0 and 1."""
    p, size, draw = p.tolist(), size.tolist(), draw.tolist()
    last = -1
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if last < 0:
            last = i
            continue
        up = min((1 - p[last]) * size[last], p[i] * size[i])  # words that can move to `last`
        down = min((1 - p[i]) * size[i], p[last] * size[last])
        if draw[i] * (up + down) < down:
            a, b, moved = last, i, up
        else:
            a, b, moved = i, last, down
        # one of the two ends exactly on a bound
        tops, empties = moved >= (1 - p[a]) * size[a], moved >= p[b] * size[b]
        p[a] = 1.0 if tops else p[a] + moved / size[a]
        p[b] = 0.0 if empties else p[b] - moved / size[b]
        last = a if 0 < p[a] < 1 else b if 0 < p[b] < 1 else -1
    return np.array(p)


def _rounded(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["order", "doc_id", "size"], kind="stable")
    first = group.iloc[0]
    seed = xxhash.xxh64_intdigest(f"{first.source}/{first.level}/{first.bucket}".encode("utf-8", "surrogatepass"), 11)
    group["p"] = pivotal(group.p.to_numpy(), group["size"].to_numpy(), np.random.default_rng(seed).random(len(group)))
    return group


def _row() -> Column:
    """Equal for rows of the same id, text and source."""
    return F.xxhash64("doc_id", "text", F.lit(1), "source")


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, part, taken``: one row for each document.

    ``size`` counts words (null text: 0). The mix takes ``copies`` whole copies and the first ``part`` words once more;
    ``taken`` is the sum of the words, and adds up to within a word of ``target`` in each source. Only one document of a
    source has a ``part``. No document is taken more than ``most`` (2 at most) times its size. A run depends on ids,
    texts and weights alone, so reruns agree, however the rows are spread. Null sources are one source, last in order;
    null ids and repeated rows are documents like any other; documents without words take nothing; an empty table gives
    no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = stored(docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),  # as text: pandas would round long ids beside nulls
        "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        _row().alias("order"),
    ), "sizes")
    goal = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, most), "targets")
    # the table of sources is the small side whatever its size: shuffled, and hot sources are split by AQE
    right = goal.select(F.col("source").alias("s"), "source_size", "n", "target").hint("merge")
    joined = sized.join(right, F.coalesce("source", F.lit("")).eqNullSafe(F.coalesce("s", F.lit(""))) & (F.col("source").isNull() == F.col("s").isNull())).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ready = stored(
        joined.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("p", F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(0.0))
        .withColumn("bucket", F.pmod("order", F.ceil(F.col("n") / GROUP))).withColumn("level", F.lit(0)).drop("rate", "n"), "rates")
    schema = ready.schema
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    done, rest = [ready.where(~open_)], ready.where(open_)
    groups = -(-(goal.agg(F.max("n")).first()[0] or 0) // GROUP)
    while groups:
        level = stored(rest.groupBy("source", "bucket").applyInPandas(_rounded, schema), "level")
        done.append(level.where(~open_))
        rest = level.where(open_).withColumn("bucket", F.floor(F.col("bucket") / FAN)).withColumn("level", F.col("level") + 1)
        groups = 0 if groups == 1 else -(-groups // FAN)
    out = reduce(DataFrame.unionByName, [*done, rest])
    copies = F.col("whole") + F.when(F.col("p") == 1, 1).otherwise(0)
    part = F.when(open_, F.round(F.col("p") * F.col("size"))).otherwise(0).cast("bigint")
    out = out.select(F.col("doc_id").cast(kind), "source", "size", "source_size", "target", copies.cast("bigint").alias("copies"), part.alias("part"), "order")
    return out.select("*", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def mixed(docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents of the mix with all their columns, a copy a row; a part is the text's first words, joined by spaces.

    Rows that agree in id, text and source are one document with as many copies as they have together.
    """

    def name(order: Column) -> Column:
        return F.concat_ws("/", F.col("doc_id").cast("string"), order.cast("string")).alias("name")

    plan = mix(docs, weights, share, most).where("taken > 0").groupBy(name(F.col("order"))).agg(F.sum("copies").alias("copies"), F.max("part").alias("part"))
    # equal rows are one row here and their copies add up; a row is one column, so no name of its own can clash
    once = docs.select(name(_row()), F.struct("*").alias("row")).dropDuplicates(["name"])
    dealt = once.join(stored(plan, "plan").hint("merge"), "name")
    turns = dealt.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0))))
    cut = F.col("turn") > F.col("copies")
    words = F.filter(F.split(F.col("row")["text"], r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(cut, F.array_join(F.slice(words, 1, F.col("part").cast("int")), " ")).otherwise(F.col("row")["text"])
    new = {"text": text, "n_chars": F.when(cut, F.length(text)).otherwise(F.col("row")["n_chars"])} if "n_chars" in docs.columns else {"text": text}
    return turns.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col("row")[f.name].alias(f.name) for f in docs.schema])
