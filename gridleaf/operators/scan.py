"""Ordered work on groups of any size.

A plain window puts a whole group into one task. Here a group is first reduced to a small
summary (one row per cell or per distinct coordinate, combined on the map side); only the
summary is put in order, and its result goes back to the rows by an equi join that AQE can split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 65536


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", grown: bool = True) -> DataFrame:
    """Equi join in which null keys match each other, so no row is lost to a null.

    ``grown`` sides come out of an ``explode`` or an aggregate, which the size estimate does not see;
    they are always shuffled (AQE splits hot keys), never broadcast on a guess.
    """
    right = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    right = right.hint("merge") if grown else right
    return left.join(right, same, how).drop(*[f"__r_{k}" for k in keys])


def number_rows(df: DataFrame, keys: list[str], cells: list[Column], order: list[str], name: str) -> DataFrame:
    """Position (from 0) of each row in its group, for groups of any size.

    ``cells`` are columns that never decrease along ``order`` and split a group in small parts,
    for instance a sequence number divided by ``CHUNK``.
    """
    marks = [f"__cell{i}" for i in range(len(cells))]
    marked = df.select("*", *[c.alias(m) for c, m in zip(cells, marks)])
    by_group = W.partitionBy(*keys).orderBy(*marks).rowsBetween(W.unboundedPreceding, -1)
    before = (
        marked.groupBy(*keys, *marks)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, *marks, F.coalesce(F.sum("__n").over(by_group), F.lit(0)).alias("__before"))
    )
    joined = null_safe_join(marked, before, keys + marks)
    inside = F.row_number().over(W.partitionBy(*keys, *marks).orderBy(*order))
    return joined.withColumn(name, (F.col("__before") + inside - 1).cast("bigint")).drop("__before", *marks)


def running_total(df: DataFrame, keys: list[str], seq: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group; ``seq`` is a unique whole number per group."""
    marked = df.withColumn("__cell", F.floor(F.col(seq) / CHUNK))
    earlier = W.partitionBy(*keys).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    before = (
        marked.groupBy(*keys, "__cell")
        .agg(F.sum(value).alias("__sum"))
        .select(*keys, "__cell", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__ahead"))
    )
    inside = W.partitionBy(*keys, "__cell").orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    return (
        null_safe_join(marked, before, keys + ["__cell"])
        .withColumn(name, F.col("__ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("__cell", "__ahead")
    )


def islands(df: DataFrame, keys: list[str], low: str, high: str, gap: int) -> DataFrame:
    """``keys, low -> island``: intervals at least ``gap`` apart lie on different islands.

    Works on one row per distinct ``low``, so a group costs as many rows as it has coordinates.
    """
    edge = df.groupBy(*keys, low).agg(F.max(high).alias("__high"))
    along = W.partitionBy(*keys).orderBy(low)
    reach = F.max("__high").over(along.rowsBetween(W.unboundedPreceding, -1))
    opens = F.coalesce((F.col(low) - reach) >= gap, F.lit(False))
    return (
        edge.withColumn("__open", opens.cast("int"))
        .withColumn("island", F.sum("__open").over(along.rowsBetween(W.unboundedPreceding, 0)))
        .select(*keys, low, "__high", "island")
    )
