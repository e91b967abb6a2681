"""Connected components of a graph given as edges, by alternating star steps; no group is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import stored

#: A node's edges are dealt over so many parts when they meet its smallest neighbour.
SALT = 16


def _nearest(sides: DataFrame) -> DataFrame:
    """``u, v, m``: m is the smallest of u and its neighbours. Aggregated before the shuffle; hot nodes are salted."""
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = sides.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int"))
    return salted.join(least.hint("merge"), ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _nearest(down)
    return near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (u, v)`` that isn't a root itself; the root is the smallest node it reaches.

    Nodes are longs. Self-loops and repeated edges do no harm; rows with a null end are left out. Each round is written
    to the shared folder, so the plan stays short and a lost executor costs one round.
    """
    edges = stored(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = None
    while (now := _mark(edges)) != before:
        before = now
        if not now[0]:
            break
        edges = stored(_small_star(stored(_large_star(edges), "large")), "small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
