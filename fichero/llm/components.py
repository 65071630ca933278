"""Connected components of a graph of links, by alternating large-star and small-star.

Every step is a grouped minimum and a join on the links: no group is gathered, and a node of many links is a
skewed join key that adaptive execution splits. Lineage is cut after each round by a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its greater neighbours to the least of its neighbourhood."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links itself and its lesser neighbours to the least of them. Links have u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """node, component (least node reachable) for every node with a link to another. links: u, v in any order."""
    now = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch.write(now)
    mark = _mark(now)
    for _ in range(most):
        last, now = now, scratch.write(_small_star(_large_star(now)))
        scratch.drop(last)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(links: DataFrame) -> tuple:
    """Number and order-free checksum of links."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
