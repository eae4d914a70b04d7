"""Connected components of a link table by alternating stars.

Each round ties every node's larger neighbours to the smallest node it sees, then
every node and its smaller neighbours to the smallest of them. Links shrink to one
star per component in a number of rounds that grows with the logarithm of its size.
A hub's links are a plain join on the hub, which adaptive execution can split, and
its smallest neighbour is added up before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headcount.session import Scratch

MOST_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("hi", "lo").union(links.select(F.col("lo"), F.col("hi")))
    both = both.toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    return (
        links.join(least, "hi")
        .where(F.col("lo") != F.col("m"))
        .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .union(least.select("hi", F.col("m").alias("lo")))
        .distinct()
    )


def _print(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of `links` (columns a, b) but the roots themselves.

    The root is the smallest node of the component. Links may repeat, run either way
    or tie a node to itself; nulls are no nodes. Each round is written to the shared
    folder, so a lost executor costs one round; superseded rounds are dropped.
    """
    links = (
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    links, path = scratch.keep(links)
    seen = _print(links)
    for _ in range(MOST_ROUNDS):
        large, between = scratch.keep(_large_star(links))
        scratch.drop(path)
        links, path = scratch.keep(_small_star(large))
        scratch.drop(between)
        now = _print(links)
        if now == seen:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")
