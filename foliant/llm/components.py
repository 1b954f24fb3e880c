"""Connected components of a link table, by contracting it round by round.

Each round sends every node to the smallest of its neighbours and itself,
shortens those steps by following them twice, and replaces the links by links
between targets. Links shrink geometrically even along sorted chains. All
tables are joined by node, and both sides of a join are stored tables, so the
adaptive join splits a node that has a third of all links.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.sizing import settle


def _jump(steps: DataFrame) -> DataFrame:
    """Follow every step once more."""
    nxt = steps.select(F.col("node").alias("_n"), F.col("target").alias("_t"))
    joined = steps.join(nxt, F.col("target") == F.col("_n"), "left")
    return joined.select("node", F.coalesce("_t", "target").alias("target"))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link.

    Links are undirected; self-links, repeats and nulls are allowed and add
    nothing. An empty table gives an empty table.
    """
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b"))
    pairs = settle(pairs.filter("a <> b").distinct())
    rounds: list[DataFrame] = []
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        steps = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("target"))
        steps = steps.select("node", F.least("node", "target").alias("target"))
        steps = settle(steps)
        steps = settle(_jump(settle(_jump(steps))))
        rounds.append(steps)
        to = lambda side: steps.select(F.col("node").alias(side), F.col("target").alias(f"_{side}"))
        moved = pairs.join(to("a"), "a").join(to("b"), "b").select(
            F.col("_a").alias("a"), F.col("_b").alias("b")
        )
        pairs = settle(moved.filter("a <> b").distinct())
    if not rounds:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def follow(found: DataFrame, steps: DataFrame) -> DataFrame:
        nxt = steps.select(F.col("node").alias("component"), F.col("target").alias("_t"))
        joined = settle(found).join(nxt, "component", "left")
        return joined.select("node", F.coalesce("_t", "component").alias("component"))

    first = rounds[0].select("node", F.col("target").alias("component"))
    return reduce(follow, rounds[1:], first)
