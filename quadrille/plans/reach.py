"""Reachability over edges in a number of rounds that grows with the logarithm of the longest path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

#: Rounds of single steps before jumps are made: graphs of short paths end there.
STEPS = 4
#: Jumps of twice the length are made while their pairs are at most GROWTH times the edges.
GROWTH = 8


def reachable(seeds: DataFrame, edges: DataFrame, steps: int = STEPS, growth: int = GROWTH) -> DataFrame:
    """(x, y): the pairs of ``seeds`` (x, y) and, for each pair, what steps along ``edges`` (x, y) lead to from its y. Safe for cycles.

    First some rounds of single steps from what the last round found. Then a round takes all that was found since and jumps
    2, 4, 8, ... steps at once; jumps are pairs of nodes with a walk of exactly so many steps, so a pair is found once on a
    chain. Where jumps become too many (a graph of many cycles) their length stays, and only what is new goes on. Each round writes
    what is new only.
    """
    walks = materialize(edges.select("x", "y").distinct())
    most = growth * max(walks.count(), 1)
    found = [materialize(seeds.select("x", "y").distinct())]
    new, since, doubling, turn = found[0], [found[0]], True, 0
    while True:
        jump = walks.select(F.col("x").alias("__m"), F.col("y").alias("__z"))
        from_ = reduce(DataFrame.union, since) if turn >= steps and doubling else new
        reached = from_.join(jump, F.col("y") == F.col("__m")).select("x", F.col("__z").alias("y")).distinct()
        new = materialize(reached.join(reduce(DataFrame.union, found), ["x", "y"], "left_anti"))
        if new.isEmpty():
            return reduce(DataFrame.union, found)
        found.append(new)
        turn += 1
        if turn <= steps:  # jumps start from what the last single step found
            since = [new]
            continue
        since.append(new)
        if doubling:
            a, b = walks.alias("a"), walks.alias("b")
            longer = a.join(b, F.col("a.y") == F.col("b.x")).select(F.col("a.x").alias("x"), F.col("b.y").alias("y"))
            longer = materialize(longer.distinct())
            doubling = longer.count() <= most
            if doubling:
                walks = longer
            else:
                new = reduce(DataFrame.union, since)  # all of this may go on by the present length
