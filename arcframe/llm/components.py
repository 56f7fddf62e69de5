"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


#: Rows of one node that may meet in one task in any case; nodes whose minima are broadcast, some MB.
FEW, HUBS = 512, 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _joined(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """rows (u, v) with m of their u, from least (u, m, n: the rows of u).

    Nodes with more than a small share of all rows, HUBS at most, are broadcast; the rows of any other are so few
    that they may meet in one task.
    """
    most = max(FEW, 2 * edges // HUBS)
    if edges <= FEW:
        return rows.join(least.drop("n"), "u")
    hubs = F.broadcast(least.where(F.col("n") > most).drop("n"))
    return rows.join(hubs, "u").unionByName(rows.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= most).drop("n"), "u"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: for each node of the edges (a, b), the smallest node that it is connected with.

    Each round lets every node's larger neighbours point at the smallest one, then its smaller ones; when a
    round changes nothing, all nodes of a component point at its smallest. The rounds grow with the
    logarithm of the nodes. Minima are combined on the map side and hubs' are broadcast; no neighbourhood is
    ever collected, and each round's edges are written to the checkpoint folder.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _kept(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), state[0])
        large = _kept(_joined(both, least, state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), state[0])
        lowest = _kept(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), state[0])
        small = _joined(large, lowest, state[0]).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        now = checkpointed(small.distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _kept(table: DataFrame, edges: int) -> DataFrame:
    """Tables that are used several times are written where that pays."""
    return checkpointed(table) if edges > FEW else table
