"""Ranks inside groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Slices that a group is cut into: a group of a third of all rows still spreads over so many tasks. It is a
#: constant so that ranks depend on the rows alone.
SLICES = 1024


def with_slice(rows: DataFrame, order: list[Column], seed: int = 0) -> DataFrame:
    """rows with a column slice: a seeded hash of order."""
    return rows.withColumn("slice", F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(SLICES)).cast("int"))


def slice_starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slice, n (rows of that slice of the group), start (rows of the group in slices before it).

    The keys must not be null. The window runs over the counts of the slices, not over rows.
    """
    counts = rows.groupBy(*keys, "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def rank_in_slice(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows with rank, from 0 in each slice of a group; start + rank numbers the group's rows."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "slice").orderBy(*order)).cast("long") - 1)
