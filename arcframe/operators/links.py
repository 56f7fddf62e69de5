"""Hard links: found by device and inode, followed to what they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import modes
from .order import checkpointed, join_counted


def detect(entries: DataFrame) -> DataFrame:
    """entries with target and hard_link set on each later name of a file: target is the first name by seq.

    Directories are left alone. The first name of each (dev, inode) is an aggregate with map-side minima, so
    that a file with very many names doesn't meet in one task.
    """
    directory = modes.is_type(F.col("mode"), modes.DIRECTORY)
    first = entries.where(~directory).groupBy("dev", "inode").agg(F.min(F.struct("seq", "path")).alias("first"), F.count("*").alias("names")).where("names > 1")
    rows = join_counted(entries, first, ["dev", "inode"], "names", "left").drop("names")
    later = ~directory & F.col("first").isNotNull() & (F.col("seq") > F.col("first.seq"))
    target = F.when(later, F.col("first.path"))
    target = F.coalesce(target, F.col("target")) if "target" in entries.columns else target
    return rows.withColumns({"hard_link": F.coalesce(later, F.lit(False)), "target": target}).drop("first")


def resolve(entries: DataFrame) -> DataFrame:
    """Hard links with what they lead to in the end: path, target, resolved and error.

    error is 'loop' for links that lead back to themselves, 'directory' for those to directories and 'missing'
    where there is no such path; null otherwise. Each round doubles how many links a row has followed.
    """
    hard = F.coalesce(F.col("hard_link"), F.lit(False))
    step = checkpointed(entries.where(hard).select("path", "target", F.col("target").alias("at")))
    on_links = -1
    while True:
        jump = step.select(F.col("path").alias("from"), F.col("at").alias("to"))
        moved = step.join(jump, F.col("at") == F.col("from"), "left")
        step = checkpointed(moved.select("path", "target", F.coalesce("to", "at").alias("at"), F.col("from").isNotNull().alias("moved")))
        # where a chain of some length ends, so do chains of all lesser ones: once a round ends none, only loops go on
        before, on_links = on_links, step.where("moved").count()
        if on_links in (0, before):
            break
    ends = entries.select(F.col("path").alias("end"), modes.type_of(F.col("mode")).alias("kind"), hard.alias("is_link"))
    found = step.join(ends, F.col("at") == F.col("end"), "left")
    error = F.when(F.col("end").isNull(), "missing").when(F.col("is_link"), "loop").when(F.col("kind") == modes.DIRECTORY, "directory")
    return found.select("path", "target", F.when(error.isNull(), F.col("at")).alias("resolved"), error.alias("error"))


def link_to_resolved(entries: DataFrame) -> DataFrame:
    """entries whose hard links point at what they stand for."""
    found = resolve(entries).select("path", "resolved")
    return entries.join(found, "path", "left").withColumn("target", F.coalesce("resolved", "target")).drop("resolved")
