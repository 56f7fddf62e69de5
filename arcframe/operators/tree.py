"""Trees: implied directories, walks, link counts, inode numbers, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import modes, paths
from . import entries as E
from .order import checkpointed, numbered


class TreeError(ValueError):
    """Entries that can't form a tree."""


def implied_directories(entries: DataFrame, mode: int = 0o755, uid: int = 0, gid: int = 0, mtime: int = 0) -> DataFrame:
    """path and attributes of the directories that entries lie in but don't name, the root included."""
    steps = entries.select(F.explode(F.array_append(paths.ancestors(F.col("path")), F.lit(""))).alias("path")).distinct()
    missing = steps.join(entries.select("path").distinct(), "path", "left_anti")
    return missing.select("path", F.lit(modes.DIRECTORY | mode).alias("mode"), F.lit(uid).cast("long").alias("uid"), F.lit(gid).cast("long").alias("gid"), F.lit(mtime).cast("long").alias("mtime"))


def with_implied(entries: DataFrame, **defaults) -> DataFrame:
    """entries and the directories that they imply; other columns of the new rows are null."""
    return entries.unionByName(implied_directories(entries, **defaults), allowMissingColumns=True)


def conflicts(entries: DataFrame) -> DataFrame:
    """path and reason for each row that can't be put into the tree: a name that is there, or a parent that is no directory."""
    twice = entries.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("exists").alias("reason"))
    other = entries.where(~modes.is_type(F.col("mode"), modes.DIRECTORY)).select(F.col("path").alias("blocker")).distinct()
    below = entries.select("path", F.explode(paths.ancestors(F.col("path"))).alias("step"))
    blocked = below.join(other, F.col("step") == F.col("blocker"), "left_semi").select("path", F.lit("not a directory").alias("reason")).distinct()
    return twice.unionByName(blocked)


def insert(tree: DataFrame, entries: DataFrame, **defaults) -> DataFrame:
    """The tree with entries put in.

    A directory that so far was only implied takes the attributes of an explicit one; links get the mode of
    links. Rows that conflict fail the query with their path; times are held within 32 bits.
    """
    link = modes.is_type(F.col("mode"), modes.LINK) | F.coalesce(F.col("hard_link"), F.lit(False))
    new = E.clamp_times(entries.withColumn("mode", F.when(link, F.lit(modes.LINK | 0o777)).otherwise(F.col("mode"))))
    together = tree.unionByName(new, allowMissingColumns=True)
    wrong = conflicts(together).groupBy().agg(F.min(F.concat_ws(": ", "path", "reason")).alias("wrong"))
    checked = together.crossJoin(F.broadcast(wrong)).where(F.when(F.col("wrong").isNotNull(), F.raise_error(F.col("wrong")).cast("boolean")).otherwise(True)).drop("wrong")
    return with_implied(checked, **defaults)


def walk(dirents: DataFrame, root: int, depth: int | None = None) -> DataFrame:
    """path, inode, depth and parent chain below the directory root, from rows (parent_inode, name, inode, type).

    One join a level, top down. An entry whose inode is that of a directory above it stops there, marked loop.
    """
    spark = dirents.sparkSession
    children = dirents.where(~F.col("name").isin(".", "..")).select(F.col("parent_inode").alias("p"), "name", F.col("inode").alias("child"), F.col("type").alias("child_type"))
    level = spark.createDataFrame([("", root, 0, 1, [root], False)], "path string, inode long, depth int, type int, chain array<long>, loop boolean")
    out = level
    while depth is None or depth > 0:
        inside = level.where((F.col("type") == 1) & ~F.col("loop"))
        loop = (F.col("child_type") == 1) & F.array_contains("chain", F.col("child"))
        level = checkpointed(
            inside.join(children, F.col("inode") == F.col("p")).select(
                E.join_path(F.col("path"), F.col("name")).alias("path"), F.col("child").alias("inode"), (F.col("depth") + 1).alias("depth"), F.col("child_type").alias("type"),
                F.array_append("chain", F.col("child")).alias("chain"), loop.alias("loop"),
            )
        )
        if level.isEmpty():
            return out
        out = out.unionByName(level)
        depth = None if depth is None else depth - 1
    return out


def loops(walked: DataFrame) -> DataFrame:
    """Entries that lead back to a directory above them."""
    return walked.where("loop").select("path", "inode")


def subtree(entries: DataFrame, top: str = "") -> DataFrame:
    return entries.where(paths.is_below(F.col("path"), top))


def resolve(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (path) with the entry there and error: null, 'no such entry', or 'not a directory' on the way."""
    asked = wanted.select(F.col("path").alias("asked"), paths.canonicalize(F.col("path")).alias("path"))
    found = asked.join(entries, "path", "left")
    other = entries.where(~modes.is_type(F.col("mode"), modes.DIRECTORY)).select(F.col("path").alias("blocker"))
    steps = asked.select(F.col("asked").alias("a"), F.explode(paths.ancestors(F.col("path"))).alias("step"))
    blocked = steps.join(other, F.col("step") == F.col("blocker"), "left_semi").select("a").distinct().withColumn("blocked", F.lit(True))
    error = F.when(F.col("mode").isNotNull(), F.lit(None)).when(F.col("blocked"), "not a directory").otherwise("no such entry")
    return found.join(blocked, F.col("asked").eqNullSafe(F.col("a")), "left").withColumn("error", error).drop("a", "blocked")


def link_counts(entries: DataFrame) -> DataFrame:
    """path and nlink: of a directory 2 and its children of any kind, of others 1 and the hard links that resolve to them.

    Hard links themselves, whose resolved target is in target, have no row.
    """
    rows = E.with_parts(entries)
    hard = F.coalesce(F.col("hard_link"), F.lit(False))
    children = rows.where(F.col("path") != "").groupBy(F.col("parent_path").alias("at")).agg(F.count("*").alias("n"))
    links = rows.where(hard).groupBy(F.col("target").alias("at")).agg(F.count("*").alias("n"))
    more = children.unionByName(links).groupBy("at").agg(F.sum("n").alias("n"))
    base = F.when(modes.is_type(F.col("mode"), modes.DIRECTORY), 2).otherwise(1)
    return rows.where(~hard).join(more, F.col("path") == F.col("at"), "left").select("path", (base + F.coalesce("n", F.lit(0))).cast("long").alias("nlink"))


def statistics(entries: DataFrame) -> DataFrame:
    """One row: files, directories, pipes and sockets, devices, hard links, symbolic links."""
    hard = F.coalesce(F.col("hard_link"), F.lit(False))
    kind = lambda *types: F.count_if(~hard & modes.is_type(F.col("mode"), *types))
    return entries.agg(
        kind(modes.FILE).alias("files"), kind(modes.DIRECTORY).alias("directories"), kind(modes.FIFO, modes.SOCKET).alias("ipc"), kind(modes.BLOCK, modes.CHARACTER).alias("devices"),
        F.count_if(hard).alias("hard_links"), kind(modes.LINK).alias("symlinks"),
    )


def count_entries(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"))


def inode_key() -> list:
    """Order of inode numbers: what is in a directory's subdirectories, then its own entries by name, the root last.

    That is the order of (components of the parent, then a sign that is greater than any name), then name.
    """
    above = F.array_append(paths.parts(F.coalesce(paths.parent(F.col("path")), F.lit(""))), F.lit(paths.LAST))
    return [(F.col("path") == "").cast("int"), above, paths.name(F.col("path"))]


def inode_numbers(entries: DataFrame, reorder: bool = True) -> DataFrame:
    """path and inode, from 1. Hard links take the number of their target and aren't counted.

    A target that would come after the first directory holding a link to it moves directly before that
    directory; several do so in the order of the links' names. target must hold the resolved path.
    """
    hard = F.coalesce(F.col("hard_link"), F.lit(False)) if "hard_link" in entries.columns else F.lit(False)
    own = numbered(entries.where(~hard).select("path", "mode"), inode_key(), "inode").select("path", "mode", "inode")
    if not reorder or "hard_link" not in entries.columns:
        return own.select("path", "inode")
    links = E.with_parts(entries.where(hard)).select(F.col("parent_path").alias("holder"), F.col("name").alias("link"), F.col("target"))
    holders = own.select(F.col("path").alias("holder"), F.col("inode").alias("holder_inode"))
    first = links.join(holders, "holder").groupBy(F.col("target").alias("path")).agg(F.min(F.struct("holder_inode", "link")).alias("first"))
    moved = own.withColumnRenamed("inode", "old").join(first, "path", "left")
    early = F.col("first.holder_inode") < F.col("old")
    order = [F.when(early, F.col("first.holder_inode")).otherwise(F.col("old")), F.when(early, 0).otherwise(1), F.when(early, F.col("first.link"))]
    return numbered(moved, order, "inode").select("path", "inode")


def file_list(entries: DataFrame) -> DataFrame:
    """Regular files with seq, their place in depth-first order."""
    return numbered(entries.where(modes.is_type(F.col("mode"), modes.FILE)), [E.path_key()], "seq", 0)


def children_first(entries: DataFrame) -> DataFrame:
    """Entries with the deepest first, as attributes are set: a directory's time last."""
    return entries.orderBy(paths.depth(F.col("path")).desc(), "path")


def attribute_order(entries: DataFrame) -> DataFrame:
    """entries with position, from 0, in the order of ``children_first``."""
    return numbered(entries, [-paths.depth(F.col("path")), F.col("path")], "position", 0)


def path_of_nodes(nodes: DataFrame) -> DataFrame:
    """node and path from rows (node, parent, name), the root's parent being null; path is null in a loop or above an unknown node."""
    start = F.when(F.col("parent").isNull(), "").otherwise(F.col("name"))
    rows = checkpointed(nodes.select("node", F.col("parent").alias("up"), start.alias("path")))
    while True:  # each round doubles how far a row has looked up
        pending = rows.where(F.col("up").isNotNull())
        left = pending.count()
        if not left:
            break
        above = rows.select(F.col("node").alias("n"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        # above an unknown node there is neither a way on nor a path
        stepped = pending.join(above, F.col("up") == F.col("n"), "left").select("node", F.col("up2").alias("up"), E.join_path(F.col("path2"), F.col("path")).alias("path"))
        rows = checkpointed(rows.where(F.col("up").isNull()).unionByName(stepped))
        if rows.where(F.col("up").isNotNull()).count() == left:  # what stays are loops and what hangs on them
            break
    return rows.select("node", F.when(F.col("up").isNull(), F.col("path")).alias("path"))
