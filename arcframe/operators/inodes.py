"""Inodes and directory entries of images as tables: their relation to entries, layouts, runs and lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import modes
from . import dictionary, tree
from .order import scan

U16, U32 = 0xFFFF, 0xFFFFFFFF
#: Entries under one header of a directory, how far numbers may lie from the first, bytes of a metadata block.
RUN_ENTRIES, RUN_DELTA, META = 256, 32767, 8192


def needs_extended() -> Column:
    """Whether an inode's basic layout would lose something: of any its attributes, of a directory a long listing
    or an index, of a file a size or place beyond 32 bits, sparse bytes or more than one name."""
    mode = F.col("mode")
    size = F.col("size")
    directory = modes.is_type(mode, modes.DIRECTORY) & ((size > U16) | (F.coalesce(F.size("dir_index"), F.lit(0)) > 0))
    large = (size > U32) | (F.coalesce(F.col("block_start"), F.lit(0)) > U32) | (F.coalesce(F.col("sparse_bytes"), F.lit(0)) > 0) | (F.col("nlink") > 1)
    return F.col("xattr_index").isNotNull() | directory | (modes.is_type(mode, modes.FILE) & large)


def block_count(block_size: int) -> Column:
    """Whole blocks of a file, and its short last one unless that is in a fragment."""
    whole = F.floor(F.col("size") / block_size)
    more = F.col("fragment").isNull() & (F.col("size") % block_size > 0)
    return F.when(modes.is_type(F.col("mode"), modes.FILE), whole + more.cast("long")).otherwise(0).cast("long")


def fragment_location() -> Column:
    """Index and offset of a file's tail, null without one."""
    return F.when(F.col("fragment").isNotNull(), F.struct("fragment", "fragment_offset"))


def block_table(inodes: DataFrame) -> DataFrame:
    """A row for each block of each inode, and one with nulls for inodes without: inode, idx, stored, compressed, sparse, at."""
    from pyspark.sql.window import Window

    rows = inodes.select("inode", "block_start", F.posexplode_outer("block_sizes").alias("idx", "word"))
    stored = F.col("word").bitwiseAND((1 << 24) - 1)
    before = Window.partitionBy("inode").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"stored": stored, "compressed": (stored > 0) & (F.col("word").bitwiseAND(1 << 24) == 0), "sparse": F.col("word") == 0})
    return rows.withColumn("at", F.col("block_start") + F.coalesce(F.sum("stored").over(before), F.lit(0))).drop("block_start", "word")


def entries(inodes: DataFrame, dirents: DataFrame, ids: DataFrame, root: int) -> DataFrame:
    """Entries from the tables of one image: the tree is walked, and each name gets its inode's attributes and owners."""
    paths = tree.walk(dirents, root).select("path", "inode")
    owned = dictionary.decode_ids(inodes, ids)
    return paths.join(owned, "inode").select("path", "inode", "mode", "uid", "gid", "mtime", "size", "rdev", "target", "nlink")


#: Types of inodes by the type bits of a mode. The extended layout of a type has a number 7 larger.
INODE_TYPES = {modes.DIRECTORY: 1, modes.FILE: 2, modes.LINK: 3, modes.BLOCK: 4, modes.CHARACTER: 5, modes.FIFO: 6, modes.SOCKET: 7}


def from_entries(entries: DataFrame) -> DataFrame:
    """path and the inode's own fields of entries other than files and directories, whose data decide on theirs: type,
    mode, nlink, rdev (of devices) and target (of links). An attribute set or a second name asks for the extended layout."""
    special = entries.where(~modes.is_type(F.col("mode"), modes.FILE, modes.DIRECTORY))
    basic = F.lit(None).cast("int")
    for bits, number in INODE_TYPES.items():
        basic = F.when(modes.is_type(F.col("mode"), bits), number).otherwise(basic)
    extended = F.col("xattr_index").isNotNull()
    device = modes.is_type(F.col("mode"), modes.BLOCK, modes.CHARACTER)
    link = modes.is_type(F.col("mode"), modes.LINK)
    return special.select(
        "path", (basic + F.when(extended, 7).otherwise(0)).alias("type"), "mode", F.coalesce("nlink", F.lit(1)).cast("long").alias("nlink"), F.when(device, F.col("rdev")).alias("rdev"), F.when(link, F.col("target")).alias("target")
    )


def resolve_numbers(inodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (inode) with ref, null where there is no such inode."""
    return wanted.join(inodes.select("inode", "ref"), "inode", "left")


def export_table(inodes: DataFrame) -> DataFrame:
    """inode and ref for all numbers from 1 to the largest, ref null in the holes.

    The numbers of holes come from the gap after each inode, not from a list of all.
    """
    from pyspark.sql.window import Window

    after = Window.partitionBy(F.shiftright("inode", 16)).orderBy("inode")
    block = F.shiftright("inode", 16)
    # numbers are dealt into ranges of 65536; a range's own gaps are a window over it, those between ranges follow from its ends
    gaps = inodes.select("inode", F.lead("inode").over(after).alias("next")).where("next > inode + 1").select(F.explode(F.sequence(F.col("inode") + 1, F.col("next") - 1)).alias("inode"))
    ends = inodes.groupBy(block.alias("block")).agg(F.min("inode").alias("low"), F.max("inode").alias("high"))
    order = Window.orderBy("block")  # one row for 65536 inodes
    between = ends.select((F.coalesce(F.lag("high").over(order), F.lit(0)) + 1).alias("a"), (F.col("low") - 1).alias("b")).where("a <= b").select(F.explode(F.sequence("a", "b")).alias("inode"))
    holes = gaps.union(between).select("inode", F.lit(None).cast("long").alias("ref"))
    return inodes.select("inode", "ref").union(holes)


def directory_runs(dirents: DataFrame) -> DataFrame:
    """parent_inode, run, start (inode block), first (number), name (of the first), entries and bytes of each run.

    A run goes on while its entries' inodes lie in one block, their numbers within RUN_DELTA of the first,
    up to RUN_ENTRIES of them and META bytes. Directories are spread over tasks, each is one ordered scan.
    """
    rows = dirents.select("parent_inode", "name", "inode", "ref", F.octet_length("name").alias("length"))

    def step() -> Callable[[dict | None], list[dict]]:
        run: dict = {}
        number = -1

        def take(row: dict | None) -> list[dict]:
            nonlocal run, number
            out = []
            block = None if row is None else row["ref"] >> 16
            if run and (row is None or block != run["start"] or abs(row["inode"] - run["first"]) > RUN_DELTA or run["entries"] == RUN_ENTRIES or run["bytes"] + 8 + row["length"] > META):
                out.append(run)
                run = {}
            if row is not None:
                if not run:
                    number += 1
                    run = {"parent_inode": row["parent_inode"], "run": number, "start": block, "first": row["inode"], "name": row["name"], "entries": 0, "bytes": 12}
                run["entries"] += 1
                run["bytes"] += 8 + row["length"]
            return out

        return take

    return scan(rows, "parent_inode", ["name"], step, "parent_inode long, run long, start long, first long, name string, entries long, bytes long")


def fragment_flags(fragments: DataFrame) -> DataFrame:
    """One row: whether there are fragments, and whether all are stored as they are."""
    return fragments.agg((F.count("*") > 0).alias("fragments"), F.coalesce(F.bool_and(~F.col("compressed")), F.lit(False)).alias("uncompressed"))


def in_hole(extents: Column, offset: Column) -> Column:
    """Whether offset lies between the extents (offset, count) of a sparse file's data."""
    return ~F.exists(extents, lambda e: (e["offset"] <= offset) & (offset < e["offset"] + e["count"]))


def to_next_data(extents: Column, offset: Column, size: Column) -> Column:
    """Bytes from offset to the next extent, or to the end of the file; 0 inside of one."""
    after = F.filter(extents, lambda e: (e["offset"] > offset) & (e["count"] > 0))
    start = F.coalesce(F.array_min(F.transform(after, lambda e: e["offset"])), size)
    return F.when(in_hole(extents, offset), F.greatest(start - offset, F.lit(0))).otherwise(0)
