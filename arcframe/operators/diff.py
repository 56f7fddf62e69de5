"""Differences between two trees, two contents, two super blocks."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import modes, paths


def _sided(entries: DataFrame, side: str) -> DataFrame:
    return entries.select(F.col("path"), F.struct(*[F.col(c) for c in entries.columns if c != "path"]).alias(side))


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, old and new (structs, null where a side lacks the path), without what lies below a path whose type differs."""
    both = _sided(old, "old").join(_sided(new, "new"), "path", "full_outer")
    changed = both.where(modes.type_of(F.col("old.mode")) != modes.type_of(F.col("new.mode"))).select(F.col("path").alias("changed"))
    steps = both.select(F.col("path").alias("p"), F.explode(paths.ancestors(F.col("path"))).alias("step"))
    hidden = steps.join(changed, F.col("step") == F.col("changed"), "left_semi").select(F.col("p").alias("path")).distinct()
    return both.join(hidden, "path", "left_anti")


def only(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and side: ``<`` for what only old has, ``>`` for what only new has, below a changed type nothing."""
    return paired(old, new).where(F.col("old").isNull() | F.col("new").isNull()).select("path", F.when(F.col("new").isNull(), "<").otherwise(">").alias("side"))


#: What can be left out of a comparison, and what has to be asked for.
DEFAULT = ("type", "permissions", "owner", "device", "target", "content")
ASKED = ("timestamp", "inode")


def attributes(old: DataFrame, new: DataFrame, compare: Collection[str] = DEFAULT) -> DataFrame:
    """path and difference, a row for each thing that differs between entries of the same path.

    Another type is the only difference reported of a path, and nothing is below it. An inode that is merely
    extended on one side is said to be so and compared on. A link's target is a difference like any other.
    """
    both = paired(old, new).where(F.col("old").isNotNull() & F.col("new").isNotNull())
    o, n = (lambda c: F.col(f"old.{c}")), (lambda c: F.col(f"new.{c}"))
    have = set(old.columns) & set(new.columns)
    same_type = modes.type_of(o("mode")) == modes.type_of(n("mode"))
    is_type = lambda *t: modes.is_type(o("mode"), *t)
    differs: dict[str, Column] = {"type": ~same_type}
    if "extended" in have:
        differs["extended"] = same_type & ~o("extended").eqNullSafe(n("extended"))
    if "permissions" in compare:
        differs["permissions"] = same_type & (o("mode").bitwiseAND(modes.PERMISSIONS) != n("mode").bitwiseAND(modes.PERMISSIONS))
    if "owner" in compare:
        differs["owner"] = same_type & ((o("uid") != n("uid")) | (o("gid") != n("gid")))
    if "timestamp" in compare:
        differs["timestamp"] = same_type & (o("mtime") != n("mtime"))
    if "inode" in compare:
        differs["inode"] = same_type & (o("inode") != n("inode"))
    if "device" in compare and "rdev" in have:
        differs["device"] = same_type & is_type(modes.BLOCK, modes.CHARACTER) & ~o("rdev").eqNullSafe(n("rdev"))
    if "target" in compare and "target" in have:
        differs["target"] = same_type & is_type(modes.LINK) & ~o("target").eqNullSafe(n("target"))
    if "content" in compare and "size" in have:
        # sizes settle most; digests or bytes are looked at only where they agree
        other = ~o("size").eqNullSafe(n("size"))
        for c in ("digest", "content"):
            if c in have:
                other = other | ~o(c).eqNullSafe(n(c))
                break
        differs["content"] = same_type & is_type(modes.FILE) & other
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in differs.items()]))
    return both.select("path", F.explode(found).alias("difference"))


def contents(old: DataFrame, new: DataFrame, block_size: int = 1 << 17) -> DataFrame:
    """path, old_size, new_size and first_difference (offset of the first block that differs) of files whose bytes differ.

    Files of different size differ without their bytes being read; others are compared block by block by
    digest, and only digests are shuffled.
    """
    from . import blocks as B

    sizes = lambda f, s: f.select("path", F.octet_length("content").cast("long").alias(s))
    both = sizes(old, "old_size").join(sizes(new, "new_size"), "path")
    uneven = both.where("old_size != new_size").select("path", "old_size", "new_size", F.lit(None).cast("long").alias("first_difference"))
    digests = lambda f, d: B.with_digest(B.split(f.select("path", F.lit(0).cast("long").alias("seq"), "content"), block_size, tails=False)).select("path", "idx", F.col("digest").alias(d))
    differing = digests(old, "a").join(digests(new, "b"), ["path", "idx"]).where("a != b").groupBy("path").agg((F.min("idx") * block_size).alias("first_difference"))
    even = both.where("old_size = new_size").join(differing, "path").select("path", "old_size", "new_size", "first_difference")
    return uneven.unionByName(even)


#: The flags of a super block, as a difference names them.
FLAGS = {
    0x0001: "uncompressed inodes",
    0x0002: "uncompressed data",
    0x0008: "uncompressed fragments",
    0x0010: "no fragments",
    0x0020: "always fragments",
    0x0040: "no duplicates",
    0x0080: "exportable",
    0x0100: "uncompressed xattrs",
    0x0200: "no xattrs",
    0x0400: "compressor options",
    0x0800: "uncompressed ids",
}


def super_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """field, old, new and delta of the fields of two one-row tables that differ, flags one by one."""
    fields = [c for c in old.columns if c in new.columns and c not in ("image", "flags")]

    def long(table: DataFrame, side: str) -> DataFrame:
        values = [F.struct(F.lit(c).alias("field"), F.col(c).cast("long").alias(side)) for c in fields]
        if "flags" in table.columns:
            values += [F.struct(F.lit(f"flag: {name}").alias("field"), (F.col("flags").bitwiseAND(bit) != 0).cast("long").alias(side)) for bit, name in FLAGS.items()]
        return table.select(F.explode(F.array(*values)).alias("v")).select("v.*")

    both = long(old, "old").join(long(new, "new"), "field")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("field", "old", "new", (F.col("new") - F.col("old")).alias("delta"))


def extract(old: DataFrame, new: DataFrame) -> DataFrame:
    """side, path and content of the files that differ or are on one side only, as they are to be written out."""
    regular = modes.is_type(F.col("mode"), modes.FILE)
    changed = contents(old.where(regular), new.where(regular)).select("path")
    wanted = only(old, new).select("path").unionByName(changed).distinct()
    part = lambda f, s: f.where(regular).join(wanted, "path", "left_semi").select(F.lit(s).alias("side"), "path", "content")
    return part(old, "old").unionByName(part(new, "new"))
