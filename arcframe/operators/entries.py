"""Projections and filters of entries: one row for each name of a tree."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import modes, numbers, paths


# --- projections --------------------------------------------------------------------------------------------


def with_parts(entries: DataFrame) -> DataFrame:
    """Adds parent_path, name and depth."""
    return entries.withColumns({"parent_path": paths.parent(F.col("path")), "name": paths.name(F.col("path")), "depth": paths.depth(F.col("path"))})


def join_path(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat(parent, F.lit("/"), name))


def with_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    """All paths below prefix."""
    return entries.withColumn("path", F.when(F.col("path") == "", F.lit(prefix)).otherwise(F.concat(F.lit(prefix + "/"), F.col("path")))) if prefix else entries


def override(entries: DataFrame, keep: Iterable[str] = (), mtime: int = 0, uid: int = 0, gid: int = 0, mode: int = 0o755) -> DataFrame:
    """mtime, uid, gid and mode replaced by defaults, except those in keep. A mode keeps its type bits."""
    kept = set(keep)
    new = {"mtime": F.lit(mtime).cast("long"), "uid": F.lit(uid).cast("long"), "gid": F.lit(gid).cast("long"), "mode": modes.type_of(F.col("mode")).bitwiseOR(F.lit(mode & modes.PERMISSIONS))}
    return entries.withColumns({c: v for c, v in new.items() if c not in kept})


def clamp_times(entries: DataFrame) -> DataFrame:
    return entries.withColumn("mtime", numbers.clamp_time(F.col("mtime")))


def reroot_out(entries: DataFrame, subdirs: Sequence[str] = (), root: str | None = None, keep_as_dir: bool = False) -> DataFrame:
    """Entries as an archive names them: the selected subdirectories, under a new root if one is given.

    A single selected directory loses its own path unless keep_as_dir; then its contents are the archive's top.
    With a root, everything moves below it and the root gets a row of its own. Directories end in a slash.
    """
    rows = select_subtrees(entries, subdirs) if subdirs else entries
    if len(subdirs) == 1 and not keep_as_dir:
        top = subdirs[0]
        rows = rows.where(F.col("path").startswith(top + "/")).withColumn("path", F.substring(F.col("path"), F.lit(len(top) + 2), F.length(F.col("path"))))
        base = entries.where(F.col("path") == top)
    else:
        base = entries.where(F.col("path") == "")
        rows = rows.where(F.col("path") != "")
    if root is not None:
        rows = rows.withColumn("path", F.concat(F.lit(root + "/"), F.col("path"))).unionByName(base.withColumn("path", F.lit(root)))
    slash = modes.is_type(F.col("mode"), modes.DIRECTORY)
    return rows.withColumn("path", F.when(slash, F.concat(F.col("path"), F.lit("/"))).otherwise(F.col("path")))


def reroot_in(entries: DataFrame, root: str, retarget_symlinks: bool = True) -> DataFrame:
    """Entries below root, with root stripped from paths, from hard links' targets and from absolute symlinks' ones.

    The row of root itself becomes that of the tree's root.
    """
    inside = entries.where((F.col("path") == root) | F.col("path").startswith(root + "/"))
    target = F.col("target")
    below = F.when(target == root, F.lit("")).when(target.startswith(root + "/"), F.substring(target, F.lit(len(root) + 2), F.length(target)))
    absolute = F.when(target.startswith("/" + root + "/"), F.substring(target, F.lit(len(root) + 2), F.length(target)))
    hard = F.coalesce(F.col("hard_link"), F.lit(False))
    new = F.when(hard, F.coalesce(below, target))
    new = new.when(F.lit(retarget_symlinks), F.coalesce(absolute, target)).otherwise(target)
    return inside.withColumns({"target": new, "path": F.when(F.col("path") == root, F.lit("")).otherwise(F.substring(F.col("path"), F.lit(len(root) + 2), F.length(F.col("path"))))})


def printed_size() -> Column:
    """Size in a listing: of a link its target's, of a device major:minor, 0 for pipes and sockets."""
    device = F.concat(modes.device_major(F.col("rdev")).cast("string"), F.lit(":"), modes.device_minor(F.col("rdev")).cast("string"))
    return (
        F.when(modes.is_type(F.col("mode"), modes.LINK), numbers.print_size(F.octet_length("target").cast("long")))
        .when(modes.is_type(F.col("mode"), modes.FILE, modes.DIRECTORY), numbers.print_size(F.col("size")))
        .when(modes.is_type(F.col("mode"), modes.BLOCK, modes.CHARACTER), device)
        .otherwise(F.lit("0"))
    )


def list_directory(entries: DataFrame, directory: str = "") -> DataFrame:
    """A listing of one directory in the order of names: name and line, owners and sizes in columns."""
    rows = with_parts(entries).where((F.col("parent_path") == directory) & (F.col("path") != ""))
    rows = rows.withColumn("printed", printed_size())
    # the widths of a directory are three numbers: one pass of partial maxima, joined back as one row
    widths = rows.agg(
        F.max(numbers.printed_width(F.col("uid"))).alias("uid_width"), F.max(numbers.printed_width(F.col("gid"))).alias("gid_width"), F.max(F.length("printed")).alias("size_width")
    )
    padded = lambda text, width, left: F.when(F.length(text) >= width, text).otherwise((F.rpad if left else F.lpad)(text, width, F.lit(" ")))
    line = F.concat_ws(
        " ",
        modes.mode_string(F.col("mode")),
        F.concat(padded(F.col("uid").cast("string"), F.col("uid_width"), False), F.lit("/"), padded(F.col("gid").cast("string"), F.col("gid_width"), True)),
        padded(F.col("printed"), F.col("size_width"), False),
        F.concat(F.col("name"), F.when(modes.is_type(F.col("mode"), modes.LINK), F.concat(F.lit(" -> "), F.col("target"))).otherwise("")),
    )
    return rows.crossJoin(F.broadcast(widths)).select("name", line.alias("line"))


def stat(entries: DataFrame, path: str) -> DataFrame:
    """One row with what is known of an entry."""
    return entries.where(F.col("path") == path).select(
        "path",
        modes.mode_string(F.col("mode")).alias("mode_text"),
        modes.octal(F.col("mode")).alias("permissions"),
        "uid",
        "gid",
        "size",
        F.date_format(F.timestamp_seconds("mtime"), "EEE, dd MMM yyyy HH:mm:ss").alias("modified"),
        *[F.col(c) for c in ("target", "nlink", "inode", "block_sizes", "dir_index") if c in entries.columns],
    )


def describe(entries: DataFrame, unpack_root: str | None = None) -> DataFrame:
    """The tree as lines of a listing file: path and line; the root is left out."""
    from ..functions.text import quote_name

    kind = F.lit(None).cast("string")
    for bits, word in ((modes.SOCKET, "sock"), (modes.LINK, "slink"), (modes.FIFO, "pipe"), (modes.FILE, "file"), (modes.CHARACTER, "nod"), (modes.BLOCK, "nod"), (modes.DIRECTORY, "dir")):
        kind = F.when(modes.is_type(F.col("mode"), bits), word).otherwise(kind)
    device = F.concat_ws(" ", F.when(modes.is_type(F.col("mode"), modes.CHARACTER), "c").otherwise("b"), modes.device_major(F.col("rdev")).cast("string"), modes.device_minor(F.col("rdev")).cast("string"))
    extra = F.when(modes.is_type(F.col("mode"), modes.LINK), F.col("target")).when(modes.is_type(F.col("mode"), modes.CHARACTER, modes.BLOCK), device)
    if unpack_root is not None:
        extra = F.when(modes.is_type(F.col("mode"), modes.FILE), F.concat(F.lit(unpack_root + "/"), F.col("path"))).otherwise(extra)
    line = F.concat_ws(" ", kind, quote_name(F.col("path")), modes.octal(F.col("mode")), F.col("uid").cast("string"), F.col("gid").cast("string"), extra)
    return entries.where((F.col("path") != "") & kind.isNotNull()).select("path", line.alias("line"))


# --- filters ------------------------------------------------------------------------------------------------


def without_types(entries: DataFrame, *types: int) -> DataFrame:
    """Drops entries of types; directories are left alone, they are dropped as mount points only."""
    return entries.where(~modes.is_type(F.col("mode"), *[t for t in types if t != modes.DIRECTORY])) if set(types) - {modes.DIRECTORY} else entries


def without_directories(entries: DataFrame) -> DataFrame:
    return entries.where(~modes.is_type(F.col("mode"), modes.DIRECTORY))


def of_types(entries: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """Entries of the selected types, letters b c d p f l s; none selected means all."""
    if unknown := [s for s in selectors if s not in modes.SELECTORS]:
        raise ValueError(f"unknown type {unknown[0]!r}")
    return entries.where(modes.is_type(F.col("mode"), *[modes.SELECTORS[s] for s in selectors])) if selectors else entries


def one_filesystem(entries: DataFrame) -> DataFrame:
    """Drops mount points, directories on another device than the one above, and all that lies below them."""
    rows = with_parts(entries)
    above = entries.select(F.col("path").alias("above"), F.col("dev").alias("above_dev"))
    mounts = rows.join(above, F.col("parent_path") == F.col("above")).where(F.col("dev") != F.col("above_dev")).select(F.col("path").alias("mount"))
    steps = rows.select("path", F.explode(F.array_append(paths.ancestors(F.col("path")), F.col("path"))).alias("step"))
    cut = steps.join(mounts, F.col("step") == F.col("mount"), "left_semi").select("path").distinct()
    return entries.join(cut, "path", "left_anti")


def first_level(entries: DataFrame) -> DataFrame:
    return entries.where(paths.depth(F.col("path")) == 1)


def up_to_depth(entries: DataFrame, depth: int) -> DataFrame:
    return entries.where(paths.depth(F.col("path")) <= depth)


def name_matches(entries: DataFrame, pattern: str) -> DataFrame:
    """Entries whose name the glob matches."""
    return entries.where(paths.glob(paths.name(F.col("path")), pattern))


def path_matches(entries: DataFrame, pattern: str) -> DataFrame:
    """Entries whose path the glob matches, its wildcards within components."""
    return entries.where(paths.glob(F.col("path"), pattern, pathname=True))


def exclude_globs(entries: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Drops entries whose whole path any of the globs matches; here wildcards cross slashes."""
    for pattern in patterns:
        entries = entries.where(~paths.glob(F.col("path"), pattern))
    return entries


def select_subtrees(entries: DataFrame, tops: Sequence[str]) -> DataFrame:
    """The selected directories, what is below them and the directories above them."""
    keep = F.lit(False)
    for top in tops:
        keep |= paths.is_below(F.col("path"), top) | paths.is_above(F.col("path"), top)
    return entries.where(keep)


def prune_empty(entries: DataFrame, start: str = "") -> DataFrame:
    """Drops directories without an entry of another kind anywhere below, except start itself."""
    directory = modes.is_type(F.col("mode"), modes.DIRECTORY)
    held = entries.where(~directory).select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    kept = entries.where(directory & (F.col("path") != start)).join(held, "path", "left_semi")
    return entries.where(~directory | (F.col("path") == start)).unionByName(kept.select(*entries.columns))


def with_parents_in(entries: DataFrame, tree: DataFrame) -> DataFrame:
    """Entries all of whose directories the tree has; the root is always there."""
    there = tree.where(modes.is_type(F.col("mode"), modes.DIRECTORY)).select(F.col("path").alias("directory")).distinct()
    steps = entries.select(F.col("path").alias("p"), F.explode(paths.ancestors(F.col("path"))).alias("step")).distinct()
    orphans = steps.join(there, F.col("step") == F.col("directory"), "left_anti").select(F.col("p").alias("path")).distinct()
    return entries.join(orphans, "path", "left_anti")


def sane_names(entries: DataFrame, windows: bool = False) -> DataFrame:
    """Entries all of whose components can be created below a directory without leaving it."""
    return entries.where(F.forall(paths.parts(F.col("path")), lambda x: paths.is_sane_name(x, windows)))


def duplicates(entries: DataFrame) -> DataFrame:
    """path and count of names that a directory has more than once."""
    return entries.groupBy("path").agg(F.count("*").alias("count")).where("count > 1")


# --- orders -------------------------------------------------------------------------------------------------


def path_key() -> Column:
    """Sort key of depth-first order: a directory before what is in it, siblings by name."""
    return paths.parts(F.col("path"))


def in_tree_order(entries: DataFrame) -> DataFrame:
    return entries.orderBy(path_key())


def tree_lines(entries: DataFrame) -> DataFrame:
    """path and an indented line for each entry; order by path_key to print them."""
    return entries.where(F.col("path") != "").select("path", F.concat(F.repeat(F.lit("  "), paths.depth(F.col("path")) - 1), paths.name(F.col("path"))).alias("line"))


def first_match(entries: DataFrame, path: str) -> DataFrame:
    return entries.where(F.col("path") == path).limit(1)


def unpack_order(files: DataFrame) -> DataFrame:
    """Files in the order in which their data lie: by fragment, then by first block."""
    return files.orderBy(F.col("fragment").asc_nulls_last(), F.col("block_start").asc_nulls_last(), "path")


def unpack_positions(files: DataFrame) -> DataFrame:
    """files with position, from 0, in the order of ``unpack_order``."""
    from .order import numbered

    last = [k for c in ("fragment", "block_start") for k in (F.col(c).isNull(), F.col(c))]
    return numbered(files, [*last, F.col("path")], "position", 0)


def by_name(entries: DataFrame) -> DataFrame:
    """Siblings by the bytes of their names."""
    return with_parts(entries).orderBy("parent_path", "name")


def position_in_directory(entries: DataFrame) -> DataFrame:
    """Adds position, from 0, of each entry among its siblings."""
    rows = with_parts(entries).where(F.col("path") != "")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("parent_path").orderBy("name")).cast("long") - 1)
