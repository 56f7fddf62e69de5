"""Directories of the local file system as entries, and entries written back to disk."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import modes
from ..functions.codecs import few_rows
from ..schemas import ENTRIES
from .files import local

SCHEMA = StructType(list(ENTRIES.fields)).add("mount_point", "boolean")


#: Partitions of a scan: a directory is looked into on the driver as long as there are fewer. Entries of a
#: partition at least, where all of them are known by then.
PARTS, LEAST = 128, 32


@dataclass
class Subtree(InputPartition):
    """Names below top, each with whether what lies below it belongs to it, too."""

    top: str
    names: list[tuple[str, bool]]
    part: int

    def __init__(self, top: str, names: list[tuple[str, bool]], part: int) -> None:
        super().__init__(top)
        self.top, self.names, self.part = top, names, part


class DirectoryReader(DataSourceReader):
    """Up to PARTS partitions: subtrees, or runs of them, are walked by different tasks.

    The first levels are listed on the driver, no more of them than it takes to find so many entries. Partitions
    are in the order of one walk of the tree.
    """

    def __init__(self, schema: StructType, options: dict) -> None:
        self.options = {k: str(v).lower() == "true" for k, v in options.items() if k != "path"}
        self.top = local(options["path"])

    def partitions(self) -> list[Subtree]:
        items = [(name, True) for name in self._listed("")]
        open_ = True
        while open_ and len(items) < PARTS:
            open_, deeper = False, []
            for path, below in items:
                inside = self._listed(path) if below and self._enters(path) else []
                deeper += [(path, not inside), *((f"{path}/{name}", True) for name in inside)] if inside else [(path, below)]
                open_ |= bool(inside)
            items = deeper
        # what wasn't looked into may be of any size
        size = max(-(-len(items) // PARTS), 1 if open_ else LEAST)
        return [Subtree(self.top, items[at : at + size], at // size) for at in range(0, len(items), size)] or [Subtree(self.top, [], 0)]

    def _listed(self, path: str) -> list[str]:
        return [os.fsdecode(n) for n in sorted(os.listdir(os.path.join(os.fsencode(self.top), os.fsencode(path))))]

    def _enters(self, path: str) -> bool:
        full = os.path.join(self.top, path)
        try:
            s = os.lstat(full)
            return stat.S_ISDIR(s.st_mode) and not (self.options.get("one_filesystem") and s.st_dev != os.lstat(os.path.dirname(full)).st_dev)
        except FileNotFoundError:
            return False

    def read(self, partition: Subtree) -> Iterator[tuple]:
        n = 0
        stack: list[tuple[str, int | None, bool]] = [(name, None, below) for name, below in reversed(partition.names)]
        while stack:
            path, above, below = stack.pop()
            full = os.path.join(partition.top, path)
            above = os.lstat(os.path.dirname(full)).st_dev if above is None else above
            try:
                s = os.lstat(full)
            except FileNotFoundError:  # gone meanwhile
                continue
            foreign = stat.S_ISDIR(s.st_mode) and s.st_dev != above
            if foreign and self.options.get("one_filesystem"):
                continue
            content = None
            if stat.S_ISREG(s.st_mode) and self.options.get("content", True):
                with open(full, "rb") as f:
                    content = f.read()
            target = os.readlink(full) if stat.S_ISLNK(s.st_mode) else None
            xattrs = host_xattrs(full) if self.options.get("xattrs") else None
            size = len(os.fsencode(target)) if target is not None else s.st_size if stat.S_ISREG(s.st_mode) else 0
            major, minor = os.major(s.st_rdev), os.minor(s.st_rdev)
            rdev = (major & 0xFFF) << 8 | minor & 0xFF | (minor & 0xFFF00) << 12
            yield path, s.st_mode, s.st_uid, s.st_gid, int(s.st_mtime), size, rdev, target, False, s.st_dev, s.st_ino, partition.part << 40 | n, content, xattrs, None, foreign
            n += 1
            if below and stat.S_ISDIR(s.st_mode):
                stack += [(f"{path}/{name}", s.st_dev, True) for name in reversed(self._listed(path))]


def host_xattrs(path: str) -> dict[str, bytes]:
    """The attributes of a path, those with empty values left out."""
    out = {}
    for key in os.listxattr(path, follow_symlinks=False):
        if value := os.getxattr(path, key, follow_symlinks=False):
            out[key] = value
    return out


class DirectoryDataSource(DataSource):
    """``spark.read.format("arcdir").load(path)``: what lies below a directory; options content, xattrs, one_filesystem."""

    @classmethod
    def name(cls) -> str:
        return "arcdir"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DirectoryReader:
        return DirectoryReader(schema, dict(self.options))


def scan_directory(spark: SparkSession, path: str, content: bool = True, xattrs: bool = False, one_filesystem: bool = False) -> DataFrame:
    spark.dataSource.register(DirectoryDataSource)
    reader = spark.read.format("arcdir")
    for name, value in (("content", content), ("xattrs", xattrs), ("one_filesystem", one_filesystem)):
        reader = reader.option(name, str(value).lower())
    return reader.load(path)


def filetime_to_seconds(ticks: Column) -> Column:
    """Seconds since 1970 of a time in tenths of microseconds since 1601."""
    return F.floor((ticks - F.lit(116444736000000000)) / F.lit(10_000_000)).cast("long")


# --- writing back ---------------------------------------------------------------------------------------------


class UnsafeName(ValueError):
    """A name that would leave the directory that is unpacked to."""


def safe_join(top: str, path: str) -> str:
    """The place of a path below top; refused if a component isn't a plain name or if a link lies on the way."""
    at = top
    for part in path.split("/") if path else []:
        if part in ("", ".", "..") or "/" in part or "\0" in part:
            raise UnsafeName(path)
        if os.path.islink(at) and at != top:
            raise UnsafeName(path)
        at = os.path.join(at, part)
    return at


def unpack(entries: DataFrame, target: str, times: bool = False, permissions: bool = False, owners: bool = False, xattrs: bool = False, devices: bool = False, sparse: bool = True) -> DataFrame:
    """Creates entries below target, a folder that all workers share: path and what was done, computed as it is read.

    Directories first, then the rest on all tasks, then hard links, then attributes with the deepest first, so
    that a directory's time is set last. Sockets, and devices unless asked for, are left out.
    """
    from ..operators.order import checkpointed

    target = local(target)
    hard = F.coalesce(F.col("hard_link"), F.lit(False)) if "hard_link" in entries.columns else F.lit(False)
    directory = modes.is_type(F.col("mode"), modes.DIRECTORY)
    # entries may be read from an image or an archive: twice, once for what they are and once for what they hold
    columns = [c for c in ("path", "mode", "uid", "gid", "mtime", "rdev", "target", "content", "xattrs") if c in entries.columns]

    rows = entries.select(*columns, hard.alias("hard"))
    known = checkpointed(rows.drop("content"))
    bad = known.where(F.exists(F.split("path", "/"), lambda x: x.isin(".", "..")) | F.col("path").rlike("^/|//|/$"))
    twice = known.groupBy("path").count().where("count > 1").select("path")
    wrong = bad.select("path").union(twice).limit(1).collect()
    if wrong:
        raise UnsafeName(wrong[0].path)
    os.makedirs(target, exist_ok=True)

    def each(work):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in few_rows(batches):
                rows = batch.to_pylist()
                yield pa.RecordBatch.from_pydict({"path": [r["path"] for r in rows], "done": [work(r) for r in rows]}, schema=pa.schema([("path", pa.string()), ("done", pa.string())]))

        return run

    def make(r: dict) -> str:
        at = safe_join(target, r["path"])
        kind = r["mode"] & modes.TYPE_MASK
        os.makedirs(at if kind == modes.DIRECTORY else os.path.dirname(at), exist_ok=True)
        if kind == modes.DIRECTORY:
            return "directory"
        if os.path.lexists(at):
            os.remove(at)
        if kind == modes.FILE:
            data = bytes(r.get("content") or b"")
            with open(at, "wb") as f:
                for start in range(0, len(data), 4096):
                    part = data[start : start + 4096]
                    f.seek(len(part), 1) if sparse and not part.strip(b"\0") else f.write(part)
                f.truncate(len(data))
            return "file"
        if kind == modes.LINK:
            os.symlink(r["target"], at)
            return "link"
        if kind == modes.FIFO:
            os.mkfifo(at)
            return "pipe"
        if kind in (modes.CHARACTER, modes.BLOCK) and devices:
            rdev = r.get("rdev") or 0
            os.mknod(at, r["mode"], os.makedev(rdev >> 8 & 0xFFF, rdev & 0xFF | rdev >> 12 & 0xFFF00))
            return "device"
        return "left out"

    def link(r: dict) -> str:
        at = safe_join(target, r["path"])
        if os.path.lexists(at):
            os.remove(at)
        os.link(safe_join(target, r["target"]), at, follow_symlinks=False)
        return "hard link"

    def dress(r: dict) -> str:
        at = safe_join(target, r["path"])
        if not os.path.lexists(at):
            return "left out"
        follow = not os.path.islink(at)
        if xattrs:
            for key, value in (r.get("xattrs") or {}).items() if not isinstance(r.get("xattrs"), list) else r["xattrs"]:
                os.setxattr(at, key, value, follow_symlinks=follow)
        if owners:
            os.chown(at, r["uid"], r["gid"], follow_symlinks=False)
        if permissions and follow:
            os.chmod(at, r["mode"] & modes.PERMISSIONS)
        if times:
            os.utime(at, (r["mtime"], r["mtime"]), follow_symlinks=False)
        return "dressed"

    out = "path string, done string"
    made = checkpointed(known.where(directory & ~F.col("hard")).drop("hard").mapInArrow(each(make), out))
    rest = checkpointed(rows.where(~directory & ~F.col("hard")).drop("hard").mapInArrow(each(make), out))
    linked = checkpointed(known.where("hard").drop("hard").mapInArrow(each(link), out))
    if times or permissions or owners or xattrs:
        dressing = [c for c in columns if c != "content"]
        plain = known.where(~F.col("hard")).select(*dressing)
        checkpointed(plain.where(~directory).mapInArrow(each(dress), out))
        # directories level by level, the deepest first; those of a level on all tasks
        depth = F.size(F.split("path", "/"))
        levels = sorted((r.depth for r in plain.where(directory).select(depth.alias("depth")).distinct().collect()), reverse=True)
        for level in levels:
            checkpointed(plain.where(directory & (depth == level)).mapInArrow(each(dress), out))
    return made.union(rest).union(linked)
