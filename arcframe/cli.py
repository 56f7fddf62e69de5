"""Command line: pack, inspect, to-tar, from-tar, diff and browse.

Exit status is 0 where all went well, 1 for an error or, from diff, for differences, 2 for an error of diff.
"""

from __future__ import annotations

import argparse
import os
import shlex
import sys
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import session
from .engine import Engine
from .functions import codecs, modes, numbers
from .operators import diff, rules, tree
from .operators import entries as E
from .sources import directory


def size(text: str) -> int:
    """Bytes with an optional k, M or G."""
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(text[-1:].lower(), 1)
    digits = text[:-1] if unit > 1 else text
    if not digits.isdigit() or int(digits) * unit > numbers.MAX_LONG:
        raise argparse.ArgumentTypeError(f"{text!r} isn't a size")
    return int(digits) * unit


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("arcframe", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text, description=text)
        p.add_argument("-j", "--num-jobs", type=int, default=0, help="tasks at a time; all processors by default")
        p.add_argument("-q", "--quiet", action="store_true", help="print errors only")
        return p

    def packing(p: argparse.ArgumentParser) -> None:
        p.add_argument("-c", "--compressor", choices=codecs.available(), default=codecs.default_codec())
        p.add_argument("-X", "--comp-extra", default="", help="options of the compressor, such as level=6,rle")
        p.add_argument("-b", "--block-size", type=size, default=1 << 17)
        p.add_argument("-B", "--dev-block-size", type=size, default=4096)
        p.add_argument("-Q", "--queue-backlog", type=int, default=0, help="rows of an Arrow batch, which hold back how much is in memory")
        p.add_argument("-d", "--defaults", default="", help="uid=,gid=,mode=,mtime= of directories that aren't named")
        p.add_argument("-e", "--exportable", action="store_true")
        p.add_argument("-T", "--no-tail-packing", action="store_true")
        p.add_argument("-f", "--force", action="store_true", help="overwrite what is there")

    p = command("pack", "Make an image from a listing or a directory.")
    packing(p)
    p.add_argument("-F", "--pack-file")
    p.add_argument("-D", "--pack-dir")
    p.add_argument("-u", "--set-uid", type=int)
    p.add_argument("-g", "--set-gid", type=int)
    p.add_argument("--all-root", action="store_true")
    p.add_argument("-S", "--sort-file")
    p.add_argument("-s", "--selinux")
    p.add_argument("-A", "--xattr-file")
    p.add_argument("-k", "--keep-time", action="store_true")
    p.add_argument("-x", "--keep-xattr", action="store_true")
    p.add_argument("-o", "--one-file-system", action="store_true")
    p.add_argument("-H", "--no-hard-links", action="store_true")
    p.add_argument("image")

    p = command("inspect", "Show or unpack what an image holds.")
    action = p.add_mutually_exclusive_group(required=True)
    for flag, name in (("-l", "list"), ("-c", "cat"), ("-x", "xattr"), ("-s", "stat"), ("-u", "unpack-path")):
        action.add_argument(flag, f"--{name}", metavar="PATH")
    action.add_argument("-d", "--describe", action="store_true")
    p.add_argument("-p", "--unpack-root")
    for flag, name in (("-D", "no-dev"), ("-S", "no-sock"), ("-F", "no-fifo"), ("-L", "no-slink"), ("-E", "no-empty-dir"), ("-Z", "no-sparse"), ("-X", "set-xattr"), ("-T", "set-times"), ("-C", "chmod"), ("-O", "chown")):
        p.add_argument(flag, f"--{name}", action="store_true")
    p.add_argument("image")

    p = command("to-tar", "Turn an image into an archive.")
    p.add_argument("-c", "--compressor", choices=[*codecs.MAGIC])
    p.add_argument("-d", "--subdir", action="append", default=[])
    p.add_argument("-k", "--keep-as-dir", action="store_true")
    p.add_argument("-r", "--root-becomes")
    p.add_argument("-s", "--no-skip", action="store_true", help="fail on entries that an archive can't hold")
    p.add_argument("-X", "--no-xattr", action="store_true")
    p.add_argument("-L", "--no-hard-links", action="store_true")
    p.add_argument("image")
    p.add_argument("archive")

    p = command("from-tar", "Turn an archive into an image.")
    packing(p)
    p.add_argument("-r", "--root-becomes")
    p.add_argument("-s", "--no-skip", action="store_true", help="fail on attributes that an image can't hold")
    p.add_argument("-x", "--no-xattr", action="store_true")
    p.add_argument("-k", "--no-keep-time", action="store_true")
    p.add_argument("-S", "--no-symlink-retarget", action="store_true")
    p.add_argument("-E", "--exclude-dir", action="append", default=[])
    p.add_argument("archive")
    p.add_argument("image")

    p = command("diff", "Compare two images.")
    p.add_argument("-a", "--old", required=True)
    p.add_argument("-b", "--new", required=True)
    for flag, name in (("-O", "no-owner"), ("-P", "no-permissions"), ("-C", "no-contents"), ("-T", "timestamps"), ("-I", "inode-num"), ("-S", "super")):
        p.add_argument(flag, f"--{name}", action="store_true")
    p.add_argument("-e", "--extract", metavar="DIRECTORY")
    p = command("browse", "look around in an image: ls, cd, pwd, stat, cat, tree")
    p.add_argument("image")
    return top


def _written(a: argparse.Namespace) -> dict:
    if os.path.exists(a.image) and not a.force:
        raise FileExistsError(f"{a.image} exists")
    return {
        "compressor": a.compressor, "options": a.comp_extra, "block_size": a.block_size, "device_block_size": a.dev_block_size, "exportable": a.exportable, "tails": not a.no_tail_packing, "overwrite": a.force,
        "mtime": rules.parse_defaults(a.defaults)["mtime"] or rules.source_date(dict(os.environ)),
    }


def _storable(rows: DataFrame, refuse: bool) -> DataFrame:
    """rows whose attributes an image can hold; others are left out, or fail."""
    from .functions.text import prefix_id

    known = lambda k, _: prefix_id(k).isNotNull()
    if refuse:
        wrong = F.raise_error(F.concat(F.lit("an image can't hold an attribute of "), "path")).cast("map<string,binary>")
        return rows.withColumn("xattrs", F.when(F.size(F.map_filter("xattrs", known)) < F.size("xattrs"), wrong).otherwise(F.col("xattrs")))
    return rows.withColumn("xattrs", F.map_filter("xattrs", known))


def pack(engine: Engine, a: argparse.Namespace) -> int:
    if not a.pack_file and not a.pack_dir:
        raise SystemExit("a listing or a directory is needed")
    made = _written(a)
    if a.pack_file:
        rows = engine.listing(a.pack_file, a.pack_dir or os.path.dirname(a.pack_file) or ".", made["mtime"])
    else:
        rows = engine.directory(a.pack_dir, hard_links=not a.no_hard_links, xattrs=a.keep_xattr, one_filesystem=a.one_file_system)
        rows = _storable(rows, False) if a.keep_xattr else rows
        rows = rows if a.keep_time else rows.withColumn("mtime", F.lit(made["mtime"]).cast("long"))
    for name, value in (("uid", 0 if a.all_root else a.set_uid), ("gid", 0 if a.all_root else a.set_gid)):
        rows = rows if value is None else rows.withColumn(name, F.lit(value).cast("long"))
    rows = tree.with_implied(rows, **rules.parse_defaults(a.defaults))
    engine.pack(rows, a.image, a.sort_file, a.xattr_file, a.selinux, **made)
    if not a.quiet:
        found = tree.statistics(engine.image(a.image, content=False)).first().asDict()
        print(", ".join(f"{n} {name}" for name, n in found.items()))
    return 0


def inspect(engine: Engine, a: argparse.Namespace) -> int:
    plain = lambda p: "/".join(x for x in p.split("/") if x not in ("", "."))
    rows = engine.image(a.image)
    types = [t for on, types in ((a.no_dev, (modes.BLOCK, modes.CHARACTER)), (a.no_sock, (modes.SOCKET,)), (a.no_fifo, (modes.FIFO,)), (a.no_slink, (modes.LINK,))) if on for t in types]
    path = next((plain(p) for p in (a.list, a.cat, a.xattr, a.stat, a.unpack_path) if p is not None), "")
    if not a.describe and rows.where(F.col("path") == path).select("path").isEmpty():
        print(f"no such entry: {path}", file=sys.stderr)
        return 1
    if a.list is not None:
        for r in engine.ls(rows.drop("content"), path).orderBy("name").toLocalIterator():
            print(r.line)
    elif a.cat is not None:
        sys.stdout.buffer.write(engine.cat(rows, path))
        sys.stdout.buffer.flush()
    elif a.xattr is not None:
        for r in engine.xattrs(rows, path).orderBy("key").collect():
            print(r.line)
    elif a.stat is not None:
        inode = rows.where(F.col("path") == path).select("inode").first().inode
        for name, value in engine.stat(rows.drop("content"), path).first().asDict().items():
            print(f"{name}: {value}")
        for name, value in engine.image(a.image, "inodes").where(F.col("inode") == inode).first().asDict().items():
            print(f"inode.{name}: {value}")
    elif a.describe:
        kept = E.without_types(rows.drop("content"), *types)
        kept = E.prune_empty(kept) if a.no_empty_dir else kept
        for r in engine.describe(kept, a.unpack_root).orderBy(E.path_key()).toLocalIterator():
            print(r.line)
    else:
        done = engine.unpack(rows, a.unpack_root or ".", path, types, a.no_empty_dir, times=a.set_times, permissions=a.chmod, owners=a.chown, xattrs=a.set_xattr, devices=not a.no_dev, sparse=not a.no_sparse)
        for r in done.orderBy("path").toLocalIterator():
            if not a.quiet:
                print(f"{r.done}: {r.path}")
    return 0


def to_tar(engine: Engine, a: argparse.Namespace) -> int:
    rows = engine.image(a.image)
    rows = rows.drop("xattrs") if a.no_xattr else rows
    subdirs = ["/".join(x for x in s.split("/") if x not in ("", ".")) for s in a.subdir]
    left = engine.to_tar(rows, a.archive, subdirs, a.keep_as_dir, a.root_becomes, not a.no_hard_links, compressor=a.compressor, skip_unsupported=not a.no_skip)
    if not a.quiet:
        for r in left.orderBy("path").toLocalIterator():
            print(f"left out: {r.path}", file=sys.stderr)
    return 0


def from_tar(engine: Engine, a: argparse.Namespace) -> int:
    rows = engine.tar(a.archive, a.exclude_dir)
    rows = rows.drop("xattrs") if a.no_xattr else _storable(rows, a.no_skip)
    engine.pack_archive(rows, a.image, a.root_becomes, not a.no_symlink_retarget, not a.no_keep_time, rules.parse_defaults(a.defaults), **_written(a))
    return 0


def compare(engine: Engine, a: argparse.Namespace) -> int:
    drop = {n for on, n in ((a.no_owner, "owner"), (a.no_permissions, "permissions")) if on}
    what = [c for c in diff.DEFAULT if c not in drop] + ["timestamp"] * a.timestamps + ["inode"] * a.inode_num
    old, new = (engine.image(p) for p in (a.old, a.new))
    if a.no_contents:
        old, new = old.drop("content"), new.drop("content")
    rows = engine.diff(old, new, what).orderBy("path", "difference").collect()
    for r in rows:
        print(f"{r.difference} {r.path}" if r.difference in "<>" else f"{r.path}: {r.difference}")
    if a.super and not rows:
        rows = engine.diff_super(a.old, a.new).orderBy("field").collect()
        for r in rows:
            print(f"{r.field}: {r.old} {r.new}")
    if a.extract:
        files = diff.extract(old, new).select(F.concat_ws("/", "side", "path").alias("path"), F.lit(modes.FILE | 0o644).alias("mode"), "content")
        directory.unpack(files, a.extract).count()
    return 1 if rows else 0


def browse(engine: Engine, a: argparse.Namespace) -> int:
    """A shell over an image: reads commands line by line until the input or the user ends it."""
    place = engine.browse(a.image)

    def run(name: str, path: str) -> None:
        if name == "ls":
            for r in place.ls(path).orderBy("name").toLocalIterator():
                print(r.line)
        elif name == "cd":
            place.cd(path or "/")
        elif name == "pwd":
            print(place.pwd())
        elif name == "stat":
            for key, value in (place.stat(path).first() or Row()).asDict().items():
                print(f"{key}: {value}")
        elif name == "cat":
            sys.stdout.flush()
            sys.stdout.buffer.write(place.cat(path))
            sys.stdout.buffer.flush()
        elif name == "tree":
            below = tree.subtree(place.entries.drop("content"), place._resolve(path))
            for r in E.tree_lines(below).orderBy(E.path_key()).toLocalIterator():
                print(r.line)
        else:
            print("ls, cd, pwd, stat, cat, tree [path]; exit")

    while True:
        print(f"{place.pwd()}> ", end="", flush=True) if sys.stdin.isatty() else None
        line = sys.stdin.readline()
        try:
            words = shlex.split(line)
        except ValueError as e:
            print(e, file=sys.stderr)
            continue
        if not line or words[:1] == ["exit"]:
            return 0
        if words:
            try:
                run(words[0], words[1] if len(words) > 1 else "")
            except (OSError, ValueError) as e:
                print(f"{type(e).__name__}: {e}", file=sys.stderr)


COMMANDS = {"browse": browse, "pack": pack, "inspect": inspect, "to-tar": to_tar, "from-tar": from_tar, "diff": compare}


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session.build(a.num_jobs or "*")
    if getattr(a, "queue_backlog", 0):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", max(3, a.queue_backlog))
    try:
        return COMMANDS[a.command](Engine(spark), a)
    except (ValueError, OSError, PySparkException) as e:
        lines = [x for x in str(e).splitlines() if x.strip()]
        print("arcframe: " + next((x for x in reversed(lines) if "Error:" in x), lines[0] if lines else repr(e)), file=sys.stderr)
        return 2 if a.command == "diff" else 1
