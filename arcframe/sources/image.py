"""Compressed read-only filesystem images: decoding all tables, a DataSource over them, and a sink.

``Image`` reads any table of an image by random access. The DataSource has a partition for each image, and
several for each where contents are read. The sink cuts and compresses files on all tasks; one task puts the
pieces in place, since an image is one file with places that depend on all that was written before.
"""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from heapq import heappop, heappush
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructType

from .. import schemas
from ..functions import modes
from ..functions.codecs import IDS, NAMES, Codec, codec, few_rows, unpack_options
from ..functions.text import PREFIXES
from .files import expand, local

# The super block, metadata blocks, sentinels and flags.
MAGIC, SUPER, META, NONE32, NONE64, RAW_META, RAW_BLOCK = 0x73717368, struct.Struct("<IIIIIHHHHHHQQQQQQQQ"), 8192, 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF, 0x8000, 1 << 24
NO_FRAGMENTS, ALWAYS_FRAGMENTS, DUPLICATES, EXPORTABLE, NO_XATTRS, OPTIONS, RAW_FRAGMENTS = 0x0010, 0x0020, 0x0040, 0x0080, 0x0200, 0x0400, 0x0008
#: A row of the tables of fragments and of attribute sets.
ROW = struct.Struct("<QII")
DIR, REG, LNK, BLK, CHR, FIFO, SOCK = range(1, 8)
TYPE_BITS = {DIR: modes.DIRECTORY, REG: modes.FILE, LNK: modes.LINK, BLK: modes.BLOCK, CHR: modes.CHARACTER, FIFO: modes.FIFO, SOCK: modes.SOCKET}
BITS_TYPE = {v: k for k, v in TYPE_BITS.items()}
OUT_OF_LINE, INLINE = 0x0100, 8
RUN_ENTRIES, RUN_DELTA, INDEXED_ENTRIES = 256, 32767, 256


class ImageError(ValueError):
    """An image that can't be read; code is the library's number for the reason."""

    def __init__(self, text: str, code: int = -5) -> None:
        super().__init__(text)
        self.code = code


@dataclass
class Inode:
    """A decoded inode; what its type lacks stays at its default."""

    number: int
    type: int
    mode: int
    uid_index: int = 0
    gid_index: int = 0
    mtime: int = 0
    ref: int = 0
    nlink: int = 1
    size: int = 0
    block_start: int = 0
    fragment: int = NONE32
    fragment_offset: int = 0
    sparse_bytes: int = 0
    xattr: int = NONE32
    block_sizes: list[int] = field(default_factory=list)
    target: bytes = b""
    rdev: int = 0
    dir_start: int = 0
    dir_offset: int = 0
    parent: int = 0
    index: list[tuple[int, int, bytes]] = field(default_factory=list)

    @property
    def basic(self) -> int:
        return (self.type - 1) % 7 + 1

    def block_count(self, block_size: int) -> int:
        return self.size // block_size if self.fragment != NONE32 else -(-self.size // block_size)

    def needs_extended(self) -> bool:
        """Whether the basic form would lose something."""
        if self.xattr != NONE32:
            return True
        if self.basic == DIR:
            return self.size > 0xFFFF or bool(self.index)
        if self.basic == REG:
            return self.size > 0xFFFFFFFF or self.block_start > 0xFFFFFFFF or self.sparse_bytes > 0 or self.nlink > 1
        return False


@dataclass
class Unit:
    """A part of a walk: entries of some runs of a directory ("list"), or all that is in the directories among them ("below")."""

    what: str
    path: str
    ref: int
    at: tuple[int, int, int]
    runs: int
    above: tuple[int, ...]
    weight: int


# --- reading --------------------------------------------------------------------------------------------------------


def read_super(data: bytes) -> dict:
    """The fields of a super block, checked."""
    if len(data) < SUPER.size:
        raise ImageError("the file is shorter than a super block", -8)
    names = "magic inode_count mtime block_size fragment_count compressor block_log flags id_count major minor root_ref bytes_used id_table xattr_table inode_table directory_table fragment_table export_table".split()
    s = dict(zip(names, SUPER.unpack_from(data), strict=True))
    if s.pop("magic") != MAGIC:
        raise ImageError("this isn't an image", -9)
    if (s["major"], s["minor"]) != (4, 0):
        raise ImageError("the version isn't 4.0", -10)
    size = s["block_size"]
    if size & (size - 1) or not 4096 <= size <= 1 << 20:
        raise ImageError("the block size isn't a power of two from 4096 to 1048576", -11)
    if size != 1 << s["block_log"] if s["block_log"] < 32 else True:
        raise ImageError("block size and its logarithm disagree", -5)
    if s["compressor"] not in NAMES:
        raise ImageError("the compressor is unknown", -6)
    if not s["id_count"]:
        raise ImageError("there are no ids", -5)
    return s


class Image:
    """An image file, opened for reading."""

    def __init__(self, file) -> None:
        self.file = file
        self.super = read_super(self._at(0, SUPER.size))
        name = NAMES[self.super["compressor"]]
        options = {}
        if self.super["flags"] & OPTIONS:
            head = struct.unpack("<H", self._at(SUPER.size, 2))[0]
            options = unpack_options(name, self._at(SUPER.size + 2, head & 0x7FFF))
        self.codec = Codec(name, self.super["block_size"], options)
        self._meta = lru_cache(maxsize=64)(self._read_meta)
        self._fragment = lru_cache(maxsize=4)(self._read_fragment)

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) < n:
            raise ImageError("a read lies beyond the end", -8)
        return data

    def _read_meta(self, at: int) -> tuple[bytes, int]:
        """An unpacked metadata block and where the next one starts."""
        head = struct.unpack("<H", self._at(at, 2))[0]
        size = head & 0x7FFF
        if not 0 < size <= META:
            raise ImageError("a metadata block has no valid size")
        data = self._at(at + 2, size)
        return data if head & RAW_META else self.codec.decompress(data, META), at + 2 + size

    def cursor(self, base: int, block: int, offset: int) -> Cursor:
        return Cursor(self, base + block, offset, base)

    def table(self, location: int, size: int) -> bytes:
        """A lookup table of size bytes whose list of blocks stands at location."""
        count = -(-size // META)
        out = b"".join(self._meta(at)[0] for at in struct.unpack(f"<{count}Q", self._at(location, 8 * count)))
        if len(out) < size:
            raise ImageError("a lookup table is too short")
        return out[:size]

    def _looked_up(self, location: int, index: int, form: struct.Struct) -> tuple:
        """One row of a lookup table, the others left where they are."""
        block, at = divmod(index * form.size, META)
        data = self._meta(struct.unpack("<Q", self._at(location + 8 * block, 8))[0])[0]
        if at + form.size > len(data):
            raise ImageError("a lookup table is too short")
        return form.unpack_from(data, at)

    @cached_property
    def ids(self) -> list[int]:
        n = self.super["id_count"]
        return list(struct.unpack(f"<{n}I", self.table(self.super["id_table"], 4 * n)))

    @cached_property
    def fragments(self) -> list[tuple[int, int]]:
        n = self.super["fragment_count"]
        if not n or self.super["fragment_table"] == NONE64 or self.super["flags"] & NO_FRAGMENTS:
            return []
        return [(start, size) for start, size, _ in struct.iter_unpack("<QII", self.table(self.super["fragment_table"], 16 * n))]

    @cached_property
    def export(self) -> list[int]:
        n = self.super["inode_count"]
        return [] if self.super["export_table"] == NONE64 else list(struct.unpack(f"<{n}Q", self.table(self.super["export_table"], 8 * n)))

    @cached_property
    def _xattr_sets(self) -> tuple[int, int]:
        """Where the pairs of attribute sets start, and the number of sets."""
        at = self.super["xattr_table"]
        if at == NONE64 or self.super["flags"] & NO_XATTRS:
            return 0, 0
        return struct.unpack("<QI", self._at(at, 12))

    def xattrs(self, index: int) -> list[tuple[str, bytes]]:
        """The pairs of a set."""
        if index == NONE32:
            return []
        start, sets = self._xattr_sets
        if index >= sets:
            raise ImageError("there is no such attribute set", -8)
        ref, count, _ = self._looked_up(self.super["xattr_table"] + 16, index, ROW)
        cursor, out = self.cursor(start, ref >> 16, ref & 0xFFFF), []
        for _ in range(count):
            kind, size = struct.unpack("<HH", cursor.read(4))
            key, value_size = cursor.read(size), struct.unpack("<I", cursor.read(4))[0]
            value = cursor.read(value_size)
            if kind & 0xFF >= len(PREFIXES):
                raise ImageError("an attribute's prefix is unknown", -6)
            if kind & OUT_OF_LINE:
                place = struct.unpack("<Q", value)[0]
                other = self.cursor(start, place >> 16, place & 0xFFFF)
                value = other.read(struct.unpack("<I", other.read(4))[0])
            out.append((PREFIXES[kind & 0xFF] + key.decode("utf-8", "surrogateescape"), value))
        return out

    def inode(self, ref: int) -> Inode:
        return self._inode(self.cursor(self.super["inode_table"], ref >> 16, ref & 0xFFFF), ref)

    def _inode(self, c: Cursor, ref: int) -> Inode:
        kind, mode, uid, gid, mtime, number = struct.unpack("<HHHHII", c.read(16))
        if not 1 <= kind <= 14:
            raise ImageError("an inode's type is unknown")
        i = Inode(number, kind, mode & modes.PERMISSIONS, uid, gid, mtime, ref)
        i.mode |= TYPE_BITS[i.basic]
        extended = kind > 7
        if i.basic == DIR:
            if extended:
                i.nlink, i.size, i.dir_start, i.parent, n, i.dir_offset, i.xattr = struct.unpack("<IIIIHHI", c.read(24))
                for _ in range(n):
                    index, start, size = struct.unpack("<III", c.read(12))
                    i.index.append((index, start, c.read(size + 1)))
            else:
                i.dir_start, i.nlink, i.size, i.dir_offset, i.parent = struct.unpack("<IIHHI", c.read(16))
        elif i.basic == REG:
            if extended:
                i.block_start, i.size, i.sparse_bytes, i.nlink, i.fragment, i.fragment_offset, i.xattr = struct.unpack("<QQQIIII", c.read(40))
            else:
                i.block_start, i.fragment, i.fragment_offset, i.size = struct.unpack("<IIII", c.read(16))
            n = i.block_count(self.super["block_size"])
            i.block_sizes = list(struct.unpack(f"<{n}I", c.read(4 * n)))
        elif i.basic == LNK:
            i.nlink, size = struct.unpack("<II", c.read(8))
            i.target, i.size = c.read(size), size
            i.xattr = struct.unpack("<I", c.read(4))[0] if extended else NONE32
        elif i.basic in (BLK, CHR):
            i.nlink, i.rdev = struct.unpack("<II", c.read(8))
            i.xattr = struct.unpack("<I", c.read(4))[0] if extended else NONE32
        else:
            i.nlink = struct.unpack("<I", c.read(4))[0]
            i.xattr = struct.unpack("<I", c.read(4))[0] if extended else NONE32
        return i

    def inodes(self, ref: int = 0, count: int | None = None) -> Iterator[Inode]:
        """All inodes in the order of the table, or count of them from one on."""
        base = self.super["inode_table"]
        c = self.cursor(base, ref >> 16, ref & 0xFFFF)
        for _ in range(self.super["inode_count"] if count is None else count):
            yield self._inode(c, c.position())

    def marks(self, every: int) -> Iterator[tuple[int, int]]:
        """(reference, number of inodes) of parts of the inode table, of every inodes each. Only lengths are looked at."""
        c, n, size = self.cursor(self.super["inode_table"], 0, 0), self.super["inode_count"], self.super["block_size"]
        for at in range(n):
            if at % every == 0:
                yield c.position(), min(every, n - at)
            kind = struct.unpack_from("<H", c.read(16))[0]
            if kind == 2:
                _, fragment, _, length = struct.unpack("<IIII", c.read(16))
            elif kind == 9:
                _, length, _, _, fragment = struct.unpack_from("<QQQII", c.read(40))
            elif kind in (3, 10):
                c.skip(struct.unpack("<II", c.read(8))[1] + 4 * (kind == 10))
                continue
            elif kind == 8:
                for _ in range(struct.unpack_from("<H", c.read(24), 16)[0]):
                    c.skip(struct.unpack_from("<I", c.read(12), 8)[0] + 1)
                continue
            else:
                if not 1 <= kind <= 14:
                    raise ImageError("an inode's type is unknown")
                c.skip({1: 16, 4: 8, 5: 8, 6: 4, 7: 4, 11: 12, 12: 12, 13: 8, 14: 8}[kind])
                continue
            c.skip(4 * (length // size if fragment != NONE32 else -(-length // size)))

    def runs(self, inode: Inode, at: tuple[int, int, int] | None = None) -> Iterator[tuple[tuple[int, int, int], list[tuple[bytes, int, int, int]]]]:
        """The runs of a directory, each with its place, from which another reader may go on: (block, offset, bytes left)."""
        left = inode.size - 3 if at is None else at[2]
        if left <= 0:
            return
        base = self.super["directory_table"]
        c = self.cursor(base, inode.dir_start, inode.dir_offset) if at is None else self.cursor(base, at[0], at[1])
        while left > 0:
            ref = c.position()
            place = ref >> 16, ref & 0xFFFF, left
            count, start, number = struct.unpack("<III", c.read(12))
            if count >= RUN_ENTRIES:
                raise ImageError("a directory run is too long")
            left -= 12
            run = []
            for _ in range(count + 1):
                offset, delta, kind, size = struct.unpack("<HhHH", c.read(8))
                name = c.read(size + 1)
                left -= 9 + size
                run.append((name, number + delta, start << 16 | offset, kind))
            yield place, run
        if left < 0:
            raise ImageError("a directory run leaves its listing")

    def directory(self, inode: Inode) -> Iterator[tuple[bytes, int, int, int]]:
        """(name, inode number, inode reference, type) of the entries of a directory."""
        for _, run in self.runs(inode):
            yield from run

    def _read_fragment(self, index: int) -> bytes:
        n, at = self.super["fragment_count"], self.super["fragment_table"]
        if index >= n or at == NONE64 or self.super["flags"] & NO_FRAGMENTS:
            raise ImageError("there is no such fragment", -8)
        start, word, _ = self._looked_up(at, index, ROW)
        data = self._at(start, word & (RAW_BLOCK - 1))
        return data if word & RAW_BLOCK else self.codec.decompress(data, self.super["block_size"])

    def blocks(self, inode: Inode, first: int = 0, last: int | None = None) -> Iterator[bytes]:
        """The unpacked blocks of a file from first to before last, and its tail as one more."""
        size = self.super["block_size"]
        at = inode.block_start
        for i, word in enumerate(inode.block_sizes):
            stored = word & (RAW_BLOCK - 1)
            if i >= first and (last is None or i < last):
                want = min(size, inode.size - i * size)
                if not stored:
                    yield bytes(want)
                else:
                    data = self._at(at, stored)
                    data = data if word & RAW_BLOCK else self.codec.decompress(data, size)
                    yield data[:want].ljust(want, b"\0")
            at += stored
        if inode.fragment != NONE32 and inode.size % size and (last is None or last > len(inode.block_sizes)):
            yield self._fragment(inode.fragment)[inode.fragment_offset : inode.fragment_offset + inode.size % size]

    def read(self, inode: Inode, offset: int = 0, length: int | None = None) -> bytes:
        """Bytes of a file, fewer at its end."""
        size = self.super["block_size"]
        end = inode.size if length is None else min(inode.size, offset + length)
        if offset >= end:
            return b""
        first = offset // size
        data = b"".join(self.blocks(inode, first, -(-end // size)))
        return data[offset - first * size : end - first * size]

    def walk(self) -> Iterator[tuple[str, Inode, int]]:
        """(path, inode, inode number of the directory) of the tree, names in order; loops are refused."""
        root = self.inode(self.super["root_ref"])
        yield "", root, 0
        yield from self._below([("", root, frozenset([root.number]))])

    def _below(self, stack: list[tuple[str, Inode, frozenset[int]]]) -> Iterator[tuple[str, Inode, int]]:
        """What is in directories (path, inode, numbers on the way), the last of them first."""
        while stack:
            path, directory, above = stack.pop()
            inner = []
            for full, number, ref, kind in self._named(path, self.directory(directory)):
                child = self.inode(ref)
                yield full, child, directory.number
                if kind == DIR:
                    inner.append(self._inner(full, child, number, above))
            stack += reversed(inner)

    def _named(self, path: str, entries: Iterable[tuple[bytes, int, int, int]]) -> Iterator[tuple[str, int, int, int]]:
        for name, number, ref, kind in entries:
            text = name.decode("utf-8", "surrogateescape")
            if text in ("", ".", "..") or "/" in text:
                raise ImageError(f"{text!r} isn't a name")
            yield f"{path}/{text}" if path else text, number, ref, kind

    def _inner(self, full: str, child: Inode, number: int, above: frozenset[int]) -> tuple[str, Inode, frozenset[int]]:
        if number in above:
            raise ImageError(f"{full!r} leads back to a directory above it", -14)
        return full, child, above | {number}

    def plan(self, most: int) -> list[Unit]:
        """The walk in units that follow one another, some times most of them: pieces of listings, and what is below them.

        Directories are opened level by level until there are enough; where a listing is long it is cut at its runs.
        """
        root = self.inode(self.super["root_ref"])
        out: list[Unit | tuple[str, Inode, frozenset[int]]] = [("", root, frozenset([root.number]))]
        while True:
            opened, grown, more = [], 0, False
            for one in out:
                if isinstance(one, Unit):
                    opened.append(one)
                    continue
                path, directory, above = one
                places: list[tuple[tuple[int, int, int], int, int]] = []  # of a run, its entries, its directories
                for place, run in self.runs(directory):
                    places.append((place, len(run), sum(kind == DIR for *_, kind in run)))
                entries, inside = sum(n for _, n, _ in places), sum(d for *_, d in places)
                opened += self._pieces("list", path, directory, above, places, max(2048, entries // most))
                if inside and grown + inside <= most:
                    opened += [self._inner(full, self.inode(ref), number, above) for full, number, ref, kind in self._named(path, self.directory(directory)) if kind == DIR]
                    more = True
                elif inside:
                    opened += self._pieces("below", path, directory, above, [(p, d, d) for p, _, d in places], max(1, inside // most))
                grown += inside
            out = opened
            if not more:
                return out

    def _pieces(self, what: str, path: str, directory: Inode, above: frozenset[int], places: list[tuple[tuple[int, int, int], int, int]], size: int) -> list[Unit]:
        out, first, runs, weight = [], None, 0, 0
        for place, n, _ in places:
            first = first or place
            runs, weight = runs + 1, weight + n
            if weight >= size:
                out.append(Unit(what, path, directory.ref, first, runs, tuple(above), weight))
                first, runs, weight = None, 0, 0
        return out + [Unit(what, path, directory.ref, first, runs, tuple(above), weight)] * bool(weight)

    def walk_unit(self, unit: Unit) -> Iterator[tuple[str, Inode, int]]:
        directory, above = self.inode(unit.ref), frozenset(unit.above)
        found = (e for _, run in islice(self.runs(directory, unit.at), unit.runs) for e in run)
        for full, number, ref, kind in self._named(unit.path, found):
            if unit.what == "list":
                yield full, self.inode(ref), directory.number
            elif kind == DIR:
                yield from self._below([self._inner(full, self.inode(ref), number, above)])

    def find(self, path: str) -> Inode:
        """The inode at a path, component by component."""
        inode = self.inode(self.super["root_ref"])
        for part in [p for p in path.split("/") if p not in ("", ".")]:
            if inode.basic != DIR:
                raise ImageError(f"{path!r} passes through what is no directory", -12)
            ref = next((r for n, _, r, _ in self.directory(inode) if n == part.encode("utf-8", "surrogateescape")), None)
            if ref is None:
                raise ImageError(f"there is no {path!r}", -13)
            inode = self.inode(ref)
        return inode


class Cursor:
    """Reads through metadata blocks."""

    def __init__(self, image: Image, at: int, offset: int, base: int) -> None:
        self.image, self.at, self.offset, self.base = image, at, offset, base

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            data, following = self.image._meta(self.at)
            part = data[self.offset : self.offset + n - len(out)]
            out += part
            self.offset += len(part)
            if len(out) < n:
                if len(data) < META or not part and self.offset < len(data):
                    raise ImageError("metadata end too early", -8)
                self.at, self.offset = following, 0
        return out

    def skip(self, n: int) -> None:
        while n > 0:
            n -= len(self.read(min(n, META)))

    def position(self) -> int:
        """Reference of what is read next."""
        data, following = self.image._meta(self.at)
        if self.offset >= len(data):
            self.at, self.offset = following, 0
        return (self.at - self.base) << 16 | self.offset


# --- writing --------------------------------------------------------------------------------------------------------


class MetaWriter:
    """Metadata blocks in memory, with the place of what is written next."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.out, self.open = codec, bytearray(), bytearray()

    def position(self) -> tuple[int, int]:
        return len(self.out), len(self.open)

    def write(self, data: bytes) -> None:
        self.open += data
        while len(self.open) >= META:
            self._flush(META)

    def _flush(self, n: int) -> None:
        data = bytes(self.open[:n])
        del self.open[:n]
        packed = self.codec.compress(data)
        self.out += struct.pack("<H", len(packed)) + packed if packed is not None else struct.pack("<H", len(data) | RAW_META) + data

    def finish(self) -> bytes:
        if self.open:
            self._flush(len(self.open))
        return bytes(self.out)


def encode_inode(i: Inode, extended: bool = False) -> bytes:
    extended = extended or i.needs_extended()
    out = struct.pack("<HHHHII", i.basic + 7 * extended, i.mode & modes.PERMISSIONS, i.uid_index, i.gid_index, i.mtime, i.number)
    if i.basic == DIR:
        if extended:
            out += struct.pack("<IIIIHHI", i.nlink, i.size, i.dir_start, i.parent, len(i.index), i.dir_offset, i.xattr)
            return out + b"".join(struct.pack("<III", a, s, len(n) - 1) + n for a, s, n in i.index)
        return out + struct.pack("<IIHHI", i.dir_start, i.nlink, i.size, i.dir_offset, i.parent)
    if i.basic == REG:
        if extended:
            out += struct.pack("<QQQIIII", i.block_start, i.size, i.sparse_bytes, i.nlink, i.fragment, i.fragment_offset, i.xattr)
        else:
            out += struct.pack("<IIII", i.block_start, i.fragment, i.fragment_offset, i.size)
        return out + struct.pack(f"<{len(i.block_sizes)}I", *i.block_sizes)
    if i.basic == LNK:
        return out + struct.pack("<II", i.nlink, len(i.target)) + i.target + (struct.pack("<I", i.xattr) if extended else b"")
    if i.basic in (BLK, CHR):
        out += struct.pack("<II", i.nlink, i.rdev)
    else:
        out += struct.pack("<I", i.nlink)
    return out + (struct.pack("<I", i.xattr) if extended else b"")


def directory_runs(entries: list[tuple[bytes, int, int, int]], used: int = 0) -> Iterator[list[tuple[bytes, int, int, int]]]:
    """Entries (name, number, reference, type), sorted by name, as runs under one header each.

    A run has one inode block, numbers within RUN_DELTA of its first, RUN_ENTRIES entries at most, and ends
    where it would leave the metadata block in which used bytes stand before it.
    """
    run: list[tuple[bytes, int, int, int]] = []
    size = 0
    for entry in entries:
        grown = size + 8 + len(entry[0])
        if run and (entry[2] >> 16 != run[0][2] >> 16 or abs(entry[1] - run[0][1]) > RUN_DELTA or len(run) == RUN_ENTRIES or used + grown > META):
            yield run
            used = (used + size) % META
            run, size = [], 0
        if not run:
            size = 12
            grown = size + 8 + len(entry[0])
        run.append(entry)
        size = grown
    if run:
        yield run


@dataclass
class Packed:
    """A file as cut blocks: (stored bytes, compressed, size) of each, and the tail."""

    blocks: list[tuple[bytes, bool, int]]
    tail: bytes = b""

    @property
    def words(self) -> list[int]:
        return [0 if not data else len(data) | (0 if compressed else RAW_BLOCK) for data, compressed, _ in self.blocks]

    @classmethod
    def of(cls, stored: bytes, words: list[int], size: int, tail: bytes, block_size: int) -> Packed:
        """The same from the stored bytes one after another, their words, and the size of the file."""
        out, at, left = [], 0, size - len(tail)
        for word in words:
            n = word & (RAW_BLOCK - 1)
            out.append((stored[at : at + n], bool(n) and not word & RAW_BLOCK, min(left, block_size)))
            at, left = at + n, left - block_size
        return cls(out, tail)


def cut(content: bytes, codec: Codec, block_size: int, tails: bool) -> Packed:
    whole = len(content) // block_size * block_size if tails else len(content)
    out = []
    for at in range(0, whole, block_size):
        data = content[at : at + block_size]
        if not data.strip(b"\0"):
            out.append((b"", False, len(data)))
        else:
            packed = codec.compress(data)
            out.append((data, False, len(data)) if packed is None else (packed, True, len(data)))
    return Packed(out, content[whole:])


class TableWriter:
    """Writes lookup tables and attribute sets at a file's place."""

    def __init__(self, file, codec: Codec) -> None:
        self.file, self.codec = file, codec

    def _table(self, data: bytes) -> int:
        blocks = []
        for at in range(0, len(data), META):
            one = MetaWriter(self.codec)
            one.write(data[at : at + META])
            blocks.append(self.file.tell())
            self.file.write(one.finish())
        here = self.file.tell()
        self.file.write(struct.pack(f"<{len(blocks)}Q", *blocks))
        return here

    def _xattrs(self, sets: list[tuple]) -> int:
        start = self.file.tell()
        pairs, table, places = MetaWriter(self.codec), b"", {}
        uses: dict[bytes, int] = {}
        for one in sets:
            for _, value in one:
                uses[value] = uses.get(value, 0) + 1
        for one in sets:
            block, offset = pairs.position()
            size = 0
            for key, value in one:
                prefix = next((n for n, p in enumerate(PREFIXES) if key.startswith(p) and len(key) > len(p)), None)
                if prefix is None:
                    raise ImageError(f"an image can't hold the attribute {key!r}", -6)
                name = key[len(PREFIXES[prefix]) :].encode("utf-8", "surrogateescape")
                refer = value in places
                data = struct.pack("<HH", prefix | (OUT_OF_LINE if refer else 0), len(name)) + name
                pairs.write(data)
                if len(value) > INLINE and uses[value] > 1 and not refer:
                    b, o = pairs.position()
                    places[value] = b << 16 | o
                held = struct.pack("<IQ", 8, places[value]) if refer else struct.pack("<I", len(value)) + value
                pairs.write(held)
                size += len(data) + len(held)
            table += struct.pack("<QII", block << 16 | offset, len(one), size)
        self.file.write(pairs.finish())
        blocks = []
        for at in range(0, len(table), META):
            one = MetaWriter(self.codec)
            one.write(table[at : at + META])
            blocks.append(self.file.tell())
            self.file.write(one.finish())
        here = self.file.tell()
        self.file.write(struct.pack("<QII", start, len(sets), 0) + struct.pack(f"<{len(blocks)}Q", *blocks))
        return here


class ImageBuilder(TableWriter):
    """Builds an image from entries that come in any order; nothing but the tables and the open fragment stays in memory."""

    def __init__(self, file, codec: Codec, mtime: int = 0, exportable: bool = False, tails: bool = True, device_block: int = 4096) -> None:
        super().__init__(file, codec)
        self.size, self.mtime, self.exportable, self.tails, self.device_block = codec.block_size, mtime, exportable, tails, device_block
        self.file.write(bytes(SUPER.size))
        self.options = codec.pack_options()
        if self.options is not None:
            self.file.write(struct.pack("<H", len(self.options) | RAW_META) + self.options)
        self.nodes: dict[str, dict] = {}
        self.stored: dict[tuple, tuple[int, list[int]]] = {}  # files by their blocks
        self.tails_at: dict[bytes, tuple[int, int]] = {}
        self.open, self.fragment_table = bytearray(), []

    def add(self, row: dict, packed: Packed | None = None) -> None:
        """An entry: path, mode, and uid, gid, mtime, rdev, target, hard_link, xattrs as they apply; a file's blocks."""
        path = row["path"]
        if path in self.nodes:
            raise ImageError(f"{path!r} is there twice", -16)
        node = dict(row, inode=None)
        node.pop("content", None)
        if not row.get("hard_link") and row["mode"] & modes.TYPE_MASK == modes.FILE:
            node |= self._store(packed or Packed([]))
        self.nodes[path] = node

    def _store(self, packed: Packed) -> dict:
        from hashlib import sha256

        words = packed.words
        out = {"size": sum(n for *_, n in packed.blocks) + len(packed.tail), "sparse": sum(n for data, _, n in packed.blocks if not data), "words": words, "start": 0, "fragment": NONE32, "offset": 0}
        key = tuple(sha256(data).digest() for data, *_ in packed.blocks if data)
        if key and key in self.stored:
            out["start"] = self.stored[key]
        elif key:
            out["start"] = self.stored[key] = self.file.tell()
            for data, *_ in packed.blocks:
                self.file.write(data)
        if packed.tail and not packed.tail.strip(b"\0"):
            words.append(0)  # a tail of zeros is a sparse block
            out["sparse"] += len(packed.tail)
        elif packed.tail:
            name = sha256(packed.tail).digest()
            if name not in self.tails_at:
                if len(self.open) + len(packed.tail) > self.size:
                    self._close_fragment()
                self.tails_at[name] = len(self.fragment_table), len(self.open)
                self.open += packed.tail
            out["fragment"], out["offset"] = self.tails_at[name]
        return out

    def _close_fragment(self) -> None:
        if self.open:
            data = bytes(self.open)
            packed = self.codec.compress(data)
            self.fragment_table.append((self.file.tell(), len(data) | RAW_BLOCK if packed is None else len(packed)))
            self.file.write(data if packed is None else packed)
            self.open = bytearray()

    def _implied(self) -> None:
        for path in list(self.nodes):
            steps = path.split("/")
            for i in range(len(steps)):
                self.nodes.setdefault("/".join(steps[:i]), {"path": "/".join(steps[:i]), "mode": modes.DIRECTORY | 0o755, "mtime": self.mtime})
        self.nodes.setdefault("", {"path": "", "mode": modes.DIRECTORY | 0o755, "mtime": self.mtime})
        for path, node in self.nodes.items():
            above = self.nodes[path.rpartition("/")[0]]
            if path and (above["mode"] & modes.TYPE_MASK != modes.DIRECTORY or above.get("hard_link")):
                raise ImageError(f"{path!r} lies in what is no directory", -12)

    def _numbers(self) -> list[str]:
        """Paths in the order of inode numbers; hard links resolved."""
        for path, node in self.nodes.items():
            seen, at = {path}, path
            while self.nodes[at].get("hard_link"):
                at = self.nodes[at]["target"]
                if at in seen:
                    raise ImageError(f"{path!r} is a link to itself", -14)
                if at not in self.nodes:
                    raise ImageError(f"{path!r} is a link to nothing", -13)
                seen.add(at)
            if node.get("hard_link"):
                if self.nodes[at]["mode"] & modes.TYPE_MASK == modes.DIRECTORY:
                    raise ImageError(f"{path!r} is a hard link to a directory", -16)
                node["resolved"] = at
        encoded = lambda s: s.encode("utf-8", "surrogateescape")

        def key(path: str) -> tuple:
            above, _, name = path.rpartition("/")
            return (path == "", [(0, encoded(p)) for p in above.split("/") if p] + [(1, b"")], encoded(name))

        order = sorted((p for p, n in self.nodes.items() if not n.get("hard_link")), key=key)
        place = {p: i for i, p in enumerate(order)}
        early: dict[str, tuple] = {}
        for path, node in self.nodes.items():
            if node.get("hard_link"):
                above, _, name = path.rpartition("/")
                first = (place[above], 0, encoded(name))
                if place[above] < place[node["resolved"]]:
                    early[node["resolved"]] = min(early.get(node["resolved"], first), first)
        return sorted(order, key=lambda p: early.get(p, (place[p], 1, b"")))

    def finish(self) -> dict:
        """Writes all tables and the super block; returns counts."""
        self._close_fragment()
        self._implied()
        order = self._numbers()
        number = {p: i for i, p in enumerate(order, 1)}
        children: dict[str, list[str]] = {}
        links: dict[str, int] = {}
        for path, node in self.nodes.items():
            if path:
                children.setdefault(path.rpartition("/")[0], []).append(path)
            if node.get("hard_link"):
                links[node["resolved"]] = links.get(node["resolved"], 0) + 1
        ids: dict[int, int] = {}
        sets: dict[tuple, int] = {}
        inodes, directories, refs, kinds = MetaWriter(self.codec), MetaWriter(self.codec), {}, {}
        for path in order:
            node = self.nodes[path]
            i = Inode(number[path], BITS_TYPE[node["mode"] & modes.TYPE_MASK], node["mode"])
            i.uid_index, i.gid_index = (ids.setdefault(node.get(c) or 0, len(ids)) for c in ("uid", "gid"))
            if len(ids) > 1 << 16:
                raise ImageError("there are too many different ids", -7)
            i.mtime = min(max(node.get("mtime") or 0, 0), 0xFFFFFFFF)
            i.nlink = (2 + len(children.get(path, []))) if i.basic == DIR else 1 + links.get(path, 0)
            if pairs := node.get("xattrs"):
                i.xattr = sets.setdefault(tuple(sorted(pairs.items())), len(sets))
            i.rdev = node.get("rdev") or 0
            if i.basic == LNK:
                i.target = (node.get("target") or "").encode("utf-8", "surrogateescape")
            elif i.basic == REG:
                i.size, i.sparse_bytes, i.block_sizes, i.block_start, i.fragment, i.fragment_offset = (node[k] for k in ("size", "sparse", "words", "start", "fragment", "offset"))
            elif i.basic == DIR:
                self._directory(i, path, children.get(path, []), number, refs, kinds, directories)
            block, offset = inodes.position()
            refs[path], kinds[path] = block << 16 | offset, i.basic
            inodes.write(encode_inode(i))
        # a directory is numbered after all that lies in it, the root last: parents are put in afterwards
        s = {"inode_table": self.file.tell()}
        self.file.write(inodes.finish())
        s["directory_table"] = self.file.tell()
        self.file.write(directories.finish())
        flags = DUPLICATES | (OPTIONS if self.options is not None else 0)
        s["fragment_table"] = NONE64
        if self.fragment_table:
            flags |= ALWAYS_FRAGMENTS | (RAW_FRAGMENTS if all(w & RAW_BLOCK for _, w in self.fragment_table) else 0)
            s["fragment_table"] = self._table(b"".join(struct.pack("<QII", a, w, 0) for a, w in self.fragment_table))
        else:
            flags |= NO_FRAGMENTS
        s["export_table"] = NONE64
        if self.exportable:
            flags |= EXPORTABLE
            s["export_table"] = self._table(b"".join(struct.pack("<Q", refs[p]) for p in order))
        s["id_table"] = self._table(b"".join(struct.pack("<I", i) for i in ids))
        s["xattr_table"] = self._xattrs(list(sets)) if sets else NONE64
        flags |= 0 if sets else NO_XATTRS
        used = self.file.tell()
        self.file.write(bytes(-used % self.device_block))
        self.file.seek(0)
        self.file.write(SUPER.pack(MAGIC, len(order), self.mtime, self.size, len(self.fragment_table), IDS[self.codec.name], int(math.log2(self.size)), flags, len(ids), 4, 0, refs[""], used, s["id_table"], s["xattr_table"], s["inode_table"], s["directory_table"], s["fragment_table"], s["export_table"]))
        return {"inodes": len(order), "bytes": used, "fragments": len(self.fragment_table), "ids": len(ids), "attribute_sets": len(sets)}

    def _directory(self, i: Inode, path: str, children: list[str], number: dict, refs: dict, kinds: dict, out: MetaWriter) -> None:
        entries = []
        for child in children:
            at = self.nodes[child].get("resolved", child)
            entries.append((child.rpartition("/")[2].encode("utf-8", "surrogateescape"), number[at], refs[at], kinds[at]))
        entries.sort()
        above = path.rpartition("/")[0]
        i.parent = number[above] if path else 0
        i.dir_start, i.dir_offset = out.position()
        i.size = 3
        runs = []
        for run in directory_runs(entries, i.dir_offset):
            start, _ = out.position()
            runs.append((i.size - 3, start, run[0][0]))
            data = struct.pack("<III", len(run) - 1, run[0][2] >> 16, run[0][1])
            data += b"".join(struct.pack("<HhHH", ref & 0xFFFF, n - run[0][1], kind, len(name) - 1) + name for name, n, ref, kind in run)
            out.write(data)
            i.size += len(data)
        if len(entries) >= INDEXED_ENTRIES:
            i.index = runs


# --- tables as rows ---------------------------------------------------------------------------------------------------


def _null(value: int, none: int) -> int | None:
    return None if value == none else value


def _super_rows(image: Image, name: str) -> Iterator[tuple]:
    s = image.super
    yield (name, *[_null(s[f.name], NONE64) for f in schemas.SUPER.fields[1:]])


def _inode_row(i: Inode, name: str) -> tuple:
    regular, directory = i.basic == REG, i.basic == DIR
    return (
        name, i.number, i.ref, i.type, i.mode, i.uid_index, i.gid_index, i.mtime, i.nlink, i.size, i.block_start if regular else None, _null(i.fragment, NONE32) if regular else None, i.fragment_offset if regular else None,
        i.sparse_bytes if regular else None, _null(i.xattr, NONE32), i.block_sizes if regular else None, i.target.decode("utf-8", "surrogateescape") if i.basic == LNK else None, i.rdev if i.basic in (BLK, CHR) else None,
        i.dir_start if directory else None, i.dir_offset if directory else None, i.parent if directory else None, [(a, s, n.decode("utf-8", "surrogateescape")) for a, s, n in i.index] if directory else None,
    )


def _dirent_rows(image: Image, name: str, part: tuple = ()) -> Iterator[tuple]:
    for i in image.inodes(*part):
        if i.basic == DIR:
            for at, (entry, number, ref, kind) in enumerate(image.directory(i)):
                yield name, i.number, entry.decode("utf-8", "surrogateescape"), number, ref, kind, at


def _block_rows(image: Image, name: str, part: tuple = ()) -> Iterator[tuple]:
    for i in image.inodes(*part):
        if i.basic == REG:
            at = i.block_start
            for n, (word, data) in enumerate(zip(i.block_sizes, image.blocks(i, 0, len(i.block_sizes)), strict=True)):
                stored = word & (RAW_BLOCK - 1)
                yield name, i.number, n, at, stored, bool(stored and not word & RAW_BLOCK), stored == 0, data
                at += stored


def entry_row(image: Image, name: str, seq: int, path: str, i: Inode, names: set[str]) -> tuple:
    ids = image.ids
    if max(i.uid_index, i.gid_index) >= len(ids):
        raise ImageError("an id index lies beyond the table", -8)
    content = image.read(i) if i.basic == REG and "content" in names else None
    xattrs = dict(image.xattrs(i.xattr)) if "xattrs" in names else None
    return (path, i.mode, ids[i.uid_index], ids[i.gid_index], i.mtime, i.size, i.rdev, i.target.decode("utf-8", "surrogateescape") if i.basic == LNK else None, False, None, i.number, seq, content, xattrs, None, name, i.nlink, i.type > 7)


ENTRIES = StructType(list(schemas.ENTRIES.fields)).add("image", StringType()).add("nlink", LongType()).add("extended", "boolean")
TABLES = {"super": schemas.SUPER, "inodes": schemas.INODES, "dirents": schemas.DIRENTS, "fragments": schemas.FRAGMENTS, "ids": schemas.IDS, "xattrs": schemas.XATTRS, "export": schemas.EXPORT, "blocks": schemas.BLOCKS, "entries": ENTRIES}


def table_rows(image: Image, name: str, table: str, part: tuple = ()) -> Iterator[tuple]:
    """Rows of a table; of those that follow the inodes, a part (reference of the first inode, number of them) may be asked for."""
    if table == "super":
        yield from _super_rows(image, name)
    elif table == "inodes":
        yield from (_inode_row(i, name) for i in image.inodes(*part))
    elif table == "dirents":
        yield from _dirent_rows(image, name, part)
    elif table == "fragments":
        yield from ((name, n, start, word & (RAW_BLOCK - 1), not word & RAW_BLOCK) for n, (start, word) in enumerate(image.fragments))
    elif table == "ids":
        yield from ((name, n, value) for n, value in enumerate(image.ids))
    elif table == "xattrs":
        yield from ((name, n, at, key, value) for n in range(image._xattr_sets[1]) for at, (key, value) in enumerate(image.xattrs(n)))
    elif table == "export":
        yield from ((name, n, _null(ref, NONE64)) for n, ref in enumerate(image.export, 1))
    elif table == "blocks":
        yield from _block_rows(image, name, part)
    else:
        raise ValueError(f"no table {table!r}")


#: Images of more bytes or inodes than this are read by a task for each so many of them.
SLICE_BYTES, SLICE_INODES = 32 << 20, 50_000


@dataclass
class Slice(InputPartition):
    """A whole image; or a part of its inodes, or some units of its walk, each with its number."""

    path: str
    part: tuple
    units: list[tuple[int, Unit]] | None

    def __init__(self, path: str, part: tuple = (), units: list[tuple[int, Unit]] | None = None) -> None:
        super().__init__(path)
        self.path, self.part, self.units = path, part, units


class ImageReader(DataSourceReader):
    """A partition for a small image. Entries of larger ones, and of all if ``slices`` asks for it, are dealt over some, as
    are tables that follow the inodes. Filters on path are applied before contents are unpacked.

    seq is the place in the walk; with several slices it leaves gaps, a number for each unit and the place within it.
    """

    def __init__(self, schema: StructType, options: dict) -> None:
        self.options, self.names = options, set(schema.names)
        self.wanted: list[tuple[str, str]] = []

    def _table(self) -> str:
        return self.options.get("table", "entries")

    def partitions(self) -> list[Slice]:
        return [s for p in expand(self.options["path"]) for s in self._slices(p)]

    def _slices(self, path: str) -> list[Slice]:
        asked = int(self.options.get("slices", 1)) if self._table() == "entries" else 1
        if self._table() not in ("entries", "inodes", "dirents", "blocks"):
            return [Slice(path)]
        with open(path, "rb") as file:
            image = Image(file)
            n = max(asked, -(-image.super["bytes_used"] // SLICE_BYTES), -(-image.super["inode_count"] // SLICE_INODES))
            if n == 1:
                return [Slice(path)]
            if self._table() != "entries":
                return [Slice(path, mark) for mark in image.marks(-(-image.super["inode_count"] // n))]
            dealt: list[list[tuple[int, Unit]]] = [[] for _ in range(n)]
            load = [(0, i) for i in range(n)]
            # the heaviest first, each to the slice that has least so far
            for number, unit in sorted(enumerate(image.plan(8 * n), 1), key=lambda u: (u[1].what, -u[1].weight)):
                weight, i = heappop(load)
                dealt[i].append((number, unit))
                heappush(load, (weight + unit.weight * (16 if unit.what == "below" else 1), i))
            return [Slice(path, (), sorted(units, key=lambda u: u[0])) for i, units in enumerate(dealt) if units or not i]

    def read(self, partition: Slice) -> Iterator[tuple]:
        names = self.names - ({"content"} if str(self.options.get("content", "true")).lower() != "true" else set())
        with open(partition.path, "rb") as file:
            image = Image(file)
            if self._table() != "entries":
                yield from table_rows(image, partition.path, self._table(), partition.part)
                return
            for seq, path, inode in self._walked(image, partition.units):
                if all(path == v if how == "is" else path.startswith(v) for how, v in self.wanted):
                    yield entry_row(image, partition.path, seq, path, inode, names)

    def _walked(self, image: Image, units: list[tuple[int, Unit]] | None) -> Iterator[tuple[int, str, Inode]]:
        if units is None:
            yield from ((seq, path, inode) for seq, (path, inode, _) in enumerate(image.walk()))
            return
        if not units or units[0][0] == 1:
            yield 0, "", image.inode(image.super["root_ref"])
        for number, unit in units:
            yield from ((number << 36 | n, path, inode) for n, (path, inode, _) in enumerate(image.walk_unit(unit)))


class PushingImageReader(ImageReader):
    """The same, taking filters from the plan where the session allows it."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if self._table() == "entries" and f.__class__ in (EqualTo, StringStartsWith) and tuple(f.attribute) == ("path",):
                self.wanted.append(("is" if isinstance(f, EqualTo) else "under", f.value))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class ImageWriter(DataSourceWriter):
    """One image from one partition of prepared entries; the file appears when the write commits."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.options, self.overwrite = options, overwrite

    def _codec(self) -> Codec:
        return codec(self.options.get("compressor", "gzip"), int(self.options.get("block_size", 1 << 17)), self.options.get("compressor_options", ""))

    def write(self, rows: Iterator) -> Written:
        rows = iter(rows)
        first = next(rows, None)
        if first is None:
            return Written(None)
        temporary = f"{local(self.options['path'])}.part"
        flag = lambda name, default: str(self.options.get(name, default)).lower() == "true"
        with open(temporary, "wb+") as file:
            builder = ImageBuilder(file, self._codec(), int(self.options.get("mtime", 0)), flag("exportable", "false"), flag("tails", "true"), int(self.options.get("device_block_size", 4096)))
            for row in (r for part in ([first], rows) for r in part):
                r = row.asDict(recursive=True)
                packed = Packed.of(bytes(r["stored"] or b""), r["words"] or [], r["size"] or 0, bytes(r["tail"] or b""), builder.size)
                builder.add({k: v for k, v in r.items() if k not in ("stored", "words", "size", "tail", "digest", "tail_digest")}, packed)
            builder.finish()
            file.flush()
            os.fsync(file.fileno())
        return Written(temporary)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m.path for m in messages if m and m.path]
        path = local(self.options["path"])
        if len(done) != 1 or os.path.exists(path) and not self.overwrite:
            self.abort(messages)
            raise ImageError(f"{path} exists" if len(done) == 1 else "an image is written from one partition", -16)
        os.replace(done[0], path)

    def abort(self, messages: list[Written | None]) -> None:
        import contextlib

        with contextlib.suppress(FileNotFoundError):
            os.remove(f"{local(self.options['path'])}.part")


class ImageDataSource(DataSource):
    """``spark.read.format("arcimage").option("table", ...).load(path)``: one of super, inodes, dirents, fragments, ids, xattrs, export, blocks, entries."""

    @classmethod
    def name(cls) -> str:
        return "arcimage"

    def schema(self) -> StructType:
        table = self.options.get("table", "entries")
        if table not in TABLES:
            raise ValueError(f"no table {table!r}")
        return TABLES[table]

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingImageReader if self.options.get("pushdown") == "true" else ImageReader)(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        return ImageWriter(dict(self.options), overwrite)


def read_image(spark: SparkSession, path: str, table: str = "entries", content: bool = True, slices: int = 1) -> DataFrame:
    spark.dataSource.register(ImageDataSource)
    return spark.read.format("arcimage").option("table", table).option("content", str(content).lower()).option("slices", slices).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load(path)


#: What ``prepare`` puts in place of a content: stored blocks one after another, their words, and digests of what is stored.
PREPARED = "stored binary, words array<long>, size long, digest binary, tail binary, tail_digest binary"


def prepare(entries: DataFrame, codec: Codec, tails: bool = True) -> DataFrame:
    """entries with PREPARED in place of content: files cut and compressed, each task its own rows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    added = _parse_datatype_string(PREPARED)
    kept = [c for c in entries.columns if c != "content" and c not in added.names]
    schema = StructType([entries.schema[c] for c in kept] + list(added.fields))
    arrow = to_arrow_schema(schema)

    def one(content: bytes) -> tuple:
        from hashlib import sha256

        p = cut(content, codec, codec.block_size, tails)
        digests = [sha256(data).digest() for data, *_ in p.blocks if data]
        tail = p.tail if p.tail.strip(b"\0") else b""
        return b"".join(data for data, *_ in p.blocks), p.words, len(content), sha256(b"".join(digests)).digest() if digests else None, p.tail, sha256(tail).digest() if tail else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in few_rows(batches):
            done = [one(c or b"") for c in held.column("content").to_pylist()]
            columns = [held.column(c).cast(arrow.field(c).type) for c in kept] + [pa.array(c, arrow.field(f.name).type) for c, f in zip(zip(*done, strict=True), added.fields, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return entries.select(*kept, "content").mapInArrow(run, schema)


#: Images of up to so many entries and stored bytes are put together by one task, larger ones by all.
SMALL_ENTRIES, SMALL_BYTES = 20_000, 32 << 20


def write_image(entries: DataFrame, path: str, compressor: str = "gzip", block_size: int = 1 << 17, options: str = "", mtime: int = 0, exportable: bool = False, tails: bool = True, overwrite: bool = True, device_block_size: int = 4096) -> None:
    """Writes entries as one image, files in the order of position, seq or path, whichever there is.

    Missing directories are put in. Equal input gives equal bytes, on any number of partitions. A small image is
    put together by one task; the bytes and tables of a larger one are placed and written by all.
    """
    from ..operators.entries import path_key
    from ..session import checkpointed

    entries.sparkSession.dataSource.register(ImageDataSource)
    order = next(([F.col(c)] for c in ("position", "seq") if c in entries.columns), [path_key()])
    if "content" not in entries.columns:
        entries = entries.withColumn("content", F.lit(None).cast("binary"))
    packer = codec(compressor, block_size, options)
    ready = checkpointed(prepare(entries, packer, tails).withColumn("row id", F.monotonically_increasing_id()))
    n, stored = ready.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("stored") + F.octet_length("tail")), F.lit(0))).first()
    if n > SMALL_ENTRIES or stored > SMALL_BYTES:
        from .image_spread import write_spread

        if os.path.exists(local(path)) and not overwrite:
            raise ImageError(f"{local(path)} exists", -16)
        return write_spread(ready, [*order, F.col("path")], local(path), packer, mtime, exportable, device_block_size)
    known = [c for c in ("path", "mode", "uid", "gid", "mtime", "rdev", "target", "hard_link", "xattrs", "stored", "words", "size", "tail") if c in ready.columns]
    rows = ready.repartition(1).sortWithinPartitions(*order, "path").select(*known)
    writer = rows.write.format("arcimage").mode("overwrite" if overwrite else "append").option("path", path).option("compressor", compressor).option("block_size", block_size).option("compressor_options", options)
    writer.option("mtime", mtime).option("exportable", str(exportable).lower()).option("tails", str(tails).lower()).option("device_block_size", device_block_size).save()
