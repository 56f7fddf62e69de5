"""Tar archives: decoding and writing of records, a DataSource over archives, and a sink.

Read are v7, ustar, GNU (long names, base-256 numbers, sparse maps) and pax records; compressed archives are
unpacked by their first bytes. An archive is one stream, so that it is one task; many archives are many.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StringType, StructType, _parse_datatype_string

from ..functions import modes
from ..functions.codecs import few_rows, open_stream, pack_stream, stream_kind
from ..functions.text import decode_base64, decode_url
from ..schemas import ENTRIES

RECORD = 512
# Fields of a header record.
FIELDS = {"name": (0, 100), "mode": (100, 8), "uid": (108, 8), "gid": (116, 8), "size": (124, 12), "mtime": (136, 12), "checksum": (148, 8), "type": (156, 1), "link": (157, 100), "magic": (257, 6), "version": (263, 2), "major": (329, 8), "minor": (337, 8), "prefix": (345, 155)}
KINDS = {b"0": modes.FILE, b"\0": modes.FILE, b"7": modes.FILE, b"S": modes.FILE, b"2": modes.LINK, b"3": modes.CHARACTER, b"4": modes.BLOCK, b"5": modes.DIRECTORY, b"6": modes.FIFO}
MOST_EXTENTS = 65536


class TarError(ValueError):
    """An archive that can't be read, or an entry that can't be written."""


@dataclass
class Record:
    """An entry of an archive. sparse lists (offset, count) of the data in a file of size bytes; None for a plain one."""

    path: str = ""
    mode: int = modes.FILE
    uid: int = 0
    gid: int = 0
    mtime: int = 0
    size: int = 0
    rdev: int = 0
    target: str | None = None
    hard_link: bool = False
    sparse: list[tuple[int, int]] | None = None
    xattrs: dict[str, bytes] = field(default_factory=dict)
    content: bytes | None = None


# --- numbers and names ------------------------------------------------------------------------------------------


def read_number(data: bytes) -> int:
    """Octal digits with blanks around, or a two's complement number in base 256 if the first bit is set."""
    if data[0] & 0x80:
        value = int.from_bytes(data, "big")
        bits = 8 * len(data) - 1
        # the first bit marks the form, the one after it is the sign
        return value - (1 << bits + 1) if data[0] & 0x40 else value - (1 << bits)
    digits = data.strip(b" \0").split(b"\0")[0].strip()
    if not digits:
        return 0
    if not all(48 <= c < 56 for c in digits):
        raise TarError("a number isn't octal")
    return int(digits, 8)


def write_number(value: int, width: int) -> bytes:
    if 0 <= value < 8 ** (width - 1):
        return f"{value:0{width - 1}o}".encode() + b"\0"
    form = (1 << 8 * width - 1) if value >= 0 else (1 << 8 * width)
    return (value + form).to_bytes(width, "big")


def _text(data: bytes) -> str:
    return data.split(b"\0")[0].decode("utf-8", "surrogateescape")


def checksum(header: bytes) -> int:
    """Sum of a header's bytes, its checksum field as blanks."""
    at, n = FIELDS["checksum"]
    return sum(header) - sum(header[at : at + n]) + 32 * n


def canonical(name: str) -> str | None:
    parts = [p for p in name.split("/") if p not in ("", ".")]
    return None if ".." in parts else "/".join(parts)


# --- reading ------------------------------------------------------------------------------------------------------


def pax_records(data: bytes) -> list[tuple[str, bytes]]:
    """(key, value) of the ``length key=value`` lines of a pax record, in order."""
    out, at = [], 0
    while at < len(data) and data[at : at + 1] != b"\0":
        space = data.find(b" ", at)
        digits = data[at:space]
        if space < 0 or not digits.isdigit():
            raise TarError("a pax line has no length")
        end = at + int(digits)
        line = data[space + 1 : end - 1]
        key, eq, value = line.partition(b"=")
        if end > len(data) or end <= space or not eq:
            raise TarError("a pax line is cut off")
        out.append((key.decode("utf-8", "surrogateescape"), value))
        at = end
    return out


def apply_pax(record: Record, pairs: Iterable[tuple[str, bytes]], real: dict) -> set[str]:
    """Puts the pairs that are known into record and says which fields they set. Sparse details go to real."""
    seen: set[str] = set()
    offset = None
    found: list[tuple[str, bytes]] = []
    for key, value in pairs:
        if key in ("uid", "gid", "size"):
            setattr(record, key, int(value))
        elif key == "mtime":
            record.mtime = int(value.split(b".")[0] or 0)
        elif key in ("path", "GNU.sparse.name"):
            record.path, key = value.decode("utf-8", "surrogateescape"), "path"
        elif key == "linkpath":
            record.target = value.decode("utf-8", "surrogateescape")
        elif key in ("GNU.sparse.size", "GNU.sparse.realsize"):
            real["size"] = int(value)
        elif key in ("GNU.sparse.major", "GNU.sparse.minor"):
            real[key[-5:]] = int(value)
        elif key == "GNU.sparse.map":
            numbers = [int(n) for n in value.split(b",")] if value else []
            real["map"] = list(zip(numbers[::2], numbers[1::2], strict=False))
        elif key == "GNU.sparse.offset":
            offset = int(value)
        elif key == "GNU.sparse.numbytes" and offset is not None:
            real.setdefault("map", []).append((offset, int(value)))
            offset = None
        elif key.startswith("SCHILY.xattr."):
            found.append((key[len("SCHILY.xattr.") :], value))
        elif key.startswith("LIBARCHIVE.xattr."):
            decoded = decode_base64(value.decode("latin-1"))
            if decoded is None:
                raise TarError("an attribute isn't base64")
            found.append((decode_url(key[len("LIBARCHIVE.xattr.") :].encode()).decode("utf-8", "surrogateescape"), decoded))
        else:
            continue
        seen.add(key)
    record.xattrs |= dict(found)
    return seen


def _exactly(file, n: int) -> bytes:
    data = file.read(n)
    while len(data) < n and (more := file.read(n - len(data))):
        data += more
    if len(data) < n:
        raise TarError("the archive is cut off")
    return data


class Plain:
    """A file on disk whose bytes may be passed over unread."""

    def __init__(self, file) -> None:
        self.file, self.read, self.tell = file, file.read, file.tell
        self.size = os.fstat(file.fileno()).st_size

    def skip(self, n: int) -> None:
        if self.file.seek(n, 1) > self.size:
            raise TarError("the archive is cut off")


def _skip(file, n: int) -> None:
    if isinstance(file, Plain):
        file.skip(n)
        return
    while n > 0:
        n -= len(_exactly(file, min(n, 1 << 20)))


def _old_map(file, header: bytes) -> tuple[list[tuple[int, int]], int]:
    """The extents of an old GNU header and of the records that continue it, and the file's size."""
    size = read_number(header[483:495])
    out, table, more = [], header[386:482], header[482]
    while True:
        for i in range(0, len(table), 24):
            if not 48 <= table[i] < 58 and not table[i] & 0x80:
                more = 0
                break
            out.append((read_number(table[i : i + 12]), read_number(table[i + 12 : i + 24])))
        if not more:
            return out, size
        table = _exactly(file, RECORD)
        table, more = table[:504], table[504]


def _new_map(file) -> tuple[list[tuple[int, int]], int]:
    """The extents at the head of a file's data, as decimal lines in whole records, and the bytes that they take."""
    data, numbers, need = b"", [], None
    while need is None or len(numbers) < need:
        data += _exactly(file, RECORD)
        lines = data.split(b"\n")[:-1]
        if lines and not all(n.isdigit() for n in lines[: None if need is None else need]):
            raise TarError("a sparse map isn't made of numbers")
        if lines and need is None:
            if not 1 <= int(lines[0]) <= MOST_EXTENTS:
                raise TarError("a sparse map is too long")
            need = 1 + 2 * int(lines[0])
        numbers = lines
    pairs = [int(n) for n in numbers[1:need]]
    return list(zip(pairs[::2], pairs[1::2], strict=True)), len(data)


def _spread(data: bytes, extents: list[tuple[int, int]], size: int) -> bytes:
    out, at = bytearray(size), 0
    for offset, count in extents:
        out[offset : offset + count] = data[at : at + count]
        at += count
    if len(out) != size:
        raise TarError("an extent lies beyond the file")
    return bytes(out)


def read_records(file, with_content: bool = True) -> Iterator[Record]:
    """The entries of an archive, in order. Records of unknown kinds are skipped, names that leave the tree refused.

    Without content, the bytes of files are skipped over.
    """
    zeros, record, seen, real = 0, Record(), set(), {}
    while True:
        header = file.read(RECORD)
        if not header:
            return
        header += _exactly(file, RECORD - len(header)) if len(header) < RECORD else b""
        if not any(header):
            zeros += 1
            if zeros == 2:
                return
            continue
        zeros = 0
        get = lambda f: header[FIELDS[f][0] : sum(FIELDS[f])]  # noqa: B023, E731
        if read_number(get("checksum")) != checksum(header):
            raise TarError("a header's checksum is wrong")
        kind, size = get("type"), read_number(get("size"))
        padded = -(-size // RECORD) * RECORD
        if kind in b"LKxg" and kind != b"":
            data = _exactly(file, padded)[:size]
            if kind == b"L":
                record.path, seen = _text(data), seen | {"path"}
            elif kind == b"K":
                record.target, seen = _text(data), seen | {"linkpath"}
            elif kind == b"x":
                seen |= apply_pax(record, pax_records(data), real)
            continue
        ustar = get("magic")[:5] == b"ustar"
        posix = ustar and get("magic") == b"ustar\0"
        if "path" not in seen:
            prefix = _text(get("prefix")) if posix else ""
            record.path = f"{prefix}/{_text(get('name'))}" if prefix else _text(get("name"))
        if "linkpath" not in seen:
            record.target = _text(get("link"))
        for name in ("uid", "gid", "mtime"):
            if name not in seen:
                setattr(record, name, read_number(get(name)))
        if "size" not in seen:
            record.size = size
        stored = record.size
        directory = kind in (b"0", b"\0") and record.path.endswith("/")
        bits = modes.DIRECTORY if directory else modes.LINK if kind == b"1" else KINDS.get(kind)
        record.mode = (read_number(get("mode")) & modes.PERMISSIONS) | (bits or 0)
        if bits is None:
            _skip(file, -(-stored // RECORD) * RECORD)
            record, seen, real = Record(), set(), {}
            continue
        if bits == modes.LINK:
            record.mode = modes.LINK | 0o777
            record.hard_link = kind == b"1"
        else:
            record.target = None
        if bits in (modes.CHARACTER, modes.BLOCK):
            major, minor = read_number(get("major")), read_number(get("minor"))
            record.rdev = (major & 0xFFF) << 8 | minor & 0xFF | (minor & 0xFFF00) << 12
        taken = 0
        if kind == b"S":
            record.sparse, record.size = _old_map(file, header)
        elif "map" in real:
            record.sparse, record.size = real["map"], real.get("size", record.size)
        elif real.get("major") == 1:
            record.sparse, taken = _new_map(file)
            record.size = real.get("size", record.size)
        left = stored - taken
        whole = -(-stored // RECORD) * RECORD - taken
        if bits == modes.FILE and with_content:
            data = _exactly(file, whole)[:left]
            record.content = data if record.sparse is None else _spread(data, record.sparse, record.size)
        else:
            _skip(file, whole if bits == modes.FILE or stored else 0)
        if bits != modes.FILE:
            record.size = 0
        path = canonical(record.path)
        if path is None:
            raise TarError(f"{record.path!r} leaves the tree")
        record.path = path
        if record.hard_link:
            record.target = canonical(record.target or "")
        yield record
        record, seen, real = Record(), set(), {}


# --- writing ------------------------------------------------------------------------------------------------------


def _header(name: bytes, kind: bytes, mode: int, uid: int, gid: int, size: int, mtime: int, link: bytes = b"", rdev: int = 0) -> bytes:
    out = bytearray(RECORD)

    def put(field: str, value: bytes) -> None:
        at, n = FIELDS[field]
        out[at : at + min(n, len(value))] = value[:n]

    put("name", name)
    put("link", link)
    for field, value in (("mode", mode), ("uid", uid), ("gid", gid), ("size", size), ("mtime", mtime), ("major", rdev >> 8 & 0xFFF), ("minor", rdev & 0xFF | rdev >> 12 & 0xFFF00)):
        put(field, write_number(value, FIELDS[field][1]))
    put("type", kind)
    put("magic", b"ustar ")
    put("version", b" \0")
    put("checksum", f"{checksum(bytes(out)):06o}\0 ".encode())
    return bytes(out)


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % RECORD)


def _pax(pairs: dict[str, bytes]) -> bytes:
    out = b""
    for key, value in pairs.items():
        body = f" {key}=".encode() + value + b"\n"
        length = len(body) + len(str(len(body)))
        length += len(str(length)) > len(str(len(body)))
        out += str(length).encode() + body
    return out


def write_record(record: Record, number: int = 0) -> bytes:
    """An entry as records of an archive. Sockets and unknown kinds can't be written."""
    link = record.hard_link
    bits = record.mode & modes.TYPE_MASK
    kinds = {modes.FILE: b"0", modes.LINK: b"2", modes.CHARACTER: b"3", modes.BLOCK: b"4", modes.DIRECTORY: b"5", modes.FIFO: b"6"}
    if bits not in kinds and not link:
        raise TarError(f"{record.path!r}: an archive can't hold this kind of entry")
    name = record.path.encode("utf-8", "surrogateescape") + (b"/" if bits == modes.DIRECTORY and not record.path.endswith("/") else b"")
    target = (record.target or "").encode("utf-8", "surrogateescape") if link or bits == modes.LINK else b""
    out = b""
    if record.xattrs and not link:
        body = _pax({f"SCHILY.xattr.{k}": v for k, v in record.xattrs.items()})
        out += _header(f"pax/xattr{number}".encode(), b"x", 0o644, 0, 0, len(body), 0) + _padded(body)
    for kind, text in ((b"K", target), (b"L", name)):
        if len(text) > FIELDS["name"][1] - 1:
            out += _header(b"././@LongLink", kind, 0o644, 0, 0, len(text) + 1, 0) + _padded(text + b"\0")
    content = record.content or b"" if bits == modes.FILE and not link else b""
    kind = b"1" if link else kinds[bits]
    mode = 0o777 if kind in (b"1", b"2") else record.mode & modes.PERMISSIONS
    return out + _header(name[:99], kind, mode, record.uid, record.gid, len(content), record.mtime, target[:99], record.rdev) + _padded(content)


END = bytes(2 * RECORD)


# --- DataSource ---------------------------------------------------------------------------------------------------


#: An archive that isn't compressed is read by a task for each so many of its bytes.
PART_BYTES = 32 << 20


def parts_of(path: str) -> Iterator[tuple[int, int | None, int]]:
    """(first byte, end, number of the first entry) of the parts of an archive that can be read alone, end being null for
    the last. A large archive's headers are read one after another, and nothing else; a compressed one has one part."""
    with open(path, "rb") as file:
        if stream_kind(file.read(8)) or os.fstat(file.fileno()).st_size <= PART_BYTES:
            yield 0, None, 0
            return
        file.seek(0)
        plain, begin, first, n = Plain(file), 0, 0, 0
        for n, _ in enumerate(read_records(plain, False), 1):
            if plain.tell() - begin >= PART_BYTES:
                yield begin, plain.tell(), first
                begin, first = plain.tell(), n
        yield begin, None, first


def read_part(path: str, begin: int, end: int | None, first: int, content: bool = True) -> Iterator[tuple[int, Record]]:
    """Entries of a part of an archive with their numbers."""
    with open(path, "rb") as file:
        kind = stream_kind(file.read(8))
        file.seek(begin)
        source = open_stream(file) if kind else Plain(file)
        if end is not None and begin == end:
            return
        for seq, r in enumerate(read_records(source, content), first):
            yield seq, r
            if end is not None and source.tell() >= end:
                return


@dataclass
class Archive(InputPartition):
    path: str
    begin: int
    end: int | None
    first: int

    def __init__(self, path: str, begin: int = 0, end: int | None = None, first: int = 0) -> None:
        super().__init__(path)
        self.path, self.begin, self.end, self.first = path, begin, end, first


class TarReader(DataSourceReader):
    """A partition for each part of an archive. Filters on path and its prefix are applied while reading; contents are read only if asked for."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.options, self.names = options, schema.names
        self.wanted: list[tuple[str, str]] = []

    def partitions(self) -> list[Archive]:
        from .files import expand

        return [Archive(p, *part) for p in expand(self.options["path"]) for part in parts_of(p)]

    def read(self, partition: Archive) -> Iterator[tuple]:
        content = str(self.options.get("content", "true")).lower() == "true"
        for seq, r in read_part(partition.path, partition.begin, partition.end, partition.first, content):
            if all(r.path == v if how == "is" else r.path.startswith(v) for how, v in self.wanted):
                yield row_of(r, seq, partition.path)


def row_of(r: Record, seq: int, archive: str) -> tuple:
    sparse = None if r.sparse is None else [{"offset": a, "count": n} for a, n in r.sparse]
    return (r.path, r.mode, r.uid, r.gid, r.mtime, r.size, r.rdev, r.target, r.hard_link, None, None, seq, r.content, r.xattrs, sparse, archive)


SCHEMA = StructType(list(ENTRIES.fields)).add("archive", StringType())


class PushingTarReader(TarReader):
    """The same, taking filters from the plan where the session allows it."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if f.__class__ in (EqualTo, StringStartsWith) and tuple(f.attribute) == ("path",):
                self.wanted.append(("is" if isinstance(f, EqualTo) else "under", f.value))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    path: str | None


def _record(r: dict) -> Record:
    return Record(r["path"], r["mode"], r.get("uid") or 0, r.get("gid") or 0, r.get("mtime") or 0, r.get("size") or 0, r.get("rdev") or 0, r.get("target"), bool(r.get("hard_link")), None, dict(r.get("xattrs") or {}), r.get("content"))


class TarWriter(DataSourceWriter):
    """One archive from one ordered partition; the file appears when the write commits."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        self.names, self.options, self.overwrite = schema.names, options, overwrite

    def write(self, rows: Iterator) -> Written:
        import os

        rows = iter(rows)
        first = next(rows, None)
        if first is None:
            return Written(None)
        temporary = f"{self.options['path']}.part"
        kind = self.options.get("compressor")
        with open(temporary, "wb") as file:
            for i, row in enumerate((r for part in ([first], rows) for r in part)):
                # records that other tasks have formatted are only appended
                file.write(bytes(row["records"]) if "records" in self.names else pack_stream(kind, write_record(_record(row.asDict()), i)))
            file.write(pack_stream(kind, END))
            file.flush()
            os.fsync(file.fileno())
        return Written(temporary)

    def commit(self, messages: list[Written | None]) -> None:
        import os

        done = [m.path for m in messages if m and m.path]
        path = self.options["path"]
        if os.path.exists(path) and not self.overwrite:
            self.abort(messages)
            raise TarError(f"{path} exists")
        if len(done) > 1:
            raise TarError("an archive is written from one partition")
        if done:
            os.replace(done[0], path)
        else:
            with open(path, "wb") as file:
                file.write(pack_stream(self.options.get("compressor"), END))

    def abort(self, messages: list[Written | None]) -> None:
        import contextlib
        import os

        with contextlib.suppress(FileNotFoundError):
            os.remove(f"{self.options['path']}.part")


class TarDataSource(DataSource):
    """``spark.read.format("arctar").load(path)``: entries of archives, a path, a folder or a glob."""

    @classmethod
    def name(cls) -> str:
        return "arctar"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingTarReader if self.options.get("pushdown") == "true" else TarReader)(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TarWriter:
        return TarWriter(schema, dict(self.options), overwrite)


def read_tar(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    spark.dataSource.register(TarDataSource)
    return spark.read.format("arctar").option("content", str(content).lower()).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load(path)


def _batches(rows: Iterator[tuple]):
    """Rows of SCHEMA as Arrow batches, fewer rows where contents are long."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..functions.codecs import FEW_BYTES, FEW_ROWS

    arrow = to_arrow_schema(SCHEMA)
    at = SCHEMA.names.index("content")
    pack = lambda held: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[at] or b"")
        if size >= FEW_BYTES or len(held) >= FEW_ROWS:
            yield pack(held)
            held, size = [], 0
    if held:
        yield pack(held)


def parse_tars(contents: DataFrame, content: str = "content") -> DataFrame:
    """Entries of archives that are values of a binary column, such as those of the binaryFile source."""
    import io

    def rows(batches: Iterator) -> Iterator[tuple]:
        for batch in few_rows(batches):
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                if data.is_valid:
                    path = name.as_py()
                    # of a value that is itself in memory, entries are copies
                    yield from (row_of(r, i, path) for i, r in enumerate(read_records(open_stream(io.BytesIO(data.as_buffer())))))

    return contents.select("path", content).mapInArrow(lambda batches: _batches(rows(batches)), SCHEMA)


def parse_tar_files(files: DataFrame) -> DataFrame:
    """Entries of the archives at paths that workers can open. The headers of a large one are looked at by one task, its
    parts are read by all."""
    import pyarrow as pa

    from .files import local

    parts = pa.schema([("path", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("first", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for part in parts_of(local(path)):
                    yield pa.RecordBatch.from_pylist([dict(zip(parts.names, (path, *part), strict=True))], schema=parts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part in batch.to_pylist():
                for seq, r in read_part(local(part["path"]), part["begin"], part["end"], part["first"]):
                    yield row_of(r, seq, part["path"])

    tasks = files.sparkSession.sparkContext.defaultParallelism
    dealt = files.select("path").mapInArrow(cut, "path string, begin long, end long, first long").repartition(4 * tasks)
    return dealt.mapInArrow(lambda batches: _batches(rows(batches)), SCHEMA)


#: Archives of up to so many bytes are written by one task, longer ones by all.
SMALL_BYTES = 32 << 20


def write_tar(entries: DataFrame, path: str, compressor: str | None = None, overwrite: bool = True, skip_unsupported: bool = True) -> DataFrame:
    """Writes entries as one archive, in the order of seq where there is one, else of paths. Returns the rows left out.

    Headers, attributes, padding and compressed members are made by all tasks. Of a small archive one task puts them
    one after another; those of a longer one get their places from a running total and are written by all.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    from ..operators.entries import path_key
    from ..session import checkpointed
    from .files import local

    entries.sparkSession.dataSource.register(TarDataSource)
    fits = F.coalesce(F.col("hard_link"), F.lit(False)) if "hard_link" in entries.columns else F.lit(False)
    fits = fits | modes.is_type(F.col("mode"), modes.FILE, modes.LINK, modes.CHARACTER, modes.BLOCK, modes.DIRECTORY, modes.FIFO)
    left_out = entries.where(~fits).select("path", "mode")
    kept = entries.where(fits) if skip_unsupported else entries
    order = F.col("seq") if "seq" in entries.columns else path_key()
    known = [c for c in kept.columns if c in SCHEMA.names]
    # attribute records carry the number of their entry
    number = (F.col("seq") if "seq" in entries.columns else F.lit(0)).cast("long")
    rows = kept.withColumns({"place": F.struct(order, "path"), "number": number})
    schema = StructType([rows.schema["place"], *_parse_datatype_string("records binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(batches):
            fields = part.select(known).to_pylist()
            done = [pack_stream(compressor, write_record(_record(r), n)) for r, n in zip(fields, part.column("number").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("place"), pa.array(done, pa.binary())], ["place", "records"])

    formatted = checkpointed(rows.select("place", "number", *known).mapInArrow(run, schema).withColumn("row id", F.monotonically_increasing_id()))
    length = F.octet_length("records").cast("long")
    total = formatted.agg(F.coalesce(F.sum(length), F.lit(0))).first()[0]
    if total > SMALL_BYTES:
        _write_spread(formatted, total, local(path), compressor, overwrite)
        return left_out
    writer = formatted.repartition(1).sortWithinPartitions("place").select("records").write.format("arctar").mode("overwrite" if overwrite else "append").option("path", path)
    (writer.option("compressor", compressor) if compressor else writer).save()
    return left_out


def _write_spread(formatted: DataFrame, total: int, path: str, compressor: str | None, overwrite: bool) -> None:
    """Writes records (place, records, row id), each task its own; the file appears when it is whole."""
    from pyspark.sql import functions as F

    from ..operators.order import running_total
    from .files import pour

    if os.path.exists(path) and not overwrite:
        raise TarError(f"{path} exists")
    temporary = f"{path}.part"
    with open(temporary, "wb") as file:
        file.seek(total)
        file.write(pack_stream(compressor, END))
    try:
        lengths = formatted.select("place", "row id", F.octet_length("records").cast("long").alias("n"))
        places = running_total(lengths, "place", "n", "at").select("row id", "at")
        pour(formatted.select("row id", F.col("records").alias("data")).join(places, "row id"), temporary)
        os.replace(temporary, path)
    except BaseException:
        os.remove(temporary)
        raise
