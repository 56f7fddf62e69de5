"""Block and stream codecs, their options, and block transforms as Arrow-batched functions."""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType, _parse_datatype_string

from . import lz4
from .text import xxh32

# Numbers of the compressors, and the first bytes of compressed streams.
IDS = {"gzip": 1, "lzma": 2, "lzo": 3, "xz": 4, "lz4": 5, "zstd": 6}
NAMES = {v: k for k, v in IDS.items()}
MAGIC = {"gzip": b"\x1f\x8b\x08", "xz": b"\xfd7zXZ\0", "zstd": b"\x28\xb5\x2f\xfd", "bzip2": b"BZh"}
STRATEGIES = {"default": 1, "filtered": 2, "huffman": 4, "rle": 8, "fixed": 16}
ZLIB_STRATEGY = {1: zlib.Z_DEFAULT_STRATEGY, 2: zlib.Z_FILTERED, 4: zlib.Z_HUFFMAN_ONLY, 8: zlib.Z_RLE, 16: zlib.Z_FIXED}
BRANCH_FILTERS = {"x86": (1, lzma.FILTER_X86), "powerpc": (2, lzma.FILTER_POWERPC), "ia64": (4, lzma.FILTER_IA64), "arm": (8, lzma.FILTER_ARM), "armthumb": (16, lzma.FILTER_ARMTHUMB), "sparc": (32, lzma.FILTER_SPARC)}


class Unsupported(ValueError):
    """A codec that this environment doesn't have."""


class Damaged(ValueError):
    """Data that can't be unpacked."""


@dataclass(frozen=True)
class Codec:
    """A compressor with its options: level, window, strategies, dictionary, filters, extreme, and lc, lp, pb."""

    name: str
    block_size: int = 1 << 17
    options: dict = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if self.name not in IDS:
            raise ValueError(f"unknown compressor {self.name!r}")
        if self.name == "lzo":
            raise Unsupported("lzo isn't available here")
        known = {"gzip": {"level", "window", "strategies"}, "xz": {"dictionary", "filters", "extreme", "level", "lc", "lp", "pb"}, "lzma": {"dictionary", "extreme", "level", "lc", "lp", "pb"}, "zstd": {"level"}, "lz4": {"hc"}}[self.name]
        if wrong := set(self.options) - known:
            raise ValueError(f"{self.name} has no option {sorted(wrong)[0]}")
        level, (low, high) = self.get("level"), {"gzip": (1, 9), "zstd": (1, 22)}.get(self.name, (0, 9))
        if not low <= level <= high:
            raise ValueError(f"level {level} isn't between {low} and {high}")
        if not 8 <= self.get("window") <= 15:
            raise ValueError("a window has 8 to 15 bits")
        d = self.get("dictionary")
        top = 1 << (d.bit_length() - 1) if d > 0 else 0
        if d < 8192 or d not in (top, top + top // 2):
            raise ValueError("a dictionary is a power of two, or of two neighbouring ones the sum, from 8192 on")
        if self.get("lc") + self.get("lp") > 4:
            raise ValueError("lc and lp are 4 together at most")

    def get(self, option: str):
        defaults = {"level": {"gzip": 9, "zstd": 15}.get(self.name, 6), "window": 15, "strategies": (), "dictionary": max(8192, self.block_size), "filters": (), "extreme": False, "hc": False, "lc": 3, "lp": 0, "pb": 2}
        return self.options.get(option, defaults[option])

    def compress(self, data: bytes) -> bytes | None:
        """The smallest form of data that the codec's variants give; None if none is smaller than data."""
        best = min(self._variants(data), key=len)
        return best if len(best) < len(data) else None

    def _variants(self, data: bytes) -> Iterator[bytes]:
        if self.name == "gzip":
            for s in [STRATEGIES[s] for s in self.get("strategies")] or [1]:
                c = zlib.compressobj(self.get("level"), zlib.DEFLATED, self.get("window"), 8, ZLIB_STRATEGY[s])
                yield c.compress(data) + c.flush()
        elif self.name == "lz4":
            yield lz4.compress(data, self.get("hc"))
        elif self.name == "zstd":
            import zstandard

            yield zstandard.ZstdCompressor(level=self.get("level")).compress(data)
        else:
            presets = [self.get("level")] + [self.get("level") | lzma.PRESET_EXTREME] * bool(self.get("extreme"))
            for preset in presets:
                main = {"preset": preset, "dict_size": self.get("dictionary"), "lc": self.get("lc"), "lp": self.get("lp"), "pb": self.get("pb")}
                if self.name == "lzma":
                    out = lzma.compress(data, lzma.FORMAT_ALONE, filters=[main | {"id": lzma.FILTER_LZMA1}])
                    yield out[:5] + struct.pack("<Q", len(data)) + out[13:]  # with the true size
                    continue
                chains = [[]] + [[{"id": BRANCH_FILTERS[f][1]}] for f in self.get("filters")]
                for chain in chains:
                    yield lzma.compress(data, lzma.FORMAT_XZ, lzma.CHECK_CRC32, filters=[*chain, main | {"id": lzma.FILTER_LZMA2}])

    def decompress(self, data: bytes, most: int) -> bytes:
        """The unpacked block; Damaged if it is longer than most or can't be unpacked."""
        try:
            if self.name == "gzip":
                d = zlib.decompressobj()
                out = d.decompress(data, most + 1)
                complete = d.eof
            elif self.name == "lz4":
                out, complete = lz4.decompress(data, most), True
            elif self.name == "zstd":
                import zstandard

                out, complete = zstandard.ZstdDecompressor().decompress(data, max_output_size=most), True
            else:
                d = lzma.LZMADecompressor(lzma.FORMAT_XZ if self.name == "xz" else lzma.FORMAT_ALONE)
                out = d.decompress(data, most + 1)
                complete = d.eof or self.name == "lzma"
        except Exception as e:
            raise Damaged(f"{self.name}: {e}") from e
        if len(out) > most or not complete:
            raise Damaged(f"{self.name}: a block doesn't end in {most} bytes")
        return out

    def pack_options(self) -> bytes | None:
        """The options block of an image; None where all options are the defaults or there is none."""
        if self.name == "gzip":
            level, window, flags = self.get("level"), self.get("window"), sum(STRATEGIES[s] for s in self.get("strategies"))
            return None if (level, window, flags) == (9, 15, 0) else struct.pack("<IHH", level, window, flags)
        if self.name == "xz":
            d, flags = self.get("dictionary"), sum(BRANCH_FILTERS[f][0] for f in self.get("filters"))
            return None if d == max(8192, self.block_size) and not flags else struct.pack("<II", d, flags)
        if self.name == "lz4":  # always there
            return struct.pack("<II", 1, int(self.get("hc")))
        if self.name == "zstd":
            return None if self.get("level") == 15 else struct.pack("<I", self.get("level"))
        return None


def unpack_options(name: str, data: bytes) -> dict:
    """Options from an image's options block."""
    if name == "gzip":
        level, window, flags = struct.unpack("<IHH", data)
        return {"level": level, "window": window, "strategies": tuple(s for s, bit in STRATEGIES.items() if flags & bit)}
    if name == "xz":
        d, flags = struct.unpack("<II", data)
        return {"dictionary": d, "filters": tuple(f for f, (bit, _) in BRANCH_FILTERS.items() if flags & bit)}
    if name == "zstd":
        return {"level": struct.unpack("<I", data)[0]}
    if name == "lz4":
        return {"hc": bool(struct.unpack("<II", data)[1] & 1)}
    raise Unsupported(f"{name} has no options here")


def parse_options(name: str, text: str) -> dict:
    """``level=9,window=15,rle``: numbers by name (dictionary sizes with k or m), flags as bare words."""
    out: dict = {}
    flags = {"gzip": ("strategies", STRATEGIES), "xz": ("filters", BRANCH_FILTERS)}.get(name)
    for part in filter(None, text.split(",")):
        key, eq, value = part.partition("=")
        if not eq and flags and key in flags[1]:
            out[flags[0]] = (*out.get(flags[0], ()), key)
        elif not eq and key in ("extreme", "hc"):
            out[key] = True
        elif eq:
            unit = {"k": 1 << 10, "m": 1 << 20}.get(value[-1:].lower(), 1)
            digits = value[:-1] if unit > 1 else value
            if not digits.isdigit():
                raise ValueError(f"{part!r} isn't a number")
            out[{"dictsize": "dictionary"}.get(key, key)] = int(digits) * unit
        else:
            raise ValueError(f"unknown option {part!r}")
    return out


def codec(name: str, block_size: int = 1 << 17, options: str | dict = "") -> Codec:
    return Codec(name, block_size, parse_options(name, options) if isinstance(options, str) else options)


def available() -> list[str]:
    return ["gzip", "lzma", "xz", "lz4", "zstd"]


def default_codec() -> str:
    return "xz"


#: Bytes of values that are worked on at a time.
FEW_BYTES, FEW_ROWS = 1 << 20, 256


def few_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, some at a time, fewer where they are long: only so many are objects at once."""
    for batch in batches:
        step = FEW_ROWS if batch.nbytes <= FEW_BYTES else max(1, min(FEW_ROWS, batch.num_rows * FEW_BYTES // batch.nbytes))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


# --- streams ------------------------------------------------------------------------------------------------


def stream_kind(head: bytes) -> str | None:
    """Which stream compressor wrote bytes that start so; None for plain ones."""
    return next((name for name, magic in MAGIC.items() if head.startswith(magic)), None)


def pack_stream(kind: str | None, data: bytes) -> bytes:
    if kind is None:
        return data
    if kind == "gzip":
        c = zlib.compressobj(9, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    if kind not in ("xz", "bzip2"):
        raise Unsupported(f"no stream compressor {kind!r}")
    if kind == "bzip2":
        return bz2.compress(data)
    # a dictionary longer than the data finds nothing more, but its tables are made for each stream
    size = min(1 << 23, max(1 << 12, 1 << (len(data) - 1).bit_length() if data else 0))
    return lzma.compress(data, check=lzma.CHECK_CRC32, filters=[{"id": lzma.FILTER_LZMA2, "preset": lzma.PRESET_DEFAULT, "dict_size": size}])


class _Rest(io.RawIOBase):
    """A file after its head, which was read already."""

    def __init__(self, head: bytes, file) -> None:
        self.head, self.file = head, file

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        if self.head:
            n = min(len(b), len(self.head))
            b[:n], self.head = self.head[:n], self.head[n:]
            return n
        data = self.file.read(len(b))
        b[: len(data)] = data
        return len(data)


def open_stream(file):
    """A reader of what the file holds, unpacked if its first bytes say so. The file is read once, in order."""
    head = file.read(8)
    # a class made for each call would hang in a cycle with what it reads, until the collector comes by
    kind, rest = stream_kind(head), io.BufferedReader(_Rest(head, file))
    if kind == "gzip":
        import gzip

        return gzip.GzipFile(fileobj=rest)
    if kind == "xz":
        return lzma.LZMAFile(rest)
    if kind == "bzip2":
        return bz2.BZ2File(rest)
    if kind == "zstd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(rest, read_across_frames=True))
    return rest


# --- columns --------------------------------------------------------------------------------------------------


def codec_name(number: Column) -> Column:
    out = F.lit(None).cast("string")
    for n, name in NAMES.items():
        out = F.when(number == n, name).otherwise(out)
    return out


def codec_id(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for word, n in IDS.items():
        out = F.when(name == word, n).otherwise(out)
    return out


def stream_kind_column(data: Column) -> Column:
    """As stream_kind, of a binary column."""
    head, out = F.hex(F.substring(data, 1, 6)), F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        out = F.when(head.startswith(magic.hex().upper()), name).otherwise(out)
    return out


def transform_blocks(blocks: DataFrame, codec: Codec, tails_alone: bool = True) -> DataFrame:
    """blocks with sparse, checksum, compressed, stored (bytes) and stored_size.

    A block of zeros is stored as nothing; one that the codec makes smaller is compressed; others, and tails,
    which wait for their fragment block, stay as they are. One map over Arrow batches.
    """
    added_fields = _parse_datatype_string("sparse boolean, checksum long, compressed boolean, stored binary, stored_size long")
    schema = StructType(list(blocks.schema.fields) + list(added_fields.fields))
    has_tail = "tail" in blocks.columns and tails_alone

    def one(data: bytes, tail: bool) -> tuple:
        sparse = not data.strip(b"\0")
        packed = None if sparse or tail else codec.compress(data)
        stored = b"" if sparse else data if packed is None else packed
        return sparse, xxh32(data), packed is not None, stored, len(stored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(batches):
            tails = part.column("tail").to_pylist() if has_tail else [False] * part.num_rows
            columns = zip(*(one(d, t) for d, t in zip(part.column("data").to_pylist(), tails, strict=True)), strict=True)
            added = [pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.int64(), pa.bool_(), pa.binary(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, "sparse", "checksum", "compressed", "stored", "stored_size"])

    return blocks.mapInArrow(run, schema)


def restore_blocks(blocks: DataFrame, codec: Codec) -> DataFrame:
    """blocks with restored: the bytes that the codec gives back for stored, by size, sparse and compressed."""
    schema = StructType([*blocks.schema.fields, *_parse_datatype_string("restored binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            columns = (batch.column(c).to_pylist() for c in ("stored", "size", "sparse", "compressed"))
            out = [bytes(size) if sparse else codec.decompress(stored, size) if packed else stored for stored, size, sparse, packed in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "restored"])

    return blocks.mapInArrow(run, schema)


def block_function(work: Callable[[bytes], bytes]):
    """A function of binary columns from one of bytes, in Arrow batches."""
    @F.pandas_udf(BinaryType())
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else work(bytes(v)))

    return apply
