"""Media columns over ISO media containers.

``parse`` walks the nested boxes of a container and decodes its sample tables; the payload of a track is
never decoded, only its codec name, duration and the byte ranges of its keyframes are kept. ``store`` is
the lossless writer that goes with it: bytes become the raw 8-bit frames of a video track.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: A stored frame is 8 by 8 pixels of three 8-bit components; every SYNC_EVERY-th is a sync sample.
FRAME, WIDTH, HEIGHT, SYNC_EVERY, FRAMES_A_CHUNK, TIMESCALE = 192, 8, 8, 30, 64, 25
#: Boxes that hold boxes.
CONTAINERS = frozenset(b"moov trak mdia minf stbl edts dinf mvex moof traf udta".split())


# --- writer -----------------------------------------------------------------------------------------


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _longs(values, form: str = ">u4") -> bytes:
    return np.asarray(values, form).tobytes()


@functools.lru_cache(maxsize=512)
def _head(frames: int) -> bytes:
    """Everything in front of the samples, for a track of so many frames."""
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    starts = np.arange(0, frames, FRAMES_A_CHUNK, dtype=np.int64) * FRAME
    wide = frames * FRAME > 0xFFFF0000
    last = frames % FRAMES_A_CHUNK
    runs = [(1, FRAMES_A_CHUNK, 1)] if frames >= FRAMES_A_CHUNK else []
    runs += [(len(starts), last, 1)] if last else []
    entry = box(b"raw ", bytes(6), struct.pack(">H16xHHIIIH32xHh", 1, WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1, 24, -1))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")

    def moov(base: int) -> bytes:
        offsets = full(b"co64", struct.pack(">I", len(starts)), _longs(starts + base, ">u8")) if wide else full(b"stco", struct.pack(">I", len(starts)), _longs(starts + base))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, 1)),
            full(b"stss", struct.pack(">I", -(-frames // SYNC_EVERY)), _longs(np.arange(1, frames + 1, SYNC_EVERY))),
            full(b"stsc", struct.pack(">I", len(runs)), _longs(runs)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            offsets,
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0))
        mdia = box(b"mdia", mdhd, full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"raw frames\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, frames, 0, 0, 0, 0), matrix, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, frames, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    header = 16 if frames * FRAME + 8 >= 1 << 32 else 8
    return ftyp + moov(len(ftyp) + len(moov(0)) + header)


def pad(payload: bytes) -> bytes:
    """payload with blanks up to a positive multiple of a frame."""
    return payload + b" " * (FRAME if not payload else -len(payload) % FRAME)


def store(payload: bytes) -> bytes:
    """An ISO media file whose only track holds payload, a positive multiple of a frame, losslessly."""
    if not payload or len(payload) % FRAME:
        raise ValueError("a payload is a positive multiple of a frame")
    return _head(len(payload) // FRAME) + box(b"mdat", payload)


# --- reader -----------------------------------------------------------------------------------------


@dataclass
class Track:
    """What is kept of a track. offsets and sizes are those of its samples, sync their sync flags."""

    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sync: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    #: Samples of fragments, joined at the end, and how many.
    added: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    listed: int = 0

    def join(self) -> None:
        if self.added:
            offsets, sizes, sync = zip(*self.added, strict=True)
            self.offsets, self.sizes, self.sync = (np.concatenate([a, *b]) for a, b in ((self.offsets, offsets), (self.sizes, sizes), (self.sync, sync)))
            self.added = []

    def ranges(self, keyframes: bool = False) -> list[tuple[int, int]]:
        """(offset, length) of the samples or of the keyframes, in decoding order, neighbours joined."""
        at, size = (self.offsets[self.sync], self.sizes[self.sync]) if keyframes else (self.offsets, self.sizes)
        if not len(at):
            return []
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + size[:-1]])
        return list(zip(at[first].tolist(), np.add.reduceat(size, first).tolist(), strict=True))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the body, end) of the boxes side by side in data[start:end]."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("a box is cut off")
            size = struct.unpack_from(">Q", data, body)[0]
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} doesn't fit")
        yield kind, body + (16 if kind == b"uuid" else 0), start + size
        start += size
    if start != end:
        raise ValueError("bytes are left after the last box")


def tree(data: memoryview, start: int, end: int) -> list[tuple[bytes, int, int, list]]:
    return [(k, a, b, tree(data, a, b) if k in CONTAINERS else []) for k, a, b in boxes(data, start, end)]


def _find(nodes: list, path: bytes) -> list:
    for kind in path.split(b"/"):
        found = [n for n in nodes if n[0] == kind]
        nodes = [c for n in found for c in n[3]]
    return found


def _table(data: memoryview, node: tuple, columns: int, kind: str = ">u4") -> np.ndarray:
    n = struct.unpack_from(">I", data, node[1] + 4)[0]
    width = np.dtype(kind).itemsize
    if node[1] + 8 + n * columns * width > node[2]:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, kind, n * columns, node[1] + 8).astype(np.int64).reshape(n, columns)


def _samples(data: memoryview, stbl: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Offsets, sizes and sync flags of the samples that a sample table lists, and their duration."""
    one = lambda kind: (_find(stbl, kind) or [None])[0]
    if (node := one(b"stsz")) is not None:
        size, n = struct.unpack_from(">II", data, node[1] + 4)
        if not size and node[1] + 12 + 4 * n > node[2]:
            raise ValueError("a sample table is cut off")
        if n * size > len(data):  # before anything of that many samples is allocated
            raise ValueError("samples lie beyond the end")
        sizes = np.full(n, size, np.int64) if size else np.frombuffer(data, ">u4", n, node[1] + 12).astype(np.int64)
    elif (node := one(b"stz2")) is not None:
        bits, n = struct.unpack_from(">3xBI", data, node[1] + 4)
        if bits not in (4, 8, 16):
            raise ValueError("sample sizes of an unknown width")
        if node[1] + 12 + -(-n * bits // 8) > node[2]:
            raise ValueError("a sample table is cut off")
        raw = np.frombuffer(data, np.uint8, -(-n * bits // 8), node[1] + 12)
        sizes = np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64) if bits == 4 else raw.view(f">u{bits // 8}").astype(np.int64)
    else:
        sizes = np.zeros(0, np.int64)
    chunks = _table(data, node, 1)[:, 0] if (node := one(b"stco")) else _table(data, node, 1, ">u8")[:, 0] if (node := one(b"co64")) else np.zeros(0, np.int64)
    if len(chunks) and not 0 <= chunks.min() <= chunks.max() <= len(data):
        raise ValueError("a chunk lies beyond the end")
    runs = _table(data, node, 3) if (node := one(b"stsc")) else np.zeros((0, 3), np.int64)
    if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks)):
        raise ValueError("the sample tables disagree")
    counts = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0], len(chunks) + 1])) if len(runs) else np.zeros(0, np.int64)
    if counts.sum() != len(sizes) or len(counts) != len(chunks):
        raise ValueError("the sample tables disagree")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(counts) - counts
    offsets = np.repeat(chunks, counts) + before - np.repeat(before[first[counts > 0]], counts[counts > 0])
    sync = np.ones(len(sizes), bool)
    if node := one(b"stss"):
        listed = _table(data, node, 1)[:, 0]
        if len(listed) and not 1 <= listed.min() <= listed.max() <= len(sizes):
            raise ValueError("a sync sample doesn't exist")
        sync[:] = False
        sync[listed - 1] = True
    times = _table(data, node, 2) if (node := one(b"stts")) else np.zeros((0, 2), np.int64)
    return offsets, sizes, sync, sum(n * each for n, each in times.tolist())  # of Python's numbers, which don't overflow


def _fragment(data: memoryview, moof: tuple, start: int, traf: tuple, tracks: dict[int, Track], defaults: dict[int, tuple]) -> None:
    """Adds the samples of one track fragment."""
    header = _find(traf[3], b"tfhd")[0]
    flags, track_id = struct.unpack_from(">II", data, header[1])
    flags &= 0xFFFFFF
    at = header[1] + 8
    base, (duration, size, sample_flags) = start, defaults.get(track_id, (0, 0, 0))
    if flags & 1:
        base = struct.unpack_from(">Q", data, at)[0]
        at += 8
    at += 4 if flags & 2 else 0
    for bit in (8, 16, 32):
        if flags & bit:
            value = struct.unpack_from(">I", data, at)[0]
            duration, size, sample_flags = (value if bit == 8 else duration), (value if bit == 16 else size), (value if bit == 32 else sample_flags)
            at += 4
    if base > len(data):
        raise ValueError("samples lie beyond the end")
    track, position = tracks.setdefault(track_id, Track(track_id)), base
    for run in _find(traf[3], b"trun"):
        flags, n = struct.unpack_from(">II", data, run[1])
        at, first = run[1] + 8, None
        if flags & 1:
            position = base + struct.unpack_from(">i", data, at)[0]
            at += 4
        if flags & 4:
            first = struct.unpack_from(">I", data, at)[0]
            at += 4
        present = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        if at + 4 * n * len(present) > run[2]:
            raise ValueError("a fragment is cut off")
        # a run of default sizes takes no bytes a sample: samples without bytes are held to be no more than the file has
        track.listed += n
        if track.listed > len(data) or (0x200 not in present and n * size > len(data)):
            raise ValueError("a fragment lists more samples than the file can hold")
        rows = np.frombuffer(data, ">u4", n * len(present), at).astype(np.int64).reshape(n, len(present))
        column = lambda bit, value: rows[:, present.index(bit)] if bit in present else np.full(n, value, np.int64)  # noqa: B023, E731
        sizes, marks = column(0x200, size), column(0x400, sample_flags).copy()
        if first is not None and n:
            marks[0] = first
        track.added.append((position + np.cumsum(sizes) - sizes, sizes, marks & 0x10000 == 0))
        track.duration += int(column(0x100, duration).sum())
        position += int(sizes.sum())


def parse(media: bytes) -> tuple[str, list[Track]]:
    """Major brand and tracks of an ISO media file. ValueError where boxes or tables don't fit together."""
    data = memoryview(media)
    try:
        top = tree(data, 0, len(data))
        brand = next((bytes(data[a : a + 4]).decode("latin-1") for k, a, _, _ in top if k == b"ftyp"), "")
        tracks: dict[int, Track] = {}
        for trak in _find(top, b"moov/trak"):
            tkhd = _find(trak[3], b"tkhd")[0]
            track = Track(struct.unpack_from(">I", data, tkhd[1] + (20 if data[tkhd[1]] else 12))[0])
            mdhd = _find(trak[3], b"mdia/mdhd")[0]
            track.timescale, track.duration = struct.unpack_from(">IQ", data, mdhd[1] + 20) if data[mdhd[1]] else struct.unpack_from(">II", data, mdhd[1] + 12)
            track.handler = bytes(data[(h := _find(trak[3], b"mdia/hdlr")[0][1]) + 8 : h + 12]).decode("latin-1")
            stbl = _find(trak[3], b"mdia/minf/stbl")[0][3]
            track.codec = next((k.decode("latin-1") for s in _find(stbl, b"stsd") for k, _, _ in boxes(data, s[1] + 8, s[2])), "")
            track.offsets, track.sizes, track.sync, lasts = _samples(data, stbl)
            # all ones stand for an unknown duration
            unknown = track.duration in (0, 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF)
            track.duration = lasts if unknown else track.duration
            tracks[track.track_id] = track
        defaults = {i: (d, s, f) for n in _find(top, b"moov/mvex/trex") for i, _, d, s, f in [struct.unpack_from(">5I", data, n[1] + 4)]}
        start = 0
        for moof in top:
            if moof[0] == b"moof":
                for traf in _find(moof[3], b"traf"):
                    _fragment(data, moof, start, traf, tracks, defaults)
            start = moof[2]
        for track in tracks.values():
            track.join()
    except (struct.error, IndexError, RecursionError, TypeError, OverflowError) as e:
        raise ValueError(f"not an ISO media file: {e}") from e
    if any(len(t.sizes) and (int((t.offsets + t.sizes).max()) > len(data) or int(t.offsets.min()) < 0) for t in tracks.values()):
        raise ValueError("samples lie beyond the end")
    if any(not 0 <= t.duration < 1 << 63 for t in tracks.values()):
        raise ValueError("a duration is out of range")
    return brand, list(tracks.values())


def read_back(media: bytes, track: Track) -> bytes:
    """The stored bytes of a track's samples, in decoding order."""
    data = memoryview(media)
    return b"".join(data[at : at + n] for at, n in track.ranges())


def feature(track: Track) -> str:
    """Codec, duration and a digest of the keyframes' byte ranges, as text."""
    keys = track.ranges(keyframes=True)
    digest = zlib.crc32(np.asarray(keys, "<i8").tobytes())
    return f"{track.codec.strip()};duration={track.duration}/{track.timescale};samples={len(track.sizes)};keyframes={int(track.sync.sum())};key_bytes={sum(n for _, n in keys)};ranges={digest:08x}"


# --- DataFrame operators ----------------------------------------------------------------------------

TRACKS = "array<struct<track_id:long, handler:string, codec:string, timescale:long, duration:long, samples:long, keyframes:array<struct<offset:long, length:long>>>>"


def media_columns(files: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """Codec, duration and keyframe byte ranges of each container: id_col, brand, tracks, error.

    One row for each input row, one map without shuffle. A null or empty value, or one whose boxes or tables
    don't fit together, gives no tracks and a text in error; error is null otherwise. Counts are held against
    the size of the file before anything is allocated for them. Other columns are left out.
    """
    kind = files.schema[id_col].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def one(media: bytes | None) -> tuple[str, list[dict], str | None]:
            if not media:
                return "", [], "no data"
            try:
                brand, tracks = parse(media)
            except ValueError as e:
                return "", [], str(e)
            return brand, [
                {"track_id": t.track_id, "handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "samples": len(t.sizes), "keyframes": [{"offset": a, "length": n} for a, n in t.ranges(keyframes=True)]} for t in tracks
            ], None

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            brands, tracks, errors = zip(*map(one, batch.column(1).to_pylist()), strict=True)
            yield {"id": batch.column(0), "brand": brands, "tracks": tracks, "error": errors}

        return each

    return map_batches(files.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media")), make, f"id {kind}, brand string, tracks {TRACKS}, error string").withColumnRenamed("id", id_col)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and media: each text (null: empty) as UTF-8, padded with blanks, in a media container."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            yield {"id": batch.column(0), "media": [store(pad(t or b"")) for t in batch.column(1).to_pylist()]}

        return each

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_batches(rows, make, f"id {kind}, media binary").withColumnRenamed("id", id_col)


def media_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as media, reads it back by its sample tables, and returns sizes, digests, feature.

    One row for each input row: id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature. A null text counts as empty, an empty one gives one frame of blanks. Null ids
    and repeated rows pass through, an empty table gives no rows, other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def one(text: bytes | None) -> tuple:
            media = store(pad(text or b""))
            _, (track,) = parse(media)
            payload = read_back(media, track)
            return len(text or b""), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), sha256(media).hexdigest(), feature(track)

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            columns = zip(*(one(t.as_py()) for t in batch.column(1)), strict=True)
            yield {"id": batch.column(0)} | dict(zip(NAMES, columns, strict=True))

        return each

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_batches(rows, make, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)


NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
