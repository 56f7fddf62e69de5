import struct
import zlib
from hashlib import sha256

import pytest
from hypothesis import given
from hypothesis import strategies as st

from arcframe.llm import media

from .data import ODD_TEXTS, documents


@given(st.binary(max_size=40_000))
def test_round_trip(payload):
    padded = media.pad(payload)
    stored = media.store(padded)
    brand, (track,) = media.parse(stored)
    assert brand == "isom" and track.codec == "raw " and track.duration == len(padded) // 192
    assert media.read_back(stored, track) == padded
    assert track.sync.sum() == -(-track.duration // media.SYNC_EVERY)
    keys = [i for i in range(track.duration) if i % media.SYNC_EVERY == 0]
    assert [stored[a : a + 192] for a in track.offsets[track.sync]] == [padded[192 * i : 192 * i + 192] for i in keys]


def test_query_rows(spark):
    got = {i: r for i, r in enumerate(media.media_round_trip(documents(spark, ODD_TEXTS)).orderBy("doc_id").collect())}
    for i, text in enumerate(ODD_TEXTS):
        data = (text or "").encode()
        whole = data + b" " * (192 if not data else -len(data) % 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), sha256(whole).hexdigest(), zlib.crc32(whole[-16:]))
        assert r.media_sha256 == sha256(media.store(whole)).hexdigest() and r.media_bytes == len(media.store(whole))


def test_empty_table_and_null_ids(spark):
    assert media.media_round_trip(documents(spark, [])).count() == 0
    assert media.media_round_trip(documents(spark, ["a", "a"], [None, None])).distinct().count() == 1


def test_columns(spark):
    good = media.store(media.pad(b"abc" * 5000))
    rows = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:-5])), (3, None), (4, bytearray(b"junk")), (5, bytearray())], "id long, media binary")
    got = {r.id: r for r in media.media_columns(rows).collect()}
    (track,) = got[1].tracks
    assert got[1].error is None and track.codec == "raw " and track.samples == 79
    assert [good[k.offset : k.offset + 3] for k in track.keyframes][0] == b"abc"
    assert all(got[i].error and not got[i].tracks for i in (2, 3, 4, 5))


def test_large_and_open_ended_boxes():
    payload = media.pad(b"q" * 500)
    stored = media.store(payload)
    at = stored.index(b"mdat") - 4
    open_ended = stored[:at] + struct.pack(">I", 0) + stored[at + 4 :]
    assert media.read_back(open_ended, media.parse(open_ended)[1][0]) == payload
    wide = media.box(b"ftyp", b"mp42", bytes(4)) + struct.pack(">I4sQ", 1, b"free", 20) + b"full"
    assert media.parse(wide)[0] == "mp42"


def test_fragments():
    tkhd = media.full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0), bytes(60))
    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78))), media.full(b"stsz", bytes(8)))
    mdia = media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIII", 0, 0, 1000, 0, 0)), media.full(b"hdlr", struct.pack(">I4s12x", 0, b"vide")), media.box(b"minf", stbl))
    head = media.box(b"ftyp", b"iso5", bytes(4)) + media.box(b"moov", media.box(b"trak", tkhd, mdia), media.box(b"mvex", media.full(b"trex", struct.pack(">5I", 7, 1, 40, 3, 0x10000))))

    def moof(offset):
        run = media.full(b"trun", struct.pack(">IiI", 4, offset, 0), flags=5)
        return media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 7), flags=0x20000), run))

    data = head + moof(len(moof(0)) + 8) + media.box(b"mdat", b"aaabbbcccddd")
    (track,) = media.parse(data)[1]
    assert media.read_back(data, track) == b"aaabbbcccddd" and track.duration == 160 and track.codec == "avc1"
    assert [data[a : a + n] for a, n in track.ranges(keyframes=True)] == [b"aaa"]


@pytest.mark.parametrize("cut", [1, 9, 30, 200, 500])
def test_cut_files_are_refused(cut):
    with pytest.raises(ValueError):
        media.parse(media.store(media.pad(b"z" * 1000))[:-cut])


def container(*tables):
    tkhd = media.full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0), bytes(60))
    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78))), *tables)
    mdia = media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIII", 0, 0, 1000, 0, 0)), media.full(b"hdlr", struct.pack(">I4s12x", 0, b"vide")), media.box(b"minf", stbl))
    return media.box(b"ftyp", b"iso5", bytes(4)) + media.box(b"moov", media.box(b"trak", tkhd, mdia), media.box(b"mvex", media.full(b"trex", struct.pack(">5I", 7, 1, 40, 0, 0))))


def run(*fields, flags):
    return media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 7)), media.full(b"trun", struct.pack(f">{len(fields)}I", *fields), flags=flags)))


HOSTILE = {
    "widths of five bits": container(media.full(b"stz2", struct.pack(">3xBI", 5, 3), bytes(9))),
    "a cut table of small sizes": container(media.full(b"stz2", struct.pack(">3xBI", 16, 2**32 - 1), bytes(9))),
    "2^32 samples of a constant size": container(media.full(b"stsz", struct.pack(">II", 9, 2**32 - 1))),
    "2^32 chunks in a run": container(media.full(b"stsz", struct.pack(">III", 0, 1, 1)), media.full(b"stco", struct.pack(">II", 1, 0)), media.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 1, 1, 2**32 - 1, 1, 1))),
    "a chunk at 2^64": container(media.full(b"stsz", struct.pack(">III", 0, 1, 1)), media.full(b"co64", struct.pack(">IQ", 1, 2**64 - 1)), media.full(b"stsc", struct.pack(">IIII", 1, 1, 1, 1))),
    "2^32 samples of a fragment": container() + run(2**32 - 1, flags=0),
    "many empty samples in many fragments": container() + b"".join(run(3000, flags=0) for _ in range(60)),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_tables(name):
    with pytest.raises(ValueError):
        media.parse(HOSTILE[name])


def test_hostile_tables_become_errors(spark):
    rows = spark.createDataFrame([(i, bytearray(data)) for i, data in enumerate(HOSTILE.values())], "id long, media binary")
    assert all(r.error and not r.tracks for r in media.media_columns(rows).collect())


@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 255)), min_size=1, max_size=6), st.booleans())
def test_damaged_files_are_read_or_refused(changes, fragmented):
    data = bytearray(container() + run(2, 4, 4, flags=0x200) + media.box(b"mdat", b"aaaabbbb") if fragmented else media.store(media.pad(b"z" * 3000)))
    for at, value in changes:
        data[at % min(len(data), 900)] = value
    try:
        media.parse(bytes(data))
    except ValueError:
        pass
