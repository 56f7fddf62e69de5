"""Archives, images, directories and streams: what is written is read back."""

import io
import os
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from arcframe.engine import Engine
from arcframe.functions import codecs, modes
from arcframe.sources import directory, image, tar
from arcframe.streaming import ingest

R, L, D = modes.FILE | 0o644, modes.LINK | 0o777, modes.DIRECTORY | 0o755
SCHEMA = "path string, mode int, uid long, gid long, mtime long, rdev long, target string, hard_link boolean, seq long, content binary, xattrs map<string,binary>"


def sample(seed=1):
    rng = random.Random(seed)
    rows = [("", D, None, b""), ("d", modes.DIRECTORY | 0o711, None, b""), ("d/empty", D, None, b""), ("lnk", L, "d/f0", b""), ("pipe", modes.FIFO | 0o600, None, b""), ("dev", modes.CHARACTER | 0o600, None, b"")]
    rows += [(f"d/f{i}", R, None, rng.choice([rng.randbytes, lambda n: b"ab" * n, bytes])(rng.randrange(15_000))) for i in range(12)]
    rows += [("copy", R, None, rows[-1][3]), ("none", R, None, b""), ("long/" + "n" * 200, R, None, b"x")]
    out = [(p, m, i % 3, 10**6 + i % 2, 1_542_905_892 + i, 0x12345 if p == "dev" else None, t, False, i, bytearray(c) if m == R else None, {"user.a": bytearray(b"v" * (i % 4 * 5 + 1))} if i % 4 == 0 and p else {}) for i, (p, m, t, c) in enumerate(rows)]
    out.append(("hard", L, 0, 0, 0, None, "d/f3", True, len(out), None, {}))
    return out


def key(r):
    return (r.path, r.mode, r.uid, r.gid, r.mtime, r.rdev or 0, r.target, bytes(r.content or b""), {k: bytes(v) for k, v in (r.xattrs or {}).items()})


@pytest.mark.parametrize("compressor", [None, "gzip", "xz", "zstd", "bzip2"])
def test_archives(spark, tmp_path, compressor):
    rows = spark.createDataFrame(sample(), SCHEMA).repartition(3)
    path = str(tmp_path / "a.tar")
    assert tar.write_tar(rows.where("path != ''"), path, compressor).count() == 0
    want = sorted((key(r) for r in rows.where("path != '' and not hard_link").collect()), key=str)
    got = tar.read_tar(spark, path)
    assert sorted((key(r) for r in got.where("not hard_link").collect()), key=str) == want
    assert [(r.path, r.target) for r in got.where("hard_link").collect()] == [("hard", "d/f3")]
    if compressor is None:
        with tarfile.open(path) as t:
            assert {m.name for m in t} == {r[0] for r in sample() if r[0]} and t.extractfile("d/f1").read() == bytes(next(r[9] for r in sample() if r[0] == "d/f1"))
    assert tar.read_tar(spark, path, content=False).where("content is not null").count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert [r.path for r in tar.read_tar(spark, path).where("path = 'pipe'").collect()] == ["pipe"]
        assert tar.read_tar(spark, path).where(F.col("path").startswith("d/f1")).count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_sockets_are_left_out_of_archives(spark, tmp_path):
    rows = spark.createDataFrame([("s", modes.SOCKET | 0o600, 0), ("f", R, 1)], "path string, mode int, seq long")
    assert [r.path for r in tar.write_tar(rows, str(tmp_path / "a.tar")).collect()] == ["s"]
    with pytest.raises(Exception, match="can't hold"):
        tar.write_tar(rows, str(tmp_path / "b.tar"), skip_unsupported=False)


@pytest.mark.parametrize("form", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_archives_of_others(form):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=form) as t:
        for name, kind, size in (("p" * 60 + "/" + "q" * 60 + "/r", tarfile.REGTYPE, 5), ("dir", tarfile.DIRTYPE, 0), ("l", tarfile.SYMTYPE, 0), ("h", tarfile.LNKTYPE, 0), ("c", tarfile.CHRTYPE, 0)):
            m = tarfile.TarInfo(name)
            m.type, m.size, m.linkname, m.mtime, m.uid, m.devmajor, m.devminor = kind, size, "t" * 90, 77 if form == tarfile.USTAR_FORMAT else 8_589_934_592, 8 if form == tarfile.USTAR_FORMAT else 2**24, 1, 3
            t.addfile(m, io.BytesIO(b"test\n"[:size]))
    got = list(tar.read_records(io.BytesIO(out.getvalue())))
    assert [r.path[-3:] for r in got] == ["q/r", "dir", "l", "h", "c"] and got[0].content == b"test\n"
    assert got[2].target == got[3].target == "t" * 90 and got[3].hard_link and got[4].rdev == 1 << 8 | 3
    assert {r.mtime for r in got} == {77 if form == tarfile.USTAR_FORMAT else 8_589_934_592}


def header(name, kind, stored, **fields):
    out = bytearray(tar._header(name, kind, 0o644, 0, 0, stored, 0))
    for at, data in fields.values():
        out[at : at + len(data)] = data
    out[148:156] = f"{tar.checksum(bytes(out)):06o}\0 ".encode()
    return bytes(out)


def test_sparse_files():
    table = b"".join(tar.write_number(n, 12) for n in (512, 512, 2048, 3))
    old = header(b"old", b"S", 515, table=(386, table), size=(483, tar.write_number(4000, 12)))
    data = tar._padded(b"A" * 512 + b"end")
    (r,) = tar.read_records(io.BytesIO(old + data + tar.END))
    assert r.sparse == [(512, 512), (2048, 3)] and r.content == bytes(512) + b"A" * 512 + bytes(1024) + b"end" + bytes(1949)

    body = tar._pax({"GNU.sparse.major": b"1", "GNU.sparse.minor": b"0", "GNU.sparse.name": b"new", "GNU.sparse.realsize": b"100"})
    content = tar._padded(b"2\n10\n3\n50\n2\n") + tar._padded(b"abcde")
    (r,) = tar.read_records(io.BytesIO(tar._header(b"p", b"x", 0o644, 0, 0, len(body), 0) + tar._padded(body) + tar._header(b"x/new", b"0", 0o644, 0, 0, 512 + 5, 0) + content + tar.END))
    assert r.path == "new" and r.content == bytes(10) + b"abc" + bytes(37) + b"de" + bytes(48)

    body = tar._pax({"GNU.sparse.size": b"20", "GNU.sparse.map": b"0,2,18,2"})
    (r,) = tar.read_records(io.BytesIO(tar._header(b"p", b"x", 0o644, 0, 0, len(body), 0) + tar._padded(body) + tar._header(b"m", b"0", 0o644, 0, 0, 4, 0) + tar._padded(b"wxyz") + tar.END))
    assert r.content == b"wx" + bytes(16) + b"yz"


def test_attributes_in_archives():
    body = tar._pax({"SCHILY.xattr.user.a": b"\0b\n", "LIBARCHIVE.xattr.user.c%20d": b"Zm9v", "unknown.key": b"x"})
    (r,) = tar.read_records(io.BytesIO(tar._header(b"p", b"x", 0o644, 0, 0, len(body), 0) + tar._padded(body) + tar._header(b"f", b"0", 0o644, 0, 0, 0, 0) + tar.END))
    assert r.xattrs == {"user.a": b"\0b\n", "user.c d": b"foo"}


@pytest.mark.parametrize("value", [0, 7, 0o7777777, 2**40, -1, -315_622_800])
def test_numbers_in_archives(value):
    for width in (8, 12):
        if -(2 ** (8 * width - 2)) <= value < 2 ** (8 * width - 2):
            assert tar.read_number(tar.write_number(value, width)) == value


def test_hostile_archives():
    for name in (b"../x", b"a/../../b"):
        with pytest.raises(tar.TarError):
            list(tar.read_records(io.BytesIO(tar._header(name, b"0", 0o644, 0, 0, 0, 0) + tar.END)))
    good = tar.write_record(tar.Record("f", content=b"x" * 600))
    with pytest.raises(tar.TarError):
        list(tar.read_records(io.BytesIO(good[:-100])))
    with pytest.raises(tar.TarError):
        list(tar.read_records(io.BytesIO(good[:100] + b"9" + good[101:])))
    (r,) = tar.read_records(io.BytesIO(tar._header(b"odd", b"V", 0o644, 0, 0, 3, 0) + tar._padded(b"abc") + good + tar.END))
    assert r.path == "f"  # unknown kinds are skipped


@pytest.mark.parametrize(("compressor", "tails"), [("gzip", True), ("zstd", False), ("xz", True), ("lz4", True)])
def test_images(spark, tmp_path, compressor, tails):
    rows = spark.createDataFrame(sample(), SCHEMA)
    path = str(tmp_path / "a.img")
    image.write_image(rows, path, compressor, 4096, exportable=True, tails=tails, mtime=1337)
    got = {r.path: r for r in image.read_image(spark, path, slices=3).collect()}
    for r in rows.where("not hard_link").collect():
        assert key(got[r.path]) == key(r)
    assert got["hard"].inode == got["d/f3"].inode and got["hard"].nlink == 2 and got["long"].mode == D
    assert got["d"].nlink == 2 + 13 and os.path.getsize(path) % 4096 == 0
    again = str(tmp_path / "b.img")
    image.write_image(rows.repartition(5), again, compressor, 4096, exportable=True, tails=tails, mtime=1337)
    assert open(path, "rb").read() == open(again, "rb").read()

    read = lambda t: image.read_image(spark, path, t)
    s = read("super").first()
    assert (s.block_size, s.block_log, s.major, s.minor, s.mtime, s.inode_count) == (4096, 12, 4, 0, 1337, read("inodes").count())
    assert [r.inode for r in read("inodes").collect()] == list(range(1, s.inode_count + 1))
    assert read("export").join(read("inodes"), ["inode", "ref"]).count() == s.inode_count == read("export").count()
    assert read("dirents").count() == len(got) - 1 and read("ids").count() == s.id_count
    assert (read("fragments").count() > 0) == tails
    blocks = read("blocks").where("not sparse")
    assert blocks.join(read("inodes"), "inode").count() == blocks.count()
    sets = read("xattrs").groupBy("xattr_index").count().count()
    assert sets == read("inodes").where("xattr_index is not null").select("xattr_index").distinct().count()


def test_ranges_of_image_files():
    out = io.BytesIO()
    builder = image.ImageBuilder(out, codecs.codec("gzip", 4096))
    data = random.Random(3).randbytes(3000) + bytes(9000) + b"z" * 5000
    builder.add({"path": "f", "mode": R}, image.cut(data, builder.codec, 4096, True))
    builder.finish()
    img = image.Image(out)
    inode = img.find("/f")
    rng = random.Random(4)
    for _ in range(60):
        at, n = rng.randrange(18_000), rng.randrange(9000)
        assert img.read(inode, at, n) == data[at : at + n]
    assert img.read(inode, len(data)) == b"" and inode.sparse_bytes == 4096
    for wrong in ("none", "f/below"):
        with pytest.raises(image.ImageError):
            img.find(wrong)


def test_large_directories():
    out = io.BytesIO()
    builder = image.ImageBuilder(out, codecs.codec("zstd", 4096))
    names = [f"d/entry-{i:05}" for i in range(2000)]
    for n in names:
        builder.add({"path": n, "mode": modes.FIFO | 0o600})
    builder.finish()
    img = image.Image(out)
    d = img.find("d")
    assert d.type == 8 and len(d.index) >= 2000 // 256 and [n.decode() for n, *_ in img.directory(d)] == [n[2:] for n in names]
    assert d.index[1][2].decode() in {n[2:] for n in names}


def test_directory_runs():
    rng = random.Random(2)
    entries = sorted((f"n{rng.randrange(10**6)}".encode(), rng.randrange(1, 100_000), rng.randrange(8) << 16, 2) for _ in range(900))
    runs = list(image.directory_runs(entries, 100))
    assert [e for r in runs for e in r] == entries
    for r in runs:
        assert len(r) <= 256 and len({e[2] >> 16 for e in r}) == 1 and all(abs(e[1] - r[0][1]) <= 32767 for e in r)


def damaged(change):
    out = io.BytesIO()
    builder = image.ImageBuilder(out, codecs.codec("gzip", 4096))
    builder.add({"path": "f", "mode": R}, image.cut(b"abc", builder.codec, 4096, True))
    builder.finish()
    data = bytearray(out.getvalue())
    change(data)
    return io.BytesIO(bytes(data))


@pytest.mark.parametrize(("at", "value", "code"), [(0, b"xxxx", -9), (28, b"\x05\0", -10), (12, b"\0\x30\0\0", -11), (22, b"\x0d\0", -5), (20, b"\x09\0", -6), (26, b"\0\0", -5)])
def test_damaged_super_blocks(at, value, code):
    def change(data):
        data[at : at + len(value)] = value

    with pytest.raises(image.ImageError) as e:
        image.Image(damaged(change))
    assert e.value.code == code


def test_hostile_images():
    out = io.BytesIO()
    builder = image.ImageBuilder(out, codecs.codec("gzip", 4096))
    builder.add({"path": "..", "mode": R}, image.Packed([]))
    builder.finish()
    with pytest.raises(image.ImageError):
        list(image.Image(out).walk())
    for rows, wrong in (([("a", R), ("a/b", R)], "no directory"), ([("h", L)], "nothing")):
        builder = image.ImageBuilder(io.BytesIO(), codecs.codec("gzip", 4096))
        for path, mode in rows:
            builder.add({"path": path, "mode": mode, "hard_link": path == "h", "target": "none"}, image.Packed([]))
        with pytest.raises(image.ImageError, match=wrong):
            builder.finish()


def test_directories_and_unpacking(spark, tmp_path):
    rows = spark.createDataFrame(sample(), SCHEMA).where("path != 'dev'")
    top = str(tmp_path / "out")
    done = {r.path: r.done for r in directory.unpack(rows, top, times=True, permissions=True).collect()}
    assert done["hard"] == "hard link" and done["d"] == "directory" and len(done) == rows.count()
    engine = Engine(spark)
    back = {r.path: r for r in engine.directory(top).collect()}
    for r in rows.where("path != ''").collect():
        b = back[r.path]
        if r.hard_link:
            continue
        assert bytes(b.content or b"") == bytes(r.content or b"") and b.mtime == r.mtime and (b.mode == r.mode or r.mode == L)
    assert [(r.path, r.target) for r in back.values() if r.hard_link] == [("hard", "d/f3")]
    with pytest.raises(directory.UnsafeName):
        directory.unpack(spark.createDataFrame([("../x", R)], "path string, mode int"), top)
    with pytest.raises(directory.UnsafeName):
        directory.unpack(spark.createDataFrame([("x", R), ("x", R)], "path string, mode int"), top)
    os.symlink("/tmp", os.path.join(top, "out-link"))
    with pytest.raises(Exception, match="UnsafeName"):
        directory.unpack(spark.createDataFrame([("out-link/x", R)], "path string, mode int"), top).collect()
    ticks = spark.createDataFrame([(116444736000000000 + 15_000_000,)], "t long").select(directory.filetime_to_seconds(F.col("t"))).first()[0]
    assert ticks == 1


def test_engine(spark, tmp_path):
    engine = Engine(spark)
    src = tmp_path / "src"
    (src / "lib").mkdir(parents=True)
    (src / "lib" / "a.so").write_bytes(b"so" * 5000)
    (src / "input").write_bytes(b"hello")
    listing = tmp_path / "list.txt"
    listing.write_text('dir /bin 0755 0 0\nfile "/bin/my tool" 0755 1 2 input\nslink /sh 0777 0 0 bin/tool\nglob /usr 0644 7 8 -type f -name *.so lib\n')
    (tmp_path / "x.txt").write_text("# file: bin\nuser.note=0x6869\n")
    (tmp_path / "sort.txt").write_text("-5 usr/a.so\n")
    (tmp_path / "labels.txt").write_text("/bin/.* -- bin_t\n")
    rows = engine.listing(str(listing), str(src), 5)
    path = str(tmp_path / "e.img")
    engine.pack(rows, path, sort_file=str(tmp_path / "sort.txt"), xattr_file=str(tmp_path / "x.txt"), label_file=str(tmp_path / "labels.txt"), compressor="gzip", block_size=4096)
    img = engine.image(path)
    assert sorted(r.path for r in img.collect()) == ["", "bin", "bin/my tool", "sh", "usr", "usr/a.so"]
    assert engine.cat(img, "bin/my tool") == b"hello" and engine.cat(img, "usr/a.so") == b"so" * 5000
    assert [r.line for r in engine.xattrs(img, "bin").collect()] == ["user.note=hi"]
    assert [r.key for r in engine.xattrs(img, "bin/my tool").collect()] == ["security.selinux"]
    assert [r.line for r in engine.ls(img, "bin").collect()] == ["-rwxr-xr-x 1/2 5 my tool"]
    assert [r.path for r in engine.find(img, name="*.so", types=["f"]).collect()] == ["usr/a.so"]
    assert engine.stat(img, "usr/a.so").first().size == 10_000
    assert 'file "bin/my tool" 0755 1 2' in [r.line for r in engine.describe(img).collect()]

    archive, second = str(tmp_path / "e.tar"), str(tmp_path / "f.img")
    engine.to_tar(img, archive)
    engine.from_tar(archive, second, compressor="zstd", block_size=8192)
    assert engine.diff_images(path, second).count() == 0
    assert {r.field for r in engine.diff_super(path, second).collect()} >= {"block_size", "compressor"}
    engine.from_tar(archive, second, root="usr", exclude=["*tool"])
    assert sorted(r.path for r in engine.image(second).collect()) == ["", "a.so"]

    b = engine.browse(path)
    b.cd("bin")
    assert b.pwd() == "/bin" and b.cat("my tool") == b"hello" and b.ls("..").count() == 3
    with pytest.raises(NotADirectoryError):
        b.cd("my tool")
    bad = tmp_path / "bad.txt"
    bad.write_text("dir a 0755 0\n")
    with pytest.raises(ValueError, match="bad.txt:1"):
        engine.listing(str(bad))


def test_streams(spark, tmp_path):
    incoming, out = tmp_path / "in", tmp_path / "out"
    incoming.mkdir()
    for n in range(3):
        (incoming / f"{n}.tar").write_bytes(b"".join(tar.write_record(tar.Record(f"f{n}-{i}", content=b"x" * i)) for i in range(4)) + tar.END)
    ingest.ingest(ingest.archives(spark, str(incoming), files_at_a_time=2), str(out), str(tmp_path / "c1")).awaitTermination()
    got = spark.read.parquet(str(out))
    assert got.count() == 12 and got.select("batch").distinct().count() == 2

    chunks = tmp_path / "chunks"
    parts = [("a", 0, b"abc", False), ("a", 1, b"defgh", False), ("a", 2, b"i", True), ("b", 0, b"12345678", True), ("c", 0, b"abcd", True)]
    for n, p in enumerate(parts):
        spark.createDataFrame([(p[0], p[1], bytearray(p[2]), p[3])], "path string, seq long, data binary, last boolean").coalesce(1).write.mode("append").parquet(str(chunks))
    stream = spark.readStream.schema("path string, seq long, data binary, last boolean").option("maxFilesPerTrigger", 1).parquet(str(chunks))
    q = ingest.cut_stream(stream, 4).writeStream.format("parquet").option("path", str(tmp_path / "cut")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    cut = {(r.path, r.idx): bytes(r.data) for r in spark.read.parquet(str(tmp_path / "cut")).collect()}
    assert cut == {("a", 0): b"abcd", ("a", 1): b"efgh", ("a", 2): b"i", ("b", 0): b"1234", ("b", 1): b"5678", ("c", 0): b"abcd"}
    seen = spark.readStream.schema("path string, idx long, data binary, last boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "cut"))
    q = ingest.first_seen(seen).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 5
    spliced = ingest.splice(spark.createDataFrame([(p, s, bytearray(d)) for p, s, d, _ in parts], "path string, seq long, data binary"), 5)
    assert {(r.path, r.seq): bytes(r.data) for r in spliced.collect()} == {("a", 0): b"abc", ("a", 1): b"de", ("b", 0): b"12345", ("c", 0): b"abcd"}


def test_tables_of_an_image_make_its_entries(spark, tmp_path):
    from arcframe.operators import inodes

    path = str(tmp_path / "t.img")
    image.write_image(spark.createDataFrame(sample(), SCHEMA), path, "gzip", 4096, exportable=True)
    read = lambda t: image.read_image(spark, path, t)
    table, root = read("inodes"), read("inodes").agg(F.max("inode")).first()[0]
    want = {(r.path, r.inode, r.mode, r.uid, r.gid, r.nlink) for r in image.read_image(spark, path).collect()}
    got = inodes.entries(table, read("dirents"), read("ids"), root)
    assert {(r.path, r.inode, r.mode, r.uid, r.gid, r.nlink) for r in got.collect()} == want
    assert table.where(inodes.needs_extended() != (F.col("type") > 7)).count() == 0
    assert table.where(inodes.block_count(4096) != F.coalesce(F.size("block_sizes"), F.lit(0))).count() == 0
    blocks = inodes.block_table(table).where("stored > 0")
    assert blocks.join(read("blocks"), ["inode", "idx", "at", "stored", "compressed", "sparse"]).count() == blocks.count() > 0
    flags = inodes.fragment_flags(read("fragments")).first()
    assert flags.fragments and flags.uncompressed == (read("fragments").where("compressed").count() == 0)
    asked = inodes.resolve_numbers(table, spark.createDataFrame([(1,), (10**6,)], "inode long"))
    assert {r.inode: r.ref is None for r in asked.collect()} == {1: False, 10**6: True}
    runs = inodes.directory_runs(read("dirents"))
    assert runs.agg(F.sum("entries")).first()[0] == read("dirents").count()
    assert inodes.export_table(table).exceptAll(read("export").select("inode", "ref")).count() == 0


def test_first_seen_forgets_what_is_old(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    for n, (minutes, data) in enumerate([(0, b"a"), (1, b"a"), (500, b"b"), (501, b"c"), (502, b"a")]):
        spark.createDataFrame([(start + timedelta(minutes=minutes), bytearray(data))], "time timestamp, data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("*.parquet"):
            if f.stat().st_mtime > 1_600_000_000:
                os.utime(f, (1_500_000_000 + n, 1_500_000_000 + n))
    stream = spark.readStream.schema("time timestamp, data binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = ingest.first_seen(stream, "time", "10 minutes")
    seen.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(bytes(r.data) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [b"a", b"a", b"b", b"c"]


@pytest.mark.parametrize("parts", [1, 3, 256])
def test_a_scan_is_dealt_over_parts(spark, tmp_path, monkeypatch, parts):
    """A tree under one folder: every entry once, in the order of one walk, whatever the number of partitions."""
    monkeypatch.setattr(directory, "PARTS", parts)
    monkeypatch.setattr(directory, "LEAST", 2)
    for i in range(4):
        for j in range(5):
            (tmp_path / "top" / f"d{i}" / f"e{j}").mkdir(parents=True)
            (tmp_path / "top" / f"d{i}" / f"e{j}" / "f").write_text("x" * j)
    (tmp_path / "top" / "link").symlink_to("d0")
    want = []
    for folder, folders, files in os.walk(tmp_path):
        want += [os.path.relpath(os.path.join(folder, n), tmp_path) for n in (*folders, *files)]
    reader = directory.DirectoryReader(directory.SCHEMA, {"path": str(tmp_path)})
    assert len(reader.partitions()) <= parts
    walked = [row for part in reader.partitions() for row in reader.read(part)]
    assert [r[0] for r in walked] == sorted(want, key=lambda p: p.split("/")) and [r[11] for r in walked] == sorted(r[11] for r in walked)
    assert directory.scan_directory(spark, str(tmp_path)).count() == len(want)
