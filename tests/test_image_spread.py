"""Images put together by all tasks are those that one task makes."""

import os
import random

import pytest
from pyspark.sql import functions as F
from tests.test_sources import SCHEMA, D, L, R, key, sample

from arcframe.functions import codecs, modes
from arcframe.sources import image


@pytest.fixture
def spread(monkeypatch):
    monkeypatch.setattr(image, "SMALL_ENTRIES", 0)
    monkeypatch.setattr(image, "SMALL_BYTES", -1)


def whole(spark, path):
    # the bytes of a directory's listing follow from how its runs fall
    return {r.path: (*key(r), r.inode, r.nlink, r.size if r.mode & modes.TYPE_MASK != modes.DIRECTORY else 0) for r in image.read_image(spark, path).collect()}


@pytest.mark.parametrize(("compressor", "tails"), [("gzip", True), ("zstd", False)])
def test_the_same_as_by_one_task(spark, tmp_path, spread, monkeypatch, compressor, tails):
    rng = random.Random(5)
    rows = sample()
    rows += [(f"many/{'x' * (i % 90)}{i:05}", R if i % 3 else modes.FIFO | 0o600, i % 5, 3, i, None, None, False, 100 + i, bytearray(rng.randbytes(i % 50)) if i % 3 else None, {}) for i in range(1500)]
    rows += [(f"many/link{i}", L, 0, 0, 0, None, f"many/{'x' * (i % 90)}{i:05}", True, 9000 + i, None, {}) for i in range(1, 4)]
    rows = spark.createDataFrame(rows, SCHEMA).where("path not in ('', 'd')")
    paths = [str(tmp_path / n) for n in ("a.img", "b.img", "c.img")]
    image.write_image(rows.repartition(3), paths[0], compressor, 4096, exportable=True, tails=tails, mtime=7)
    if compressor == "gzip":
        image.write_image(rows.repartition(5), paths[1], compressor, 4096, exportable=True, tails=tails, mtime=7)
        assert open(paths[0], "rb").read() == open(paths[1], "rb").read() and os.path.getsize(paths[0]) % 4096 == 0
    monkeypatch.setattr(image, "SMALL_ENTRIES", 10**6)
    monkeypatch.setattr(image, "SMALL_BYTES", 10**9)
    image.write_image(rows, paths[2], compressor, 4096, exportable=True, tails=tails, mtime=7)
    assert whole(spark, paths[0]) == whole(spark, paths[2])
    assert abs(os.path.getsize(paths[0]) - os.path.getsize(paths[2])) <= 4096 * 4
    read = lambda t, p=paths[0]: image.read_image(spark, p, t)
    assert [r.inode for r in read("inodes").collect()] == list(range(1, read("super").first().inode_count + 1))
    assert read("export").join(read("inodes"), ["inode", "ref"]).count() == read("export").count() == read("inodes").count()
    for table, columns in (("ids", ["idx", "id"]), ("xattrs", ["xattr_index", "key", "value"]), ("blocks", ["inode", "idx", "stored", "compressed", "sparse", "data"])):
        columns = [c for c in columns if c in read(table).columns]
        assert sorted(map(str, read(table).select(columns).collect())) == sorted(map(str, read(table, paths[2]).select(columns).collect()))
    with open(paths[0], "rb") as file:
        d = image.Image(file).find("many")
        names = [n for n, *_ in image.Image(file).directory(d)]
        assert d.index[1][2] == names[256] and len(d.index) == 6 and names == sorted(names)
    assert not list(tmp_path.glob("*.part"))


def test_no_task_gets_all_blocks(spark, tmp_path, spread, monkeypatch):
    """The writer of one partition is not used."""
    monkeypatch.setattr(image.ImageWriter, "write", None)
    image.write_image(spark.range(300).select(F.concat(F.lit("a/"), "id").alias("path"), F.lit(R).alias("mode"), F.col("id").cast("string").cast("binary").alias("content")), str(tmp_path / "x.img"))
    assert image.read_image(spark, str(tmp_path / "x.img")).where("substring(path, 3) = cast(content as string)").count() == 300


@pytest.mark.parametrize(("rows", "code"), [([("a", R, None), ("a", R, None)], -16), ([("a", R, None), ("a/b", R, None)], -12), ([("h", L, "none")], -13), ([("h", L, "h")], -14), ([("h", L, "d"), ("d", D, None)], -16)])
def test_what_is_refused(spark, tmp_path, spread, rows, code):
    df = spark.createDataFrame([(p, m, t, t is not None) for p, m, t in rows], "path string, mode int, target string, hard_link boolean")
    with pytest.raises(image.ImageError) as e:
        image.write_image(df, str(tmp_path / "x.img"))
    assert e.value.code == code and not os.listdir(tmp_path)


def test_slices_of_a_large_image(spark, tmp_path, monkeypatch):
    """Every entry comes from one slice, in the order of the walk, and so do inodes; none walks the whole tree."""
    builder = image.ImageBuilder(open(tmp_path / "x.img", "wb+"), codecs.codec("gzip", 4096))
    names = [f"{a}/{b}/{c:03}" for a in "xyz" for b in ("p", "q") for c in range(700)] + [f"deep/{i:04}/{j}" for i in range(400) for j in "ab"] + [f"top{i:05}" for i in range(3000)]
    for n in names:
        builder.add({"path": n, "mode": R}, image.cut(n.encode(), builder.codec, 4096, True))
    builder.add({"path": "alink", "mode": L, "target": "t" * 70})
    builder.finish()
    builder.file.close()
    path = str(tmp_path / "x.img")
    table = lambda t="entries", **o: image.read_image(spark, path, t, **o)
    want = [r.path for r in table().orderBy("seq").collect()]
    inodes = [str(r) for r in table("inodes").collect()]
    dirents, blocks = (sorted(map(str, table(t).collect())) for t in ("dirents", "blocks"))
    assert len(want) == len(set(want)) and set(names) < set(want)
    for limit in (1000, 100):
        monkeypatch.setattr(image, "SLICE_INODES", limit)
        reader = image.ImageReader(image.ENTRIES, {"path": path})
        slices = reader.partitions()
        got = [list(reader.read(s)) for s in slices]
        assert len(slices) > 7 and max(map(len, got)) < len(want) // 2
        assert [r[0] for r in sorted((r for part in got for r in part), key=lambda r: r[11])] == want
        assert all(bytes(r[12] or b"").decode() in ("", r[0]) for part in got for r in part)
        for name, rows in (("inodes", sorted(inodes)), ("dirents", dirents), ("blocks", blocks)):
            reader = image.ImageReader(image.TABLES[name], {"path": path, "table": name})
            parts = reader.partitions()
            names_of = image.TABLES[name].names
            assert len(parts) > 7 and sum(len(list(reader.read(p))) for p in parts) == len(rows), names_of
            if name == "inodes":
                assert [r[1] for p in parts for r in reader.read(p)] == list(range(1, len(rows) + 1))
    assert [len(list(image.ImageReader(image.ENTRIES, {"path": path, "slices": "3"}).read(s))) for s in image.ImageReader(image.ENTRIES, {"path": path, "slices": "3"}).partitions()].count(0) == 0
