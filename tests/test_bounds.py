"""What a task reads or holds stays bounded as tables grow."""

import gc
import io
import lzma
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arcframe.functions import codecs, modes
from arcframe.operators import rules
from arcframe.sources import directory, image, tar
from arcframe.streaming import ingest


def archive(spark, path, n=400, compressor=None):
    rows = spark.range(n).select(F.concat(F.lit("d/" + "n" * 90), "id").alias("path"), F.lit(modes.FILE | 0o644).alias("mode"), F.col("id").alias("seq"), F.expr("cast(repeat(cast(id as string), 100) as binary)").alias("content"))
    tar.write_tar(rows, path, compressor)
    return rows


@pytest.mark.parametrize("compressor", [None, "gzip"])
def test_a_large_archive_is_written_by_all(spark, tmp_path, monkeypatch, compressor):
    archive(spark, str(tmp_path / "a.tar"), compressor=compressor)
    monkeypatch.setattr(tar, "SMALL_BYTES", 0)
    monkeypatch.setattr(tar.TarWriter, "write", None)
    archive(spark, str(tmp_path / "b.tar"), compressor=compressor)
    assert (tmp_path / "a.tar").read_bytes() == (tmp_path / "b.tar").read_bytes() and len(list(tmp_path.iterdir())) == 2


def test_a_large_archive_is_read_in_parts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a.tar")
    rows = archive(spark, path)
    reader = tar.TarReader(tar.SCHEMA, {"path": path})
    want = list(reader.read(reader.partitions()[0]))
    assert len(reader.partitions()) == 1 and len(want) == 400
    monkeypatch.setattr(tar, "PART_BYTES", 20_000)
    parts = reader.partitions()
    got = [list(reader.read(p)) for p in parts]
    assert len(parts) > 10 and max(map(len, got)) < 40 and [r for part in got for r in part] == want
    cut = tmp_path / "cut.tar"
    cut.write_bytes((tmp_path / "a.tar").read_bytes()[:-2000])
    with pytest.raises(tar.TarError):
        list(tar.parts_of(str(cut)))
    files = spark.createDataFrame([(path,)], "path string")
    assert tar.parse_tar_files(files).select("path", "content").exceptAll(rows.select("path", "content")).count() == 0


def test_archives_of_a_stream_are_not_values(spark, tmp_path, monkeypatch):
    """Of archives in a shared folder only names are read by Spark: a value can't be longer than 2 GB."""
    folder = tmp_path / "in"
    folder.mkdir()
    archive(spark, str(folder / "a.tar"), 20)
    monkeypatch.setattr(ingest, "parse_tars", None)
    entries = ingest.archives(spark, str(folder))
    entries.writeStream.format("memory").queryName("few").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("few").select("path", "content").distinct().count() == 20


def test_readers_of_streams_are_not_garbage():
    packed = codecs.pack_stream("xz", b"abc" * 1000)
    gc.collect()
    gc.disable()
    try:
        for _ in range(50):
            assert codecs.open_stream(io.BytesIO(packed)).read() == b"abc" * 1000
        assert not [o for o in gc.get_objects() if type(o).__name__ in ("Rest", "_Rest", "LZMAFile")]
    finally:
        gc.enable()


def test_few_rows_are_objects_at_once():
    batch = pa.record_batch({"data": pa.array([bytes(100_000)] * 100)})
    parts = list(codecs.few_rows([batch]))
    assert max(p.num_rows for p in parts) <= 10 and sum(p.num_rows for p in parts) == 100
    assert [p.num_rows for p in codecs.few_rows([pa.record_batch({"n": list(range(600))})])] == [256, 256, 88]


def test_lines_of_a_map_file_meet_in_no_single_task(spark):
    lines = [l for i in range(300) for l in ([f"# file: f{i}"] if i % 50 == 0 else []) + [f"user.k{i}=v{i}"]]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(["user.early=1", *lines], 1)], "line_no long, line string").repartition(5)
    parsed = rules.parse_attribute_map(df)
    got = {r.key: (r.path, r.error) for r in parsed.collect()}
    assert got == {"user.early": (None, "no file so far")} | {f"user.k{i}": (f"f{i // 50 * 50}", None) for i in range(300)}
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        held = rules.parse_attribute_map(df).groupBy(F.spark_partition_id()).count().collect()
        assert len(held) > 1 and sum(r["count"] for r in held) == 301
    finally:
        spark.conf.unset(key)


def test_unpacking_reads_entries_twice(spark, tmp_path, monkeypatch):
    """Entries of an image are read for what they are and for what they hold, not for each step."""
    rng = random.Random(2)
    path, log = str(tmp_path / "a.img"), tmp_path / "log"
    builder = image.ImageBuilder(open(path, "wb+"), codecs.codec("gzip", 4096))
    for i in range(20):
        builder.add({"path": f"d/f{i}", "mode": modes.FILE | 0o644, "mtime": i}, image.cut(rng.randbytes(100), builder.codec, 4096, True))
    builder.finish()
    builder.file.close()

    def seen(batches):
        for batch in batches:
            with open(log, "a") as f:
                f.write("x" * batch.num_rows)
            yield batch

    entries = image.read_image(spark, path)
    entries = entries.mapInArrow(seen, entries.schema)
    done = directory.unpack(entries, str(tmp_path / "out"), times=True)
    assert done.where("done = 'file'").count() == 20 and (tmp_path / "out/d/f3").stat().st_mtime == 3
    assert len(log.read_text()) == 2 * 22


def test_chunks_by_key(spark, monkeypatch):
    """Keys' rows aren't put together as frames."""
    import pandas as pd

    monkeypatch.setattr(pd, "concat", None)
    frames = [pd.DataFrame({"seq": [3, 1], "data": [b"c", b"a"], "last": [True, False]}), pd.DataFrame({"seq": [2], "data": [b"b"], "last": [False]})]
    assert ingest._in_order(frames, "data", "last") == [(1, b"a", False), (2, b"b", False), (3, b"c", True)]


@pytest.mark.parametrize("n", [0, 1, 4096, 4097, 300_000])
def test_streams_of_short_values_need_little_memory(n):
    data = random.Random(n).randbytes(n // 2) * 2
    packed = codecs.pack_stream("xz", data)
    assert lzma.LZMADecompressor(memlimit=max(1 << 17, 4 * n)).decompress(packed) == data
    assert len(packed) == len(lzma.compress(data, check=lzma.CHECK_CRC32))
