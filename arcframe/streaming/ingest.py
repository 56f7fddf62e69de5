"""Archives that arrive in a folder, chunks that become blocks, and blocks seen before."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tar import parse_tar_files, parse_tars


def archives(spark: SparkSession, folder: str, pattern: str = "*.tar*", files_at_a_time: int = 16) -> DataFrame:
    """A stream of the entries of archives as they arrive in a folder; files_at_a_time holds it back.

    In a folder of a file system that workers share, only names go through Spark, and large archives are read by all tasks.
    An archive in another store is a value, 2 GB at most.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_a_time).load(folder)
    return parse_tar_files(files) if _opened_by_workers(spark, folder) else parse_tars(files)


def _opened_by_workers(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def ingest(entries: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes a stream of entries to Parquet, a folder for each batch: a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _in_order(frames: Iterable[pd.DataFrame], *columns: str) -> list[tuple]:
    """(seq, columns) of a key's rows by seq. Most keys have few rows: their frames are taken apart, not put together."""
    rows = [row for f in frames for row in zip(f["seq"].tolist(), *(f[c].tolist() for c in columns), strict=True)]
    return sorted(rows, key=lambda r: r[0])


def cut_stream(chunks: DataFrame, block_size: int) -> DataFrame:
    """Blocks from a stream of chunks (path, seq, data, last): path, idx, data, last.

    What doesn't fill a block is kept as state until more of the file arrives; the chunk marked last ends it.
    """

    def cut(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, idx = state.get if state.exists else (b"", 0)
        parts = _in_order(frames, "data", "last")
        data, out = bytes(rest) + b"".join(d for _, d, _ in parts), []
        ended = any(last for *_, last in parts)
        while len(data) >= block_size:
            out.append((key[0], idx, data[:block_size], ended and len(data) == block_size))
            data, idx = data[block_size:], idx + 1
        if ended:
            if data:
                out.append((key[0], idx, data, True))
            state.remove()
        else:
            state.update((data, idx))
        yield pd.DataFrame(out, columns=["path", "idx", "data", "last"])

    return chunks.groupBy("path").applyInPandasWithState(cut, "path string, idx long, data binary, last boolean", "rest binary, idx long", "append", GroupStateTimeout.NoTimeout)


def first_seen(blocks: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Blocks of a stream whose bytes weren't seen before.

    For the life of the query, its state growing with the blocks that differ; or, where a column of event times is
    named, within the delay that its watermark allows, so that digests older than that are forgotten.
    """
    rows = blocks.withColumn("digest", F.sha2("data", 256))
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"]) if time else rows.dropDuplicates(["digest"])


def splice(chunks: DataFrame, limit: int) -> DataFrame:
    """The first limit bytes of each path's chunks (path, seq, data), cut where they end.

    On a stream, the chunks of a path must arrive in the order of seq, and what they have given so far is kept as state.
    """
    if chunks.isStreaming:

        def take(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            given, out = state.get[0] if state.exists else 0, []
            for seq, data in _in_order(frames, "data"):
                if given < limit:
                    out.append((key[0], seq, bytes(data)[: limit - given]))
                    given += len(data)
            state.update((given,))
            yield pd.DataFrame(out, columns=["path", "seq", "data"])

        return chunks.select("path", "seq", "data").groupBy("path").applyInPandasWithState(take, "path string, seq long, data binary", "given long", "append", GroupStateTimeout.NoTimeout)
    from pyspark.sql.window import Window

    before = F.coalesce(F.sum(F.octet_length("data")).over(Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chunks.withColumn("before", before).where(F.col("before") < limit)
    return rows.withColumn("data", F.expr(f"substring(data, 1, cast({limit} - before as int))")).drop("before")
