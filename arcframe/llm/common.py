"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import checkpointed

__all__ = ["SMALL", "WORD", "checkpointed", "chunks", "map_batches", "release", "shuffle_partitions", "table"]

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes up to which a table in few files is dealt over all tasks: one split's worth by Spark's defaults.
SMALL = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. A small one in fewer files than there are tasks would be read by few of them: it is dealt over all."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(tasks) if size <= SMALL and len(df.inputFiles()) < tasks else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Gives freed memory back to the system. Workers live on after a task, and so would what it took at its peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # elsewhere than with the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str) -> DataFrame:
    """mapInArrow with the set-up apart: ``make()`` runs once a task and returns the function of a batch.

    That function yields dicts of column values; each becomes one output batch.
    """
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                for columns in each(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)
        del each
        release()

    return df.mapInArrow(run, struct)


def chunks(texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts in lists of about ``limit`` characters, so that working lists stay small."""
    chunk, size = [], 0
    for text in texts:
        chunk.append(text)
        size += len(text)
        if size >= limit:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk
