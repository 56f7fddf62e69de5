"""Paths on the file system that workers read."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import DataFrame


def local(path: str) -> str:
    return path.removeprefix("file://").replace("file:", "", 1) if path.startswith("file:") else path


def expand(path: str) -> list[str]:
    """The files that a path, a folder or a glob stands for, in order."""
    path = local(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, n) for n in os.listdir(path) if not n.startswith((".", "_")) and os.path.isfile(os.path.join(path, n)))
    return sorted(glob.glob(path)) or [path]


def pour(pieces: DataFrame, path: str) -> None:
    """Writes pieces (at, data) of a file that is there, each task its own. A task that is run again writes the same."""

    import pyarrow as pa
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(path, "r+b") as file:
            for batch in batches:
                at, data = batch.column("at"), batch.column("data")
                for i in range(batch.num_rows):
                    file.seek(at[i].as_py())
                    n += file.write(data[i].as_buffer())
            file.flush()
            os.fsync(file.fileno())
        yield pa.RecordBatch.from_pydict({"n": [n]}, schema=pa.schema([("n", pa.int64())]))

    pieces.select("at", "data").mapInArrow(run, "n long").agg(F.sum("n")).collect()
