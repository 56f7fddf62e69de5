"""Numbers and sequential rules over a whole order, without pulling it into one task's memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window

from ..session import checkpointed


def numbered(rows: DataFrame, order: Sequence[Column], column: str, start: int = 1) -> DataFrame:
    """rows with column: their place in the order, from start on.

    Range-partitioned and sorted once; the places follow from the sizes of the partitions before, a table of
    as many rows as there are partitions. No task sees more than its own range.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("*", *[k.alias(f"key {i}") for i, k in enumerate(order)])
    keys = [F.col(f"`key {i}`") for i in range(len(order))]
    placed = checkpointed(keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()).drop(*[f"key {i}" for i in range(len(order))]))
    part, local = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    joined = placed.withColumn("part", part).join(F.broadcast(before), "part")
    return joined.withColumn(column, F.col("before") + local + start).drop("part", "before", "place")


def running_total(rows: DataFrame, order: str, value: str, column: str) -> DataFrame:
    """rows with column: the sum of value over the rows before, in the order of a column.

    Range-partitioned and sorted once, like ``numbered``: each range adds up its own rows, and starts from the
    sums of the ranges before it, a table of as many rows as there are partitions.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(rows.repartitionByRange(parts, order).withColumn("its range", F.spark_partition_id()))
    sums = placed.groupBy("its range").agg(F.sum(value).alias("all"))
    earlier = F.coalesce(F.sum("all").over(Window.orderBy("its range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("its range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = placed.join(F.broadcast(sums.select("its range", earlier.alias("ranges before"))), "its range")
    return joined.withColumn(column, (F.col("ranges before") + inside).cast("long")).drop("its range", "ranges before")


def last_so_far(rows: DataFrame, order: str, value: str, column: str) -> DataFrame:
    """rows with column: the last value up to each row that isn't null, in the order of a column.

    Range-partitioned like ``running_total``: what a range starts from is the last value of those before it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(rows.repartitionByRange(parts, order).withColumn("its range", F.spark_partition_id()))
    ends = placed.groupBy("its range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("end"))
    earlier = F.last("end", ignorenulls=True).over(Window.orderBy("its range").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy("its range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = placed.join(F.broadcast(ends.select("its range", earlier.alias("from before"))), "its range")
    return joined.withColumn(column, F.coalesce(inside, F.col("from before"))).drop("its range", "from before")


#: A key with more rows than this is hot. Rows of up to so many hot keys, some MB, are broadcast.
HOT_ROWS, BROADCAST_ROWS = 1 << 17, 100_000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined with table (keys, count and more), a row for each key with the number of its rows.

    The rows of a hot key don't meet in one task: its row of the table is broadcast, behind a check of how many
    such keys there are. With more of them, none is a large share of all rows.
    """
    hot = table.where(F.col(count) > HOT_ROWS)
    if not 0 < hot.count() <= BROADCAST_ROWS:
        return rows.join(table, keys, how)
    few = F.broadcast(hot)
    return rows.join(few, keys).unionByName(rows.join(few, keys, "left_anti").join(table.where(F.col(count) <= HOT_ROWS), keys, how))


def scan(rows: DataFrame, group: str, order: Sequence[str], step: Callable[[], Callable[[dict], list[dict]]], schema: str) -> DataFrame:
    """A sequential rule over each group's rows in order.

    ``step()`` starts a group and returns the function that takes a row, and None at its end, and returns the
    rows that come out. Groups are spread over tasks; a group streams through one, a batch in memory at a time.
    """
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, take = object(), None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if row[group] != now:
                    if take:
                        out += take(None)
                    now, take = row[group], step()
                out += take(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if take and (out := take(None)):
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.repartition(F.col(group)).sortWithinPartitions(group, *order).mapInArrow(run, struct)
