"""Dense dictionaries in the order of first use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import numbered

MOST_IDS = 1 << 16


def value_dictionary(values: DataFrame, value: str, order: str) -> DataFrame:
    """value, idx from 0 in the order of first use, and uses."""
    first = values.groupBy(value).agg(F.min(order).alias("first"), F.count("*").alias("uses"))
    return numbered(first, [F.col("first"), F.col(value)], "idx", 0).select(value, "idx", "uses")


def id_dictionary(entries: DataFrame) -> DataFrame:
    """id and idx of the owners of entries with inode numbers: in the order of inodes, a uid before a gid.

    More than 65536 different ids fail the query.
    """
    owners = entries.select("inode", F.posexplode(F.array("uid", "gid")).alias("which", "id"))
    first = owners.groupBy("id").agg(F.min(F.struct("inode", "which")).alias("first"))
    ids = numbered(first, [F.col("first")], "idx", 0).select("id", "idx")
    return ids.withColumn("idx", F.when(F.col("idx") >= MOST_IDS, F.raise_error(F.lit("too many different ids")).cast("long")).otherwise(F.col("idx")))


def _checked(ids: DataFrame) -> DataFrame:
    """A dictionary for broadcast: of 65536 rows at most, as an image's is."""
    if ids.limit(MOST_IDS + 1).count() > MOST_IDS:
        raise ValueError("too many different ids")
    return F.broadcast(ids)


def encode_ids(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """entries with uid_index and gid_index."""
    out = entries
    for c in ("uid", "gid"):
        out = out.join(_checked(ids.select(F.col("id").alias(c), F.col("idx").alias(f"{c}_index"))), c, "left")
    return out


def decode_ids(inodes: DataFrame, ids: DataFrame) -> DataFrame:
    """inodes with uid and gid for their indices; an index beyond the table gives null."""
    out = inodes
    for c in ("uid", "gid"):
        out = out.join(_checked(ids.select(F.col("idx").alias(f"{c}_index"), F.col("id").alias(c))), f"{c}_index", "left")
    return out
