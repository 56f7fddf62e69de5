"""Extended attributes: sets without duplicates, values out of line, assignment by map file and by label rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .order import join_counted, numbered

#: Rules of a file that are tried on every entry.
MOST_RULES = 100_000


def broadcast_rules(rules: DataFrame) -> DataFrame:
    """A table of rules for broadcast, after a look at how many there are."""
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"there are more than {MOST_RULES} rules")
    return F.broadcast(rules)


#: Values longer than this are stored once and referred to.
INLINE = 8


def last_wins(pairs: DataFrame) -> DataFrame:
    """owner, key, value: for each key of an owner the value set last by seq."""
    return pairs.groupBy("owner", "key").agg(F.max_by("value", "seq").alias("value"))


def attribute_sets(pairs: DataFrame) -> DataFrame:
    """owner and xattr_index, from rows owner, seq, key, value.

    Equal sets share an index, from 0 in the order of the first seq that uses the set. An owner without pairs
    has no row. The set of an owner is its pairs by key; that order doesn't change which sets are equal.
    """
    first = pairs.groupBy("owner").agg(F.min("seq").alias("first"))
    whole = last_wins(pairs).groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("pairs"))
    owners = whole.join(first, "owner").select("owner", "first", F.sha2(F.to_json("pairs"), 256).alias("set"))
    ids = numbered(owners.groupBy("set").agg(F.min("first").alias("first")), [F.col("first")], "xattr_index", 0)
    return owners.join(ids.select("set", "xattr_index"), "set").select("owner", "xattr_index")


def stored_pairs(pairs: DataFrame) -> DataFrame:
    """xattr_index, key, value, out_of_line: each different set once.

    A value longer than INLINE bytes that an earlier stored pair has (by set, then key) is out of line. The first
    pair of a value is a minimum, combined before the shuffle, so that a value that most sets have doesn't meet
    in one task.
    """
    sets = attribute_sets(pairs)
    one = sets.groupBy("xattr_index").agg(F.min("owner").alias("owner"))
    rows = last_wins(pairs).join(one, "owner").select("xattr_index", "key", "value")
    firsts = rows.where(F.octet_length("value") > INLINE).groupBy("value").agg(F.min(F.struct("xattr_index", "key")).alias("first"), F.count("*").alias("uses")).where("uses > 1")
    later = F.coalesce(F.struct("xattr_index", "key") != F.col("first"), F.lit(False))
    return join_counted(rows, firsts, ["value"], "uses", "left").select("xattr_index", "key", "value", later.alias("out_of_line"))


def apply_map(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """path, key, value: the attributes that a map file's rules (path, block, seq, key, value) give to entries.

    Paths are equal once canonical. All blocks of a path apply in order; the last setting of a key wins.
    """
    from ..functions import paths

    wanted = rules.select(paths.canonicalize(F.col("path")).alias("path"), F.struct("block", "seq").alias("at"), "key", "value")
    hit = wanted.join(entries.select("path").distinct(), "path", "left_semi")
    return hit.groupBy("path", "key").agg(F.max_by("value", "at").alias("value"))


def collect(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """entries with xattrs, a map of the pairs of their xattr_index; empty without one."""
    maps = sets.groupBy("xattr_index").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("xattrs"))
    empty = F.create_map().cast(maps.schema["xattrs"].dataType)
    return entries.join(maps, "xattr_index", "left").withColumn("xattrs", F.coalesce("xattrs", empty))


def scanned(pairs: DataFrame) -> DataFrame:
    """Pairs as they are taken from a file system: those with an empty value are left out."""
    return pairs.where(F.octet_length("value") > 0)


def with_prefix_ids(pairs: DataFrame) -> DataFrame:
    """pairs with prefix and suffix; rows whose key has none of the known prefixes have null there."""
    return pairs.withColumns({"prefix": text.prefix_id(F.col("key")), "suffix": text.key_suffix(F.col("key"))})


def dump(pairs: DataFrame) -> DataFrame:
    """path and line, ``key=value``, the value in hex unless it is printable."""
    return pairs.select("path", "key", F.concat_ws("=", "key", text.shown_value_column("value")).alias("line"))


def labels(entries: DataFrame, rules: DataFrame, default: str | None = None) -> DataFrame:
    """path and label, from rules (rule, pattern, type, label) whose pattern matches the whole path with a leading slash.

    type is a mode's type bits or null for any. Of several matches the last rule counts; without one it is default.
    The rules are a file's; MOST_RULES of them at most are broadcast, more are refused.
    """
    full = F.concat(F.lit("/"), F.col("path"))
    fits = F.rlike(full, F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$"))) & (F.col("type").isNull() | (F.col("mode").bitwiseAND(0o170000) == F.col("type")))
    hit = entries.select("path", "mode").join(broadcast_rules(rules), fits, "left")
    return hit.groupBy("path").agg(F.coalesce(F.max_by("label", "rule"), F.lit(default)).alias("label"))
