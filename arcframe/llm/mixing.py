"""Mixes sources to target weights by fitting subset sums.

Documents are counted by source and exact length. Each source's target is met by whole passes over it
and, for what remains, by a choice of lengths: an equal share of every length first, then a bounded
knapsack over the lengths that are left. Which documents of a length are taken is a seeded order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WORD, checkpointed
from .ranks import rank_in_slice, slice_starts, with_slice

#: Words of a budget up to which the knapsack is solved exactly; what lies above is spread over the lengths.
EXACT = 1 << 16
#: Remainders of so many groups of equal rows, some MB, are broadcast.
BROADCAST_ROWS = 100_000


def fit_budget(lengths: Sequence[int], counts: Sequence[int], budget: int, seed: int = 0) -> list[int]:
    """How many documents of each length to take, at most counts, so that the sum comes close to budget.

    The sum never exceeds budget. An equal share of each length comes first. While more than EXACT words are
    left, what rounding takes from the shares goes to lengths near by, and then one more of each length is
    taken in a seeded order; the rest is a bounded knapsack by dynamic programming over the sums up to EXACT
    words, which looks at the lengths in that order, too.
    """
    size = np.asarray(lengths, np.int64)
    have = np.asarray(counts, np.int64)
    total = int((size * have).sum())
    if budget >= total:
        return have.tolist()
    if budget <= 0 or not total:
        return [0] * len(size)
    take = np.array([c * budget // total for c in have.tolist()], np.int64)
    left = budget - int((take * size).sum())
    rng = np.random.default_rng([seed, len(size)])
    spread = rng.permutation(len(size))  # no length is preferred
    # what the shares lose by rounding is carried on to the next lengths, neighbours in a seeded order
    near = np.lexsort((rng.random(len(size)), np.argsort(np.argsort(size, kind="stable")) // 8))
    owed = float(rng.random()) * float(size[near[0]])
    for i in near.tolist():
        if left <= EXACT:
            break
        owed += (int(have[i]) * budget % total) / total * int(size[i])
        if 0 < size[i] <= min(owed, left) and take[i] < have[i]:
            take[i] += 1
            left -= int(size[i])
            owed -= int(size[i])
    while left > EXACT:  # lengths in any order alike, down to what the table of sums covers
        before = left
        for i in spread:
            if left > EXACT and 0 < size[i] <= left and take[i] < have[i]:
                take[i] += 1
                left -= int(size[i])
        if left == before:
            break
    left_table = min(left, EXACT)
    reached = np.zeros(left_table + 1, bool)
    reached[0] = True
    by = np.full(left_table + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i in spread:
        spare = int(have[i] - take[i])
        if not 0 < size[i] <= left_table:
            continue
        spare, k = min(spare, left_table // int(size[i])), 1
        while spare > 0 and not reached[left_table]:
            k = min(k, spare)
            step = k * int(size[i])
            new = np.zeros_like(reached)
            new[step:] = reached[: len(reached) - step]
            new &= ~reached
            by[new] = len(items)
            reached |= new
            items.append((int(i), k))
            spare -= k
            k *= 2
        if reached[left_table]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        i, k = items[by[at]]
        take[i] += k
        at -= k * int(size[i])
    return take.tolist()


def targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """sources (total, weight) with target: share of the sum of totals, dealt by weight, capped at cap * total.

    The excess of the capped is dealt to the others by weight until none is above its cap. Each round is
    one aggregate; the level only rises, so that there are as many rounds as times it rises.
    """
    limit, even = F.col("total") * cap, F.lit(0.0)
    words, weights = sources.agg(F.sum("total"), F.sum("weight")).first()
    level = share * words / weights if weights else 0.0
    while words:
        full = limit <= F.col("weight") * level
        capped, open_weight = sources.agg(F.coalesce(F.sum(F.when(full, limit)), even), F.coalesce(F.sum(F.when(~full, F.col("weight"))), even)).first()
        rise = (share * words - capped) / open_weight if open_weight else level
        if rise <= level:
            break
        level = rise
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(float(level))).cast("double"))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Documents with the words that a mix of the sources takes of each.

    A document's size is its number of words (null text: 0). Sources in code-point order, null last, take
    the weights in turn and deal out share times the sum of all sizes; a source gives at most repeats
    times its own size. Returns id_col, size, source_size, target (of its source) and taken (size times the
    document's copies in the mix, 0 to repeats), one row for each input row, null and repeated ids included.
    Other columns are left out. Reruns agree.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.expr(f"regexp_count(coalesce(cast(`{text_col}` as string), ''), r'{WORD}')").cast("long").alias("size")
    )
    sized = checkpointed(sized)
    totals = sized.groupBy("source").agg(F.sum("size").alias("total"))
    ranked = totals.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    numbered = spark.createDataFrame(ranked, StructType([*totals.schema, StructField("number", LongType())]))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = targets(checkpointed(numbered.withColumn("weight", turn)), share, float(repeats))
    passes = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0)
    sources = sources.withColumn("passes", passes.cast("long")).withColumn("budget", F.round(F.col("target") - F.col("passes") * F.col("total")).cast("long"))

    # null isn't equal to itself, a key is
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source")).alias("key")
    keyed = with_slice(sized.select("id", key, "size"), [F.col("id"), F.col("size")], seed)
    slices = checkpointed(slice_starts(keyed, ["key", "size"]))
    lengths = slices.groupBy("key", "size").agg(F.sum("n").alias("n"))
    budgets = sources.select(key, F.col("total").alias("source_size"), "target", "passes", "budget")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        group["extra"] = fit_budget(group["size"].tolist(), group["n"].tolist(), int(group["budget"].iloc[0]), seed)
        return group[["key", "size", "source_size", "target", "passes", "extra"]]

    # a group holds one row for each distinct length of a source, however many documents there are
    chosen = lengths.join(budgets, "key").groupBy("key").applyInPandas(choose, "key string, size long, source_size long, target double, passes long, extra long")
    quotas = slices.join(chosen, ["key", "size"]).withColumn("quota", F.least(F.greatest(F.col("extra") - F.col("start"), F.lit(0)), F.col("n")))
    order = F.xxhash64(F.lit(seed + 1), "id")
    ranked = rank_in_slice(keyed, ["key", "size"], [order, F.col("id")])
    taken = F.col("size") * (F.col("passes") + (F.col("rank") < F.col("quota")).cast("long"))
    return ranked.join(quotas.drop("n", "start"), ["key", "size", "slice"]).select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, 0 to repeats times. Columns are kept.

    A text without words is taken as often as its source is passed over as a whole. Rows that are the same
    in all columns are taken as often as they are together: each the same number of times, and the remainder
    once more. It doesn't matter which of them it is. Null ids, texts and sources are values like others, a null
    text has no words; an empty table gives no rows.
    """
    row = F.concat_ws(":", F.col(f"`{id_col}`").cast("string"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).cast("string"))
    named = docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").alias("source"))
    taken = mix_sources(named, id_col="row", text_col="text", source_col="source", **options)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(whole)
    total = F.round(F.sum(copies)).cast("long")
    shares = taken.groupBy("row").agg(total.alias("total"), F.count("*").alias("n")).where("total > 0")
    per_row = checkpointed(shares.selectExpr("row", "cast(total div n as int) as copies", "cast(total % n as int) as rest"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row.alias("row"))
    again = keyed.join(per_row.where("copies > 0"), "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    rest = per_row.where("rest > 0").select("row", "rest")
    if rests := rest.count():  # only where rows repeat
        one = keyed.join(F.broadcast(rest) if rests <= BROADCAST_ROWS else rest, "row").groupBy("row").agg(F.first("doc").alias("doc"), F.first("rest").alias("rest"))
        again = again.union(one.select("doc", F.explode(F.sequence(F.lit(1), F.col("rest"))).alias("copy")))
    return again.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
