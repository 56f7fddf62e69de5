"""Best-fit packing of documents into sequences, by bin completion.

Lengths are whole numbers up to the capacity, so the packing problem is its histogram of lengths, at
most ``capacity`` numbers for any corpus. The driver solves that: best-fit decreasing gives an incumbent,
branch and bound over the undominated fillings around the largest length left tries to beat it. Fillings are
enumerated one by one, the fullest first, up to the waste that a better packing can still afford; every node
is held against a bound of the waste that its rest can't avoid, and its rest packed by best fit is a new
incumbent if that is better. Pieces take their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches
from .ranks import rank_in_slice, slice_starts, with_slice
from .tokencount import PATTERN, is_byte_level

CAPACITY, SEPARATOR = 2048, 0
#: Nodes that the search looks at unless told otherwise; with None it goes on until the result is proven least.
NODES = 1000
#: Branches of the search, the deepest ones, whose tables of sums are held; those of others are made again when it is back.
HELD = 16

Plan = list[tuple[tuple[int, ...], int]]  # lengths of a sequence, in descending order, and how many sequences have them


# --- the packing of a histogram ----------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, equal sequences in one step: each item goes where the least room stays."""
    groups: dict[int, list[list]] = {}  # by room left: [lengths, how many]
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                fresh = capacity // length
                whole, rest = divmod(left, fresh)
                for k, n in ((fresh, whole), (rest, 1 if rest else 0)):
                    if n:
                        _put(groups, rooms, capacity - k * length, (length,) * k, n)
                break
            room = rooms[i]
            lengths, n = groups[room][-1]
            fits = min(room // length, left)
            used = min(n, left // fits)
            if used == n:
                groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
            else:
                groups[room][-1][1] = n - used
            _put(groups, rooms, room - fits * length, lengths + (length,) * fits, used)
            left -= used * fits
    merged: Counter = Counter()
    for group in groups.values():
        for lengths, n in group:
            merged[lengths] += n
    return sorted(merged.items(), reverse=True)


def _put(groups: dict, rooms: list[int], room: int, lengths: tuple[int, ...], n: int) -> None:
    if room not in groups:
        groups[room] = []
        rooms.insert(bisect_left(rooms, room), room)
    groups[room].append([lengths, n])


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by the sum, and by the items too large to share with others (L2)."""
    if not counts:
        return 0
    sizes = np.array(sorted(counts), np.int64)
    number = np.array([counts[s] for s in sizes.tolist()], np.int64)
    items, weight = np.r_[0, np.cumsum(number)], np.r_[0, np.cumsum(sizes * number)]
    half = int(np.searchsorted(sizes, capacity // 2, "right"))
    best = max(-(-int(weight[-1]) // capacity), int(items[-1] - items[half]))
    # for each k: items beyond capacity - k are alone, those beyond the half have room for some of k to the half
    low = np.arange(half)
    large = np.searchsorted(sizes, capacity - sizes[:half], "right")
    spare = (items[large] - items[half]) * capacity - (weight[large] - weight[half])
    extra = np.maximum(0, -(-(weight[half] - weight[low] - spare) // capacity))
    return max(best, int((items[-1] - items[half] + extra).max(initial=0)))


Filling = tuple[int, ...]


def fillings(left: dict[int, int], first: int, capacity: int, waste: int, after: tuple[int, Filling] | None = None) -> Iterator[Filling]:
    """Undominated ways to fill the room beside one item of length first, by what they waste, up to waste.

    Of equal waste, those with the larger lengths come first; after (waste, filling) leaves out all up to that
    one. A filling is dominated if an item left out fits in place of nothing, or of one or two of its own that
    are smaller together: whatever the other packs, this one packs too, and wastes less.
    """
    room = capacity - first
    have = {s: n - (s == first) for s, n in left.items() if s <= room and n - (s == first) > 0}
    sizes = sorted(have)
    # sums that the lengths below each can make, as bits
    mask, reach = (1 << room + 1) - 1, [1]
    for s in sizes:
        sums, copies, k = reach[-1], min(have[s], room // s), 1
        while copies > 0:
            k = min(k, copies)
            sums |= sums << k * s & mask
            copies -= k
            k *= 2
        reach.append(sums)

    def made(i: int, target: int, chosen: Filling, before: Filling | None) -> Iterator[Filling]:
        """Fillings of exactly target from the i smallest lengths, the largest first; of them those that come after before."""
        if not target:
            if before is None:
                yield chosen
            return
        i = min(i, bisect_right(sizes, min(target, before[0]) if before else target))
        while i and reach[i] >> target & 1:
            i -= 1
            s = sizes[i]
            same = before.count(s) if before and before[0] == s else 0
            for k in range(min(have[s], target // s, same or target), 0, -1):
                if reach[i] >> target - k * s & 1:
                    yield from made(i, target - k * s, chosen + (s,) * k, before[k:] if before and k == same else None)

    def dominated(filling: Filling, slack: int) -> bool:
        spare = lambda low, high: any(have[s] > filling.count(s) for s in sizes[bisect_right(sizes, low) : bisect_right(sizes, high)])
        parts = {0} | set(filling) | {filling[i] + filling[j] for i in range(len(filling)) for j in range(i)}
        return slack > 0 and any(spare(part, part + slack) for part in parts)

    for wasted in range(after[0] if after else 0, min(room, waste) + 1):
        if reach[-1] >> room - wasted & 1:
            for filling in made(len(sizes), room - wasted, (), after[1] if after and wasted == after[0] else None):
                if not dominated(filling, wasted):
                    yield filling


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES) -> tuple[Plan, int]:
    """A plan for all items and the lower bound: equal to its number of sequences if that is proven least.

    Depth first: the sequence of the largest item left is filled in each undominated way, as many times as the
    items last, then once less, and so on; equal items take their fillings in one order. A branch ends where
    the sequences so far and the waste bound of the rest reach the incumbent. The search looks at so many
    nodes, or with None goes on to the end, which proves the result least.
    """
    counts = {s: n for s, n in counts.items() if n}
    incumbent = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity)
    best = sum(n for _, n in incumbent)
    if best == bound:
        return incumbent, bound
    left, weight, used, spent = dict(counts), sum(s * n for s, n in counts.items()), 0, 0
    stack: list[tuple[Filling, int]] = []

    def options(after: tuple[int, Filling] | None, last: tuple[Filling, int] | None = None) -> Iterator[tuple[Filling, int]]:
        """Sequences for the largest length left and how many of them, in order; with last, those that follow it."""
        largest = max(left)

        def times(lengths: Filling, most: int) -> Iterator[tuple[Filling, int]]:
            wasted = capacity - sum(lengths)
            for n in range(most, 0, -1):
                # what a packing with one sequence less than the incumbent can still waste
                if n * wasted <= (best - 1 - used) * capacity - weight:
                    yield lengths, n

        if last:
            lengths, n = last
            yield from times(lengths, n - 1)
            after = place(lengths)
        for filling in fillings(left, largest, capacity, (best - 1 - used) * capacity - weight, after):
            lengths = (largest, *filling)
            yield from times(lengths, min(left[s] // k for s, k in Counter(lengths).items()))

    def place(lengths: Filling) -> tuple[int, Filling]:
        return capacity - sum(lengths), lengths[1:]

    frames: list[Iterator[tuple[Filling, int]] | None] = [options(None)]
    while frames and best > bound and (nodes is None or spent < nodes):
        option = next(frames[-1], None)
        if option is None:
            frames.pop()
            if stack:
                lengths, n = stack.pop()
                for s in lengths:
                    left[s] = left.get(s, 0) + n
                weight += n * sum(lengths)
                used -= n
                if frames[-1] is None:
                    frames[-1] = options(None, (lengths, n))
            continue
        spent += 1
        lengths, n = option
        for s in lengths:
            left[s] -= n
            if not left[s]:
                del left[s]
        weight -= n * sum(lengths)
        used += n
        stack.append((lengths, n))
        again = best_fit(left, capacity)
        if (total := used + sum(k for _, k in again)) < best:
            best, incumbent = total, [*stack, *again]
        if not left or used + lower_bound(left, capacity) >= best:
            frames.append(iter(()))  # the next turn takes it back
        else:
            frames.append(options(place(lengths) if lengths[0] in left else None))
        if len(frames) > HELD:
            frames[-1 - HELD] = None  # stack has the option that it gave last
    merged: Counter = Counter()
    for lengths, n in incumbent:
        merged[tuple(sorted(lengths, reverse=True))] += n
    return sorted(merged.items(), reverse=True), bound if frames and best > bound else best


def slots(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end, first sequence, copies in a sequence, offset of the first): where ranks go."""
    taken: Counter = Counter()
    out, sequence = [], 0
    for lengths, n in plan:
        offset = 0
        for length, copies in Counter(lengths).items():  # in the order of lengths
            out.append((length, taken[length], taken[length] + n * copies, sequence, copies, offset))
            taken[length] += n * copies
            offset += length * copies
        sequence += n
    return out


# --- tokens ----------------------------------------------------------------------------------------------


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to the ids that the tokenizers library gives for the file at path, without added tokens.

    Byte-level vocabularies whose ids follow their merges go through a byte-pair encoder over the same
    ranks, which is several times faster; others go through the library.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocabulary, merges = spec["model"].get("vocab", {}), spec["model"].get("merges", [])
    joined = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in merges]
    if is_byte_level(path) and all(vocabulary.get(t) == 256 + i for i, t in enumerate(joined)):
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        allowed = set(special)
        return lambda text: core.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each document: id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and the separator. One longer than capacity is cut into pieces of capacity, the
    first of which takes the remainder.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        encode = encoder(path)

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            out: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32", "ids")}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), SEPARATOR).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out["id"].append(key)
                    out["piece"].append(piece)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
                    out["ids"].append(ids[a:b].astype("i4") if with_ids else None)
            yield out

        return each

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = map_batches(rows, make, f"id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>")
    return found if with_ids else found.drop("ids")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, nodes: int | None = NODES) -> DataFrame:
    """Packs whole documents into as few sequences of at most capacity tokens as the search finds.

    Returns one row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset, proven (and
    ids). proven says whether no packing of these pieces has fewer sequences; nodes limits the search for one
    (None: no limit, always proven), which only starts where best fit doesn't reach the lower bound.
    Places in a sequence are gapless from 0. A null text counts as empty: its one token is the separator.
    Null and repeated ids are packed like others, an empty table gives no rows, other columns are left out.
    """
    spark = docs.sparkSession
    cut = checkpointed(pieces(docs, path, capacity, id_col, text_col, with_ids))
    histogram = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most capacity rows
    counts = {r.length: r.n for r in histogram}
    plan, bound = bin_completion(counts, capacity, nodes)
    proven = sum(n for _, n in plan) == bound
    order = [F.col("id"), F.col("piece"), F.col("ids_crc32")]
    sliced = with_slice(cut, order)
    starts = slice_starts(sliced, ["length"])
    ranked = rank_in_slice(sliced, ["length"], order).join(starts.select("length", "slice", F.col("start").alias("before")), ["length", "slice"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    table = spark.createDataFrame(slots(plan), "slot_length long, first long, last long, sequence long, copies long, place long")
    # its rows are bounded by the distinct lengths and the fillings in use, not by the documents
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    at = F.col("rank") - F.col("first")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("place") + at % F.col("copies") * F.col("length")).cast("long").alias("offset"), F.lit(proven).alias("proven"),
        *(["ids"] if with_ids else []),
    )
