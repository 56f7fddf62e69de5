"""Jaccard self-join of documents on word n-grams, by adaptive multi-match prefixes.

A document is its set of n-grams, each hashed. Put all n-grams in any one order: two sets of which each
shares at least the share t of its n-grams with the other have, for every k, at least k n-grams in common
among the first n - t + k of either. So each document may pick its own k: k = 1 is the usual prefix
filter, a longer prefix costs more postings but asks for more matches before anything is verified, and a
pair has to share the smaller k of the two.

First, in the order of the hashes, every document tries several k over its longest prefix: it is out if
for any k it has fewer than k n-grams that another document's prefix has too. Most of a corpus is out
here. The others are counted again, whole, and put in the order of document frequency, rarest first; each
picks the k with the least estimated cost, the postings in its prefix and the verifications that they can
lead to. They are grouped by their least shared n-gram, which most copies of a text have in common, so that
a large group of near copies meets as a group. Matches are counted for pairs of groups, not of documents;
verification runs inside groups and returns a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType, _parse_datatype_string

from .common import checkpointed, map_batches, release, shuffle_partitions
from .components import components

#: The longest prefix reaches this share of a set beyond the usual one.
LONGEST = 1 / 16
#: Documents of a block in verification: at least BLOCK, and GROWTH (in the second round LATER) times the root of a
#: group's size, so that a group's rows there grow with the power 1.5 of its size at most while a block stays far
#: smaller than the group. No block has many more n-grams than TOKENS, however long its documents are. Visitors that
#: one task compares with a block are as many, or have STREAMED times as many n-grams, as they aren't kept.
BLOCK, GROWTH, LATER, TOKENS, STREAMED = 256, 4, 16, 1 << 22, 4
#: Members of a group of several blocks that each of its blocks compares with.
HUBS = 6
#: An n-gram that so many sets of one Arrow batch have is hot there. Hot n-grams whose count is at least the
#: HOT_SHARE-th part of all entries get their frequency from a broadcast table, which so has HOT_SHARE rows at most.
HOT, HOT_SHARE = 64, 1 << 18
#: Groups of one n-gram that one task pairs off; those of a more frequent one are cut into blocks of as many.
CROWD = 2048
#: Bytes of packed rows that a task holds; a partition with more is worked on in so many parts, by a hash.
HOLD, PARTS = 32 << 20, 32
#: Tables of one row for each large group are broadcast up to this many rows, some MB.
BROADCAST_ROWS = 100_000
#: Cost of verifying a candidate, in postings looked at.
VERIFY = 40
#: Words whose hashes a worker keeps.
CACHE = 150_000
M = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingler(words: int) -> Callable[[bytes], np.ndarray]:
    """Text to the sorted distinct 64-bit hashes of its n-grams of lower-cased words; the whole sequence if it is shorter."""
    known = _Words()

    def shingles(text: bytes) -> np.ndarray:
        found = text.lower().split()  # of bytes: only A-Z, and only the six ASCII spaces
        if not found:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        k = min(words, len(found))
        out = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            out = (out ^ (out >> np.uint64(29))) * M + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(33)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(33)
        return np.unique(out)

    return shingles


def set_key(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) >> 1


def least_shared(n, percent: int):
    """n-grams that a set of n must share with any set that it links with."""
    return (percent * n + 99) // 100


def longest(n, percent: int):
    """The largest k that a set of n may pick."""
    return np.minimum(least_shared(n, percent), np.int64(1) + (n * LONGEST).astype(np.int64))


def linked(shared, n, m, percent: int):
    return 100 * shared >= percent * (n + m - shared)


# --- packed columns: a row carries the entries of a bucket as bytes -------------------------------------

#: The packed columns and the form of their values.
FORMS = {"tokens": "<u8", "keys": "<u8", "trials": "u1", "known": "<u8", "sizes": "<u4", "dfs": "<u4", "spots": "<u8", "leads": "<u8", "ks": "<u4", "least": "<u4", "most": "<u4", "sides": "u1"}


def pack(name: str, values: np.ndarray) -> bytes:
    return values.astype(FORMS[name]).tobytes()


def unpack(name: str, data: bytes) -> np.ndarray:
    return np.frombuffer(data, FORMS[name])


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets from the mixed low bits: prefixes hold small hashes."""
    return (((values * M) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _part(values: np.ndarray) -> np.ndarray:
    """Parts of a partition, from other bits than those that buckets are made of."""
    return (((values * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(PARTS)).astype(np.int32)


def _split(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, list]:
    """Rows of packed columns, one for each bucket that has entries."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
    last = np.r_[first[1:], len(bucket)] if len(first) else first
    out: dict[str, list] = {"bucket": bucket[first].tolist()}
    for name, values in columns.items():
        values = values[order].astype(FORMS[name])
        out[name] = [values[a:b].tobytes() for a, b in zip(first, last, strict=True)]
    return out


def _batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * rows), f.type) for f in schema], schema=schema)


def _in_parts(df: DataFrame, kinds: dict[str, list[str]], work: Callable[[dict[str, np.ndarray]], Iterator[dict]], schema: str, small: bool, passing: str | None = None, filled: bool = True) -> DataFrame:
    """work on the packed rows of each partition, joined column by column. Rows whose column passing is filled, or isn't, go on as they are.

    kinds names the columns of each kind of packed row under the one that says where an entry belongs. Unless
    partitions are known to be small, one that HOLD bytes don't hold is cut into parts by a hash of that column,
    sorted by part, which spills, and worked on part by part. That takes a second Python worker a task.
    """
    out, packed = _parsed(schema), [c for columns in kinds.values() for c in columns]
    kept = [f for f in df.schema if f.name not in packed and f.name in out.names] if passing else []
    kept += [f for f in df.schema if f.name == passing and f not in kept and f.name not in packed]
    cut = StructType([*kept, *[StructField(c, BinaryType()) for c in packed], StructField("part", IntegerType())])
    arrow, arrow_cut = to_arrow_schema(out), to_arrow_schema(cut)

    def whole_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in packed}
        for batch in batches:
            if passing:
                plain = pc.equal(batch.column(passing).is_valid(), filled)
                if (through := batch.filter(plain)).num_rows:
                    yield through.select(arrow.names).cast(arrow)
                batch = batch.filter(pc.invert(plain))
            for c in packed:
                held[c] += [v for v in batch.column(c).to_pylist() if v]
        if any(held.values()):
            joined = {c: unpack(c, b"".join(values)) for c, values in held.items()}
            held.clear()
            for columns in work(joined):
                yield _batch(columns, arrow)
            del joined
        release()

    if small:
        names = dict.fromkeys([*(c for c in out.names if c in df.columns), *packed, *([passing] if passing else [])])
        return df.select(*names).mapInArrow(whole_partition, out)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in packed}
        size, whole = 0, True

        def rows() -> Iterator[pa.RecordBatch]:
            for key, columns in kinds.items():
                if not held[key]:
                    continue
                joined = {c: unpack(c, b"".join(held[c])) for c in columns}
                parts = _split(np.zeros(len(joined[key]), np.int32) if whole else _part(joined[key]), joined)
                parts["part"] = parts.pop("bucket")
                yield _batch(parts, arrow_cut)
                for c in columns:
                    held[c] = []

        for batch in batches:
            if passing:
                plain = pc.equal(batch.column(passing).is_valid(), filled)
                if (through := batch.filter(plain)).num_rows:
                    some = {c: through.column(c) for c in arrow_cut.names if c in through.schema.names}
                    nothing = [None] * through.num_rows
                    yield pa.RecordBatch.from_arrays([some.get(f.name, pa.array(nothing, f.type)).cast(f.type) for f in arrow_cut], schema=arrow_cut)
                batch = batch.filter(pc.invert(plain))
            for c in packed:
                values = [v for v in batch.column(c).to_pylist() if v]
                held[c] += values
                size += sum(map(len, values))
            if size > HOLD:
                whole = False
                yield from rows()
                size = 0
        yield from rows()
        del held
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {c: [] for c in packed}

        def finish() -> Iterator[pa.RecordBatch]:
            if any(held.values()):
                for columns in work({c: unpack(c, b"".join(values)) for c, values in held.items()}):
                    yield _batch(columns, arrow)
            for values in held.values():
                values.clear()

        for batch in batches:
            plain = batch.column("part").is_valid()
            if (through := batch.filter(pc.invert(plain))).num_rows:
                yield through.select(arrow.names).cast(arrow)
            batch = batch.filter(plain)
            part = batch.column("part").to_numpy(zero_copy_only=False)
            if not len(part):
                continue
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist()
            for a, b in zip(first, [*first[1:], len(part)], strict=True):
                if part[a] != now:
                    yield from finish()
                    now = part[a]
                for c in packed:
                    held[c] += [v for v in batch.column(c).slice(a, b - a).to_pylist() if v]
        yield from finish()
        del held
        release()

    return df.select(*cut.names[:-1]).mapInArrow(deal, cut).sortWithinPartitions("part").mapInArrow(run, out)


def _parsed(schema: str) -> StructType:
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    return struct


# --- the steps ------------------------------------------------------------------------------------------


def trials(n: int, percent: int) -> list[int]:
    """The k that a set of n tries in the order of the hashes: powers of two and the largest."""
    most = int(longest(np.int64(n), percent))
    return sorted({*(1 << i for i in range(most.bit_length()) if 1 << i <= most), most})


def signatures(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """One pass over the texts. Rows with an id: id, n, key (of the set), dealt evenly. The others: the entries of the
    longest prefixes, as packed n-grams, keys and trials (the first whose prefix holds the n-gram).

    The entries of an n-gram that is hot in a batch are known to be shared: they go straight to the bucket of
    their key, without the n-gram, and one entry marked SHARED tells the n-gram's bucket so. No bucket gets
    more of an n-gram than a few entries a batch.
    """

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        shingles = shingler(words)

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            ns, keys, tokens, first, lengths, owners = [], [], [], [], [], []
            seen = set()
            for text in batch.column(1):
                s = shingles(text.as_py() or b"")
                n, key = len(s), set_key(s)
                ns.append(n)
                keys.append(key)
                if n and key not in seen:
                    seen.add(key)
                    tries = np.array(trials(n, percent))
                    ends = n - int(least_shared(n, percent)) + tries
                    tokens.append(s[: ends[-1]])
                    first.append(np.searchsorted(ends, np.arange(ends[-1]), "right").astype(np.uint8))
                    lengths.append(ends[-1])
                    owners.append(key)
            none = [None] * len(ns)
            yield {"id": batch.column(0), "n": ns, "key": keys, "bucket": np.arange(len(ns)) % buckets, "tokens": none, "keys": none, "trials": none}
            if tokens:
                token, owner, trial = np.concatenate(tokens), np.repeat(np.array(owners, np.uint64), lengths), np.concatenate(first)
                order = np.argsort(token, kind="stable")
                token, owner, trial = token[order], owner[order], trial[order]
                start = _runs(token)
                counts = np.diff(np.r_[start, len(token)])
                hot = np.repeat(counts >= HOT, counts)
                marks = start[counts >= HOT]
                sent = ~hot
                sent[marks] = True
                marked = trial.copy()
                marked[marks] = SHARED
                parts = _split(_bucket(token[sent], buckets), {"tokens": token[sent], "keys": owner[sent], "trials": marked[sent]})
                none = [None] * len(parts["bucket"])
                yield {"id": none, "n": none, "key": none} | parts
                if hot.any():
                    order = np.argsort(owner[hot], kind="stable")
                    owner, trial = owner[hot][order], trial[hot][order]
                    parts = _split(_bucket(owner, buckets), {"keys": owner, "trials": trial})
                    none = [None] * len(parts["bucket"])
                    yield {"id": none, "n": none, "key": none, "tokens": none} | parts

        return each

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs, make, f"id {kind}, n long, key long, bucket int, tokens binary, keys binary, trials binary")


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """First index of each run of equal rows."""
    n = len(sorted_columns[0])
    change = np.zeros(n, bool)
    if n:
        change[0] = True
    for c in sorted_columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


#: Trial of an entry that stands for its n-gram in a batch where that is hot.
SHARED = 255


def shared_entries(signed: DataFrame, buckets: int, small: bool) -> DataFrame:
    """By bucket of n-grams to by bucket of keys: key and trial of each entry whose n-gram another set's
    prefix has too. Rows without n-grams pass through: those with an id, and entries that are known to be shared."""

    def work(got: dict[str, np.ndarray]) -> Iterator[dict]:
        token, key, trial = got["tokens"], got["keys"], got["trials"]
        order = np.lexsort((key, token))
        token, key, trial = token[order], key[order], trial[order]
        once = _runs(token, key)  # copies of a set in other tasks
        token, key, trial = token[once], key[once], trial[once]
        first = _runs(token)
        df = np.diff(np.r_[first, len(token)])
        marked = np.add.reduceat(trial == SHARED, first) > 0 if len(first) else first
        many = np.repeat((df > 1) | marked, df) & (trial != SHARED)
        key, trial = key[many], trial[many]
        order = np.argsort(key, kind="stable")
        parts = _split(_bucket(key[order], buckets), {"keys": key[order], "trials": trial[order]})
        if parts["bucket"]:
            yield parts

    kind = signed.schema["id"].dataType.simpleString()
    return _in_parts(signed, {"tokens": ["tokens", "keys", "trials"]}, work, f"id {kind}, n long, key long, bucket int, keys binary, trials binary", small, "tokens", False)


def screen(entries: DataFrame, percent: int, small: bool) -> DataFrame:
    """key of each set that may have a partner: for every k tried, k n-grams of its prefix are shared."""

    def work(got: dict[str, np.ndarray]) -> Iterator[dict]:
        known, sizes, key, trial = got["known"], got["sizes"], got["keys"], got["trials"]
        if not len(key):
            return
        by = np.argsort(known, kind="stable")
        names, group = np.unique(key, return_inverse=True)
        n = sizes[by][np.searchsorted(known[by], names)].tolist()
        counts = np.zeros((len(names), 64), np.int64)
        np.add.at(counts, (group, trial), 1)
        matches = counts.cumsum(1)
        alive = [all(matches[i, j] >= k for j, k in enumerate(trials(n[i], percent))) for i in range(len(names))]
        yield {"key": names[alive].astype(np.int64)}

    return _in_parts(entries, {"keys": ["keys", "trials"], "known": ["known", "sizes"]}, work, "key long", small)


def frequencies(entries: DataFrame, buckets: int, small: bool) -> DataFrame:
    """By bucket of n-grams to by bucket of keys: each entry whose n-gram more than one set has, with how many.
    Entries that have their frequency already pass through."""

    def work(got: dict[str, np.ndarray]) -> Iterator[dict]:
        token, key = got["tokens"], got["keys"]
        order = np.lexsort((key, token))
        token, key = token[order], key[order]
        once = _runs(token, key)
        token, key = token[once], key[once]
        first = _runs(token)
        df = np.diff(np.r_[first, len(token)])
        df = np.repeat(df, df)
        many = df > 1
        token, key, df = token[many], key[many], df[many]
        order = np.argsort(key, kind="stable")  # runs of a key shrink well
        yield _split(_bucket(key[order], buckets), {"tokens": token[order], "keys": key[order], "dfs": df[order]})

    return _in_parts(entries, {"tokens": ["tokens", "keys"]}, work, "bucket int, tokens binary, keys binary, dfs binary", small, "dfs")


def choose(entries: DataFrame, percent: int, buckets: int, small: bool) -> DataFrame:
    """By bucket of keys: each set picks its k, in the order of document frequency.

    Rows with a key: a set that may still have a partner, its size and its group. The others: postings of groups,
    packed, by the spot where they are to be paired off: that of the n-gram, or, where more than CROWD sets have
    it, of each pair of blocks of groups that the group's own block is in.
    """

    def work(got: dict[str, np.ndarray]) -> Iterator[dict]:
        known, sizes, token, key, df = got["known"], got["sizes"], got["tokens"], got["keys"], got["dfs"].astype(np.int64)
        if not len(key):
            return
        order = np.lexsort((token, df, key))
        token, key, df = token[order], key[order], df[order]
        once = _runs(key, df, token)  # repeated rows of a document
        token, key, df = token[once], key[once], df[once]
        first = _runs(key)
        counts = np.diff(np.r_[first, len(key)])
        group = np.repeat(np.arange(len(first)), counts)
        by = np.argsort(known, kind="stable")
        n = sizes[by][np.searchsorted(known[by], key[first])].astype(np.int64)
        spare = n - least_shared(n, percent)
        # n-grams that no other set has come first, all others in order
        level = np.maximum(1, (n - counts)[group] + np.arange(len(key)) - first[group] + 1 - spare[group])
        most = np.maximum(1, least_shared(n, percent) // 2)
        alive, best, best_cost = np.ones(len(first), bool), np.ones(len(first), np.int64), np.full(len(first), np.inf)
        k = 1
        while k <= most.max(initial=0):
            fits = k <= most
            inside = level <= k
            matches, postings = np.bincount(group, inside, len(first)), np.bincount(group, inside * (df - 1), len(first))
            alive &= ~fits | (matches >= k)
            # no more sets than postings / k can share k of the postings
            cost = postings + VERIFY * postings / k
            better = fits & (cost < best_cost)
            best[better], best_cost[better] = k, cost[better]
            k *= 2
        lead = np.minimum.reduceat(token, first) if len(first) else token
        inside = (level <= best[group]) & alive[group]
        token, df, group = token[inside], df[inside], group[inside]
        ks, leads, ns = best[group], lead[group], n[group]
        order = np.lexsort((leads, token))
        token, df, ks, leads, ns = token[order], df[order], ks[order], leads[order], ns[order]
        once = _runs(token, leads)  # a group has an n-gram once, with its least k and its sizes
        if alive.any():
            yield {"key": key[first][alive].astype(np.int64), "n": n[alive], "lead": lead[alive].astype(np.int64)}
        if len(token):
            ks, least, most = np.minimum.reduceat(ks, once), np.minimum.reduceat(ns, once), np.maximum.reduceat(ns, once)
            spot, at, side = spots(token[once], leads[once], df[once])
            yield _split(_bucket(spot, buckets), {"spots": spot, "leads": leads[once][at], "ks": ks[at], "least": least[at], "most": most[at], "sides": side})

    return _in_parts(entries, {"keys": ["tokens", "keys", "dfs"], "known": ["known", "sizes"]}, work, "key long, n long, lead long, bucket int, spots binary, leads binary, ks binary, least binary, most binary, sides binary", small)


def spots(token: np.ndarray, lead: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where postings are paired off: (spot, index of the posting, side). Sides 0 and 1 are paired with each other, 2 with itself."""
    blocks = -(-df // CROWD)
    own = (((lead * M) >> np.uint64(17)) % blocks.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(token)), blocks)
    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    mine = own[at]
    i, j = np.minimum(mine, other), np.maximum(mine, other)
    code = np.where(blocks[at] > 1, i * blocks[at] + j + 1, 0).astype(np.uint64)
    spot = token[at] ^ (code * np.uint64(0x9FB21C651E98DF25))
    return spot, at, np.where(i == j, 2, mine > other).astype(np.uint8)


def group_pairs(postings: DataFrame, percent: int, small: bool) -> DataFrame:
    """a, b, matches, k: groups with common n-grams in their prefixes, a < b, as counted in one partition.

    Only groups that have sets of sizes that can link are paired.
    """

    def work(got: dict[str, np.ndarray]) -> Iterator[dict]:
        spot, lead, k, side = got["spots"], got["leads"].astype(np.int64), got["ks"].astype(np.int64), got["sides"]
        low, high = got["least"].astype(np.int64), got["most"].astype(np.int64)
        order = np.lexsort((lead, spot))
        spot, lead, k, side, low, high = spot[order], lead[order], k[order], side[order], low[order], high[order]
        once = _runs(spot, lead)
        if not len(once):
            return
        k, low, high = np.minimum.reduceat(k, once), np.minimum.reduceat(low, once), np.maximum.reduceat(high, once)
        spot, lead, side = spot[once], lead[once], side[once]
        order = np.lexsort((low, spot))  # by least size, so that what can link lies together
        spot, lead, side, k, low, high = spot[order], lead[order], side[order], k[order], low[order], high[order]
        first = _runs(spot)
        sizes = np.diff(np.r_[first, len(spot)])
        a, b, smaller, held = [], [], [], 0

        def flush() -> dict:
            x, y, m = np.concatenate(a), np.concatenate(b), np.concatenate(smaller)
            x, y = np.minimum(x, y), np.maximum(x, y)
            by = np.lexsort((m, y, x))
            x, y, m = x[by], y[by], m[by]
            start = _runs(x, y)
            return {"a": x[start], "b": y[start], "matches": np.diff(np.r_[start, len(x)]), "k": m[start]}

        for i, n in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            # a set of size m links with none below percent of m
            ends = i + np.searchsorted(low[i : i + n], high[i : i + n] * 100 // percent, "right")
            for j in range(i, i + n - 1):
                rest = np.arange(j + 1, ends[j - i])
                rest = rest[(side[rest] != side[j]) | (side[j] == 2)]
                if len(rest):
                    a.append(np.full(len(rest), lead[j]))
                    b.append(lead[rest])
                    smaller.append(np.minimum(k[j], k[rest]))
                    held += len(rest)
                if held > 1 << 20:
                    yield flush()
                    a, b, smaller, held = [], [], [], 0
        if held:
            yield flush()

    return _in_parts(postings, {"spots": ["spots", "leads", "ks", "least", "most", "sides"]}, work, "a long, b long, matches long, k long", small)


class Members:
    """The members of a block, by the postings of their n-grams, and what is known to be connected among them."""

    def __init__(self, ids: list, sets: list[np.ndarray], percent: int) -> None:
        self.ids, self.sets, self.percent = ids, sets, percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets)
        holder = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(token, kind="stable")
        token, self.holder = token[order], holder[order]
        self.starts = _runs(token)
        self.names, self.ends = token[self.starts], np.r_[self.starts[1:], len(token)]
        self.parent = list(range(len(sets)))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def near(self, tokens: np.ndarray) -> list[int]:
        """The members that a set links with, by counting its n-grams in their postings."""
        at = np.searchsorted(self.names, tokens)
        at = at[(at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == tokens)]
        lens = self.ends[at] - self.starts[at]
        if not len(lens):
            return []
        begin = np.repeat(self.starts[at] - np.r_[0, np.cumsum(lens)[:-1]], lens)
        shared = np.bincount(self.holder[begin + np.arange(len(begin))], minlength=len(self.sets))
        return np.flatnonzero((shared > 0) & linked(shared, len(tokens), self.sizes, self.percent)).tolist()

    def connect(self, key, tokens: np.ndarray) -> tuple[int | None, list[tuple]]:
        """A member that a set links with, and links (id, id): one for each part of the members that it connects.

        The parts are one from then on.
        """
        met, first, links = None, None, []
        for j in self.near(tokens):
            r = self.root(j)
            if first is None:
                met, first = j, r
            elif r == first:
                continue
            else:
                self.parent[max(r, first)] = min(r, first)
                first = min(r, first)
            if self.ids[j] != key:
                links.append((key, self.ids[j]))
        return met, links

    def among(self) -> Iterator[tuple]:
        """Links that connect what the links between members connect.

        What is connected with the first hub needs no comparison among itself, so that a group of near
        copies costs one for each set outside of it.
        """
        # the set whose n-grams the others have most is the likely hub
        counts = self.ends - self.starts
        weight = np.bincount(self.holder, np.repeat(counts, counts), len(self.sets)) / self.sizes
        hub = int(np.argmax(weight))
        yield from self.connect(self.ids[hub], self.sets[hub])[1]
        for i in range(len(self.sets)):
            if i != hub and self.root(i) != self.root(hub):
                yield from self.connect(self.ids[i], self.sets[i])[1]


MEMBER, HUB, VISITOR = 0, 1, 2


def verify(rows: DataFrame, percent: int, among: bool = True) -> DataFrame:
    """Spanning links a, b of each (lead, block, chunk), from rows lead, block, chunk, role, hub, key, id, tokens.

    A block's members and the hubs of its group are held, at most a block of them, and compared among
    themselves if asked to; its visitors are compared with them one after another and not kept. Where there are
    hubs, rows without a and b say with which of them (a bit each) every member and visitor is connected.
    """
    kind = rows.schema["id"].dataType
    struct = StructType([StructField("a", kind), StructField("b", kind), StructField("lead", LongType()), StructField("key", LongType()), StructField("visitor", BooleanType()), StructField("mask", IntegerType())])
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, members, visits = None, {}, None, []

        def settle() -> Iterator[tuple]:
            """All members of a block are there."""
            nonlocal members
            keys = sorted(held)
            if keys:
                members = Members([held[k][0] for k in keys], [held[k][1] for k in keys], percent)
                if among:
                    for a, b in members.among():
                        yield a, b, None, None, None, None

        def finish() -> Iterator[tuple]:
            """A block is done: what is connected with which hub."""
            if now is None:
                return
            if members is None:
                yield from settle()
            keys = sorted(held)
            hubs = [(1 << held[k][3], members.root(i)) for i, k in enumerate(keys) if held[k][3] is not None]
            if not hubs:
                return
            mask_of: dict[int, int] = {}
            for bit, root in hubs:
                mask_of[root] = mask_of.get(root, 0) | bit
            lead, _, chunk = now
            if chunk == 0:
                for i, k in enumerate(keys):
                    if held[k][2]:
                        yield None, None, lead, k, False, mask_of.get(members.root(i), 0)
            for k, i in visits:
                yield None, None, lead, k, True, 0 if i is None else mask_of.get(members.root(i), 0)

        def links(batch: pa.RecordBatch | None) -> Iterator[tuple]:
            nonlocal now, held, members, visits
            for lead, block, chunk, role, hub, key, i, data in zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch else [(None,) * 8]:
                if (lead, block, chunk) != now:
                    yield from finish()
                    now, held, members, visits = (lead, block, chunk), {}, None, []
                if data is None:
                    return
                if role != VISITOR:
                    # repeated rows of a document give the same set again; a hub may be a member of this block too
                    before = held.get(key, (None, None, False, None))
                    held[key] = i, unpack("tokens", data), before[2] or role == MEMBER, hub if hub is not None else before[3]
                    continue
                if members is None:
                    yield from settle()
                met = None
                if members is not None:
                    near, found = members.connect(i, unpack("tokens", data))
                    met = near
                    for a, b in found:
                        yield a, b, None, None, None, None
                visits.append((key, met))

        for batch in (part for parts in (batches, [None]) for part in parts):
            if found := list(links(batch)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)
        del held, members, visits
        release()

    order = ["lead", "block", "chunk"]
    dealt = rows.select(*order, "role", "hub", "key", "id", "tokens").repartition(shuffle_partitions(rows.sparkSession), *order)
    return dealt.sortWithinPartitions(*order, "role").mapInArrow(run, struct)


POSTINGS = ["spots", "leads", "ks", "least", "most", "sides"]


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the documents under links of Jaccard similarity percent / 100 or more on word n-grams.

    Words are lower-cased (A-Z) runs between the six ASCII spaces. A document with fewer words than an
    n-gram has its whole sequence as its one; without words or text its set is empty and it links with
    nothing. Returns id_col, n_shingles and component_id (the smallest id reachable by links), one row for
    each input row. Rows of the same id count as one document's; a row whose id is null links with nothing
    and has itself, null, as component. Other columns are left out, an empty table gives no rows.

    Set identity goes by a 63-bit hash, n-grams by one of 64 bits. Links are searched as far as components need
    them: those between sets that others connect already aren't looked for, so that they aren't counted.
    """
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    # the entries of a text take about as many bytes as the text; what isn't known to be small counts as large
    small = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= HOLD * buckets
    signed = checkpointed(shared_entries(signatures(rows, words, percent, buckets).repartitionById(buckets, "bucket"), buckets, small))
    every = signed.where("n is not null").select("id", "n", "key")
    sets = checkpointed(every.where("id is not null and n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.max("n").alias("n")))
    sized = _packed_sizes(sets, buckets)
    passed = signed.where("n is null").select("bucket", "keys", "trials")
    survivors = screen(_together(passed, sized).repartitionById(buckets, "bucket"), percent, small)

    whole = checkpointed(_sets(rows.where("id is not null").join(survivors.join(sets, "key").groupBy(F.col("rep").alias("id")).agg(F.collect_list("key").alias("wanted")), "id"), words))
    hot = spark.sparkContext.broadcast(_hot(whole))
    counted = frequencies(_entries(whole, buckets, hot).repartitionById(buckets, "bucket"), buckets, small)
    chosen = checkpointed(choose(_together(counted, _packed_sizes(whole, buckets)).repartitionById(buckets, "bucket"), percent, buckets, small))
    members = chosen.where("key is not null").select("key", "n", "lead")
    postings = chosen.where("key is null").select("bucket", *POSTINGS)
    matched = group_pairs(postings.repartitionById(buckets, "bucket"), percent, small).groupBy("a", "b").agg(F.sum("matches").alias("matches"), F.min("k").alias("k"))
    pairs = matched.where("matches >= k").select("a", "b")
    reached = components(_links(members, pairs, whole.select("key", "id", "tokens"), percent))
    named = sets.join(reached, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("component"))
    joined = every.join(named, "key", "left")
    own = F.when((F.col("n") == 0) | F.col("id").isNull(), F.col("id")).otherwise(F.col("component"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their group of near duplicates: those of the smallest id. Columns are kept.

    Texts without words stand for themselves, and so do rows without an id. Of several rows with a standing
    id one stays, the first by its columns.
    """
    groups = checkpointed(jaccard_groups(docs, words, percent, id_col, text_col).select(F.col(id_col).alias("id"), "component_id"))
    standing = groups.where("id = component_id").groupBy("id").agg(F.count("*").alias("rows"))
    key = F.col(f"`{id_col}`")
    kept = docs.join(standing.select(F.col("id").alias(id_col)), id_col, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    if standing.where("rows > 1").limit(1).count():
        # minima are combined before the shuffle, so that an id of very many rows doesn't meet in one task
        first = kept.groupBy(key.alias("one id")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("first row"))
        kept = first.select(*[F.col("first row").getField(c).alias(c) for c in docs.columns])
    return kept.union(docs.where(key.isNull()))


def _packed_sizes(sets: DataFrame, buckets: int) -> DataFrame:
    """bucket, known (keys), sizes: the sizes of all sets, packed by bucket of keys."""

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            key, n = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
            yield _split(_bucket(key, buckets), {"known": key, "sizes": n})

        return each

    return map_batches(sets.select("key", "n"), make, "bucket int, known binary, sizes binary")


def _few(table: DataFrame) -> DataFrame:
    """A checkpointed table, marked for broadcast if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _block_count(size: Column, tokens: Column, growth: int, kept: int = 1) -> Column:
    return F.greatest(F.ceil(size / F.greatest(F.lit(BLOCK), F.ceil(growth * F.sqrt(size)))), F.ceil(tokens / (kept * TOKENS))).cast("int")


def _dealt(column: str, seed: int, into: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), into).cast("int")


def _chunks(visitors: DataFrame, by: list[str]) -> DataFrame:
    """chunks of the visitors of each by, where one task shouldn't compare them all."""
    counts = visitors.groupBy(*by).agg(F.count("*").alias("size"), F.sum("n").alias("grams"))
    chunks = _block_count(F.col("size"), F.col("grams"), LATER, STREAMED)
    return _few(checkpointed(counts.select(*by, chunks.alias("chunks")).where("chunks > 1")))


def _links(members: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect what all links connect. members: key, n, lead (the group); pairs of groups a, b.

    A group beyond one block is cut by a hash of the key. First, the sets of each block are compared among
    themselves and with a few hubs of the group, and with the sets of smaller groups that are paired with this
    one, its visitors, each of which visits one block. What is connected with the group's main hub in its block
    needs no comparison with other blocks' sets that are, too: of a group of near copies hardly a set is left. Those left
    are compared with all others of the group, and visitors that are left with the group's other blocks.
    Blocks and visitors meet in tasks of bounded size.
    """
    sizes = checkpointed(members.groupBy("lead").agg(F.count("*").alias("size"), F.sum("n").alias("grams")))
    big = _few(checkpointed(sizes.select("lead", _block_count(F.col("size"), F.col("grams"), GROWTH).alias("blocks")).where("blocks > 1")))
    blocks = F.coalesce("blocks", F.lit(1))
    mine = checkpointed(members.join(big, "lead", "left").select("key", "n", "lead", blocks.alias("blocks"), _dealt("key", 0, blocks).alias("block")))

    of = lambda side: sizes.select(F.col("lead").alias(side), F.col("size").alias(f"{side}_size"))
    turned = pairs.join(of("a"), "a").join(of("b"), "b")
    smaller = (F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a") < F.col("b")))
    visits = turned.select(F.when(smaller, F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(smaller, F.col("b")).otherwise(F.col("a")).alias("host"))
    # a large group's members are joined block by block
    salted = visits.join(big, "lead", "left").select("lead", "host", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    hosts = big.select(F.col("lead").alias("host"), F.col("blocks").alias("host_blocks"))
    going = mine.select("key", "n", "lead", "block").join(salted, ["lead", "block"]).select("key", "n", "host").join(hosts, "host", "left")
    visitors = checkpointed(going.select("key", "n", F.col("host").alias("lead"), _dealt("key", 1, F.coalesce("host_blocks", F.lit(1))).alias("block")))
    chunks = _chunks(visitors, ["lead", "block"])
    many = F.coalesce("chunks", F.lit(1))
    each = F.explode(F.sequence(F.lit(0), many - 1)).alias("chunk")

    def row(role: int, hub: Column | None = None) -> list[Column]:
        return [F.lit(role).alias("role"), (F.lit(None) if hub is None else hub).cast("int").alias("hub"), F.col("key")]

    own = mine.join(chunks, ["lead", "block"], "left").select("lead", "block", each, *row(MEMBER))
    least = [F.min_by("key", F.xxhash64("key", F.lit(i))) for i in range(HUBS)]
    of_groups = mine.where("blocks > 1").groupBy("lead", "blocks").agg(F.array_distinct(F.array(*least)).alias("hubs"))
    hub_rows = of_groups.select("lead", "blocks", F.posexplode("hubs").alias("hub", "key")).select("lead", "hub", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    hubs = hub_rows.join(chunks, ["lead", "block"], "left").select("lead", "block", each, *row(HUB, F.col("hub")))
    coming = visitors.join(chunks, ["lead", "block"], "left").select("lead", "block", _dealt("key", 2, many).alias("chunk"), *row(VISITOR))
    found = checkpointed(verify(own.union(hubs).union(coming).join(sets, "key"), percent))
    links = found.where("a is not null").select("a", "b")
    if big.limit(1).count() == 0:
        return links

    marks = found.where("mask is not null").select("lead", "key", "visitor", "mask")
    counts = [F.struct(F.sum(F.col("mask").bitwiseAND(1 << i).cast("boolean").cast("long")).alias("size"), F.lit(i).alias("hub")) for i in range(HUBS)]
    main = _few(checkpointed(marks.where("not visitor").groupBy("lead").agg(F.array_max(F.array(*counts))["hub"].alias("main"))))
    held = F.expr("shiftright(mask, main)").bitwiseAND(1) == 1
    sized = marks.join(main, "lead").select("lead", "key", "visitor", held.alias("held")).join(members.select("key", "n"), "key")
    marked = checkpointed(sized)

    # those left of a group, and all others of it
    rest = marked.where("not held and not visitor")
    rest_size = rest.groupBy("lead").agg(F.count("*").alias("size"), F.sum("n").alias("grams"))
    rests = _few(checkpointed(rest_size.select("lead", _block_count(F.col("size"), F.col("grams"), LATER).alias("rests"))))
    facing = marked.join(rests, "lead")
    chunks = _chunks(facing, ["lead"])
    mine_left = _dealt("key", 3, F.col("rests"))
    hosts_left = rest.join(rests, "lead").join(chunks, "lead", "left").select("lead", mine_left.alias("at"), each, *row(MEMBER))
    # of two blocks of those left, one visits the other
    left_over = ~F.col("held") & ~F.col("visitor")
    steps = F.explode(F.when(left_over, F.sequence(F.lit(0), F.floor(F.col("rests") / 2).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("rests") - 1))).alias("step")
    at = F.when(left_over, (mine_left + F.col("step")) % F.col("rests")).otherwise(F.col("step")).alias("at")
    facing = facing.join(chunks, "lead", "left").select("*", steps).select("lead", at, _dealt("key", 4, many).alias("chunk"), *row(VISITOR))
    hosts_left, facing = (t.withColumn("block", -1 - F.col("at")) for t in (hosts_left, facing))
    # visitors left of a group, and the held members of its other blocks
    roaming = marked.where("not held and visitor").join(big, "lead")
    chunks = _chunks(roaming, ["lead"])
    sought = roaming.select("lead").distinct()
    hosts_main = marked.where("held and not visitor").join(sought, "lead", "left_semi").join(big, "lead").join(chunks, "lead", "left").select("lead", _dealt("key", 0, F.col("blocks")).alias("block"), each, *row(MEMBER))
    roaming = roaming.join(chunks, "lead", "left").select("lead", "key", _dealt("key", 1, F.col("blocks")).alias("seen"), _dealt("key", 5, many).alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    roaming = roaming.where("block != seen").select("lead", "block", "chunk", *row(VISITOR))
    columns = ["lead", "block", "chunk", "role", "hub", "key"]
    left = hosts_left.select(*columns).union(facing.select(*columns)).union(hosts_main.select(*columns)).union(roaming.select(*columns))
    return links.union(verify(left.join(sets, "key"), percent, among=False).select("a", "b"))


def _together(one: DataFrame, other: DataFrame) -> DataFrame:
    """Packed rows of two kinds, each with nulls for the other's columns."""
    return one.unionByName(other, allowMissingColumns=True)


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """key, id, n, tokens (packed, sorted) of each text whose set is among those wanted of its id."""

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        shingles = shingler(words)

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            out: dict[str, list] = {k: [] for k in ("key", "id", "n", "tokens")}
            for i, text, wanted in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                found = shingles(text.as_py() or b"")
                if (key := set_key(found)) in wanted:
                    for name, value in (("key", key), ("id", i), ("n", len(found)), ("tokens", pack("tokens", found))):
                        out[name].append(value)
            yield out

        return each

    kind = texts.schema["id"].dataType.simpleString()
    return map_batches(texts.select("id", "text", "wanted"), make, f"key long, id {kind}, n long, tokens binary")


def _hot(whole: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that are in very many sets, sorted, and in how many (as counted where they are hot).

    Their counts are each at least the HOT_SHARE-th part of all entries, so that there are no more than that.
    """

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            token, n = np.unique(np.concatenate([unpack("tokens", t) for t in batch.column("tokens").to_pylist()]), return_counts=True)
            yield {"token": token[n >= HOT].astype(np.int64), "n": n[n >= HOT]}

        return each

    total = whole.agg(F.sum("n")).first()[0] or 0
    counts = map_batches(whole.select("tokens"), make, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") * HOT_SHARE >= total)
    rows = counts.toArrow()
    token, n = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def _entries(whole: DataFrame, buckets: int, hot) -> DataFrame:
    """All n-grams of the sets, packed: tokens and keys by bucket of n-grams; the hot ones, with dfs, by bucket of keys."""

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            tokens = [unpack("tokens", t) for t in batch.column("tokens").to_pylist()]
            token = np.concatenate(tokens)
            key = np.repeat(batch.column("key").to_numpy(zero_copy_only=False).astype(np.uint64), [len(t) for t in tokens])
            names, counts = hot.value
            at = np.minimum(np.searchsorted(names, token), max(0, len(names) - 1))
            known = names[at] == token if len(names) else np.zeros(len(token), bool)
            parts = _split(_bucket(token[~known], buckets), {"tokens": token[~known], "keys": key[~known]})
            yield parts | {"dfs": [None] * len(parts["bucket"])}
            if known.any():
                yield _split(_bucket(key[known], buckets), {"tokens": token[known], "keys": key[known], "dfs": counts[at[known]]})

        return each

    return map_batches(whole.select("key", "tokens"), make, "bucket int, tokens binary, keys binary, dfs binary")
