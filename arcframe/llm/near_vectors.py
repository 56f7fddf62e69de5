"""Near-duplicate embeddings by collision-counting projections.

Vectors are put on many random lines. On a line, two vectors that make an angle lie within a window whose
chance is known; a pair that lies in each other's window on enough lines is verified by its cosine. How
many lines are enough, and how wide a window is, follow from the recall that is asked for.

Not all pairs are counted: a few more lines, cut into cells, deal the vectors into blocks, several times
over with other lines, and pairs are counted in the first block that they meet in. The number of lines that
make a cell follows from the number of vectors, so that a cell holds a bounded number of unrelated ones.

Collisions are counted on sketches, the places on the lines in a byte each: in a cell, sketches are sorted on
one line, and windows are centred on each of them in turn. Vectors themselves go only to the cells where a
sketch has a partner with enough collisions, which for most is none.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import checkpointed, map_batches, shuffle_partitions
from .components import components

#: Lines that windows are counted on, those that are counted for all pairs, and the share of them whose windows hold a pair at the threshold.
LINES, FIRST_LINES, WINDOW = 24, 16, 0.9
#: Width of a cell in units of the lines; unrelated vectors in a cell that are aimed at; sample that sets the lines of a cell.
CELL, CROWD, SAMPLE = 1.5, 200, 1024
#: Vectors of a block in verification: at least BLOCK, and GROWTH times the root of a cell's size, so that a
#: crowded cell's rows grow with the power 1.5 of its size. Rows compared at a time.
BLOCK, GROWTH, ROWS = 2048, 8, 256
#: The same for vectors that have a partner: they are larger than sketches, and fewer.
LINK_BLOCK = 256
#: Lines are added to a cell while so many tables reach the recall asked for, and up to so many; beyond that cells
#: grow with the vectors, and what gives way is not the recall but the time.
MOST_TABLES, MOST_LINES = 64, 40
#: Width of a step of a sketch, whose places go from -127 to 127; those beyond are put at the ends.
STEP = 4.5 / 127
#: A table of crowded cells up to this many rows, 3 MB, is broadcast.
BROADCAST_ROWS = 100_000


def _phi(x):
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def same_cell(distance: float, width: float) -> float:
    """Chance that two points at a distance fall into the same cell of a random line, cut at a random offset."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return 2 * _phi(r) - 1 - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


@functools.lru_cache(maxsize=16)
def _directions(seed: int, dimension: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions of so many random lines as columns, and where each is cut."""
    rng = np.random.default_rng([seed, dimension])
    return rng.standard_normal((count, dimension)).T, rng.random(count) * CELL


@dataclass(frozen=True)
class Plan:
    """Dimension, threshold and seed; tables and lines of a cell; half-width of windows, collisions asked for."""

    dimension: int
    threshold: float
    seed: int
    tables: int
    lines: int
    window: float
    least: int

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """A number for the cell of each vector in each table."""
        lines, offsets = _directions(self.seed, self.dimension, self.tables * self.lines)
        at = np.floor((unit @ lines + offsets) / CELL).astype(np.int64).view(np.uint64).reshape(len(unit), self.tables, self.lines)
        key = np.full((len(unit), self.tables), np.uint64(self.dimension)) + np.arange(self.tables, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
        for i in range(self.lines):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + at[:, :, i]
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        return (key ^ (key >> np.uint64(33))).view(np.int64)

    def projections(self, unit: np.ndarray) -> np.ndarray:
        return unit @ _directions(self.seed + 1, self.dimension, LINES)[0]

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(self.projections(unit) / STEP), -127, 127).astype(np.int8)

    def recall(self) -> float:
        """Share of the pairs at the threshold that are found, by the formulas that the plan comes from."""
        near = math.sqrt(max(0.0, 2 - 2 * self.threshold))
        inside = 2 * _phi(self.window / near) - 1 if near else 1.0
        counted = sum(math.comb(LINES, k) * inside**k * (1 - inside) ** (LINES - k) for k in range(self.least, LINES + 1))
        return (1 - (1 - same_cell(near, CELL) ** self.lines) ** self.tables) * counted


def calibrate(n: int, dimension: int, threshold: float, distances: np.ndarray, recall: float = 0.998, seed: int = 17) -> Plan:
    """The plan for n vectors whose pairs lie at distances (a sample of them).

    Lines of a cell: as few as leave CROWD unrelated vectors in it, but no more than MOST_TABLES tables make
    up for; beyond that cells grow with the vectors, and not the recall but the time gives way. Tables: as many
    as let a pair at the threshold meet with the recall asked for. Collisions: as many as such a pair reaches but for a tenth of
    what is left of the recall. Closer pairs do better on all three.
    """
    near = math.sqrt(max(0.0, 2 - 2 * threshold))
    far = distances[distances > 2 * near]

    def needed(lines: int) -> int:
        meet = same_cell(near, CELL) ** lines
        return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1

    lines = 1
    while lines < MOST_LINES and needed(lines + 1) <= MOST_TABLES and len(far) and n * np.mean([same_cell(d, CELL) ** lines for d in np.quantile(far, np.linspace(0, 1, 33))]) > CROWD:
        lines += 1
    tables = needed(lines)
    window = near * next(z / 1000 for z in range(1, 5000) if 2 * _phi(z / 1000) - 1 >= WINDOW)
    least, missed = 0, 0.0
    while least < LINES:
        missed += math.comb(LINES, least) * WINDOW**least * (1 - WINDOW) ** (LINES - least)
        if missed > (1 - recall) / 10:
            break
        least += 1
    plan = Plan(dimension, threshold, seed, tables, lines, window, least)
    if plan.recall() < 1 - 1.25 * (1 - recall):  # a tenth of what is left of the recall goes to the count
        raise ValueError(f"a recall of {recall} isn't reached: {plan}")
    return plan


def packed_vectors(column: pa.Array, form: str) -> list[bytes | None]:
    """The components of each vector as bytes, None where it links with nothing: null, empty, zero or not finite."""
    values = column.values.to_numpy(zero_copy_only=False).astype(form)  # null components turn into nan
    ends, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for i in range(len(column)):
        v = values[ends[i] : ends[i + 1]] if valid[i] else values[:0]
        out.append((v + 0.0).tobytes() if v.any() and np.isfinite(v).all() else None)
    return out


def unit_vectors(values: list[bytes], form: str) -> np.ndarray:
    """Vectors of one dimension in double precision, each of length one."""
    v = np.frombuffer(b"".join(values), form).reshape(len(values), -1).astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # very large and very small components keep their direction
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _vectors(rows: DataFrame, form: str) -> DataFrame:
    """id, h1, h2, vector (packed), dimension; the last four null where a row's vector links with nothing."""
    kind = rows.schema["id"].dataType.simpleString()
    width = np.dtype(form).itemsize

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            packed = packed_vectors(batch.column(1), form)
            hashes = [(None, None) if v is None else (xxhash.xxh64_intdigest(v, 1) >> 1, xxhash.xxh64_intdigest(v, 2) >> 1) for v in packed]
            yield {"id": batch.column(0), "h1": [a for a, _ in hashes], "h2": [b for _, b in hashes], "vector": packed, "dimension": [None if v is None else len(v) // width for v in packed]}

        return each

    return map_batches(rows, make, f"id {kind}, h1 long, h2 long, vector binary, dimension int")


def plans(vectors: DataFrame, form: str, threshold: float, recall: float) -> dict[int, Plan]:
    """A plan for each dimension, from the counts and the distances inside a bounded sample."""
    out = {}
    for r in vectors.groupBy("dimension").agg(F.count("*").alias("n")).collect():
        drawn = vectors.where(F.col("dimension") == r.dimension).orderBy("h1", "h2").limit(SAMPLE).select("vector").collect()
        x = unit_vectors([bytes(s.vector) for s in drawn], form)
        distances = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T)))[np.triu_indices(len(x), 1)]
        out[r.dimension] = calibrate(r.n, r.dimension, threshold, distances, recall)
    return out


def _cells(vectors: DataFrame, form: str, plan_of: dict[int, Plan], with_sketches: bool) -> DataFrame:
    """cell and tab of each vector in each table, with h1, h2, dimension and sketch if asked for."""

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            packed, dimensions = (batch.column(c).to_pylist() for c in ("vector", "dimension"))
            for dimension in set(dimensions):
                at = np.flatnonzero(np.array(dimensions) == dimension)
                plan = plan_of[dimension]
                unit = unit_vectors([packed[i] for i in at], form)
                cells = plan.cells(unit)
                mine = batch.take(pa.array(at))
                more = {c: mine.column(c) for c in ("h1", "h2", "dimension")} | {"sketch": [row.tobytes() for row in plan.sketches(unit)]} if with_sketches else {}
                for table in range(plan.tables):
                    yield {"cell": cells[:, table], "tab": [table] * len(at)} | more

        return each

    return map_batches(vectors.select("h1", "h2", "dimension", "vector"), make, "cell long, tab int" + ", h1 long, h2 long, dimension int, sketch binary" * with_sketches)


def colliding(place: np.ndarray, window: float, reach: float, least: int, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of left and right (or within, if same) whose places are within window on at least so many lines.

    place has a row for each vector. Both sides are sorted on the first line, so that a row is only held against
    those within reach of it there.
    """
    left, right = left[np.argsort(place[left, 0], kind="stable")], right[np.argsort(place[right, 0], kind="stable")]
    line = place[right, 0]
    for start in range(0, len(left), ROWS):
        rows = left[start : start + ROWS]
        lo, hi = np.searchsorted(line, place[rows[0], 0] - reach), np.searchsorted(line, place[rows[-1], 0] + reach, "right")
        columns = right[lo:hi]
        if not len(columns):
            continue
        count = np.zeros((len(rows), len(columns)), np.uint8)
        for i in range(FIRST_LINES):
            count += np.abs(place[rows, i][:, None] - place[columns, i][None, :]) <= window
        # the other lines are looked at where they can still make up for what lacks
        a, b = np.nonzero(count + (LINES - FIRST_LINES) >= least)
        total = count[a, b] + (np.abs(place[rows[a], FIRST_LINES:] - place[columns[b], FIRST_LINES:]) <= window).sum(1)
        a, b = rows[a[total >= least]], columns[b[total >= least]]
        if same:
            a, b = a[a < b], b[a < b]
        if len(a):
            yield a, b


def _reach(threshold: float) -> float:
    """Beyond what a pair is apart on any one line."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) * 4.5


def with_partner(plan: Plan, sketches: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
    """Which vectors have one with enough collisions on the other side, by their sketches: never fewer than by their places."""
    place, out = sketches.astype(np.int16), np.zeros(len(sketches), bool)
    # two places that are rounded each can be one step nearer or farther
    for a, b in colliding(place, math.floor(plan.window / STEP) + 1, math.ceil(_reach(plan.threshold) / STEP) + 1, plan.least, left, right, same):
        out[a] = out[b] = True
    return out


def block_links(plan: Plan, table: int, unit: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of links between left and right (or within, if same) that first meet in this table."""
    cells, found = None, []
    for a, b in colliding(plan.projections(unit), plan.window, _reach(plan.threshold), plan.least, left, right, same):
        # exact check, in pieces: the same sum whichever block a pair meets in
        close = np.concatenate([np.einsum("ij,ij->i", unit[a[k : k + 65536]], unit[b[k : k + 65536]]) >= plan.threshold for k in range(0, len(a), 65536)])
        a, b = a[close], b[close]
        cells = plan.cells(unit) if cells is None else cells
        new = np.ones(len(a), bool)
        for t in range(table):
            new &= cells[a, t] != cells[b, t]
        found.append((a[new], b[new]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest index that each of n is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _by_block(blocks: DataFrame, each: Callable[[tuple, list], list | None], schema: str) -> DataFrame:
    """each((cell, tab, i, j), its other columns) of every block, whose rows come one after another."""
    struct = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and (columns := each(now, list(zip(*held, strict=True)))):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for cell, table, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cell, table, i, j) != now:
                    yield from finish()
                    now, held = (cell, table, i, j), []
                held.append(row)
        yield from finish()

    keys = ["cell", "tab", "i", "j"]
    others = [c for c in blocks.columns if c not in keys]
    dealt = blocks.select(*keys, *others).repartition(shuffle_partitions(blocks.sparkSession), *keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, struct)


def marked(blocks: DataFrame, plan_of: dict[int, Plan]) -> DataFrame:
    """cell, tab, h1, h2 of the vectors that have a partner in their cell, by sketches."""

    def each(key: tuple, columns: list) -> list | None:
        cell, table, i, j = key
        side, h1, h2, dimension, sketches = columns
        side, every = np.array(side), np.arange(len(side))
        place = np.frombuffer(b"".join(sketches), np.int8).reshape(len(side), LINES)
        some = np.flatnonzero(with_partner(plan_of[dimension[0]], place, every[side == i], every[side == j], i == j))
        return [[cell] * len(some), [table] * len(some), np.array(h1)[some], np.array(h2)[some]] if len(some) else None

    return _by_block(blocks.select("cell", "tab", "i", "j", "block", "h1", "h2", "dimension", "sketch"), each, "cell long, tab int, h1 long, h2 long")


def link_counts(blocks: DataFrame, form: str, plan_of: dict[int, Plan]) -> DataFrame:
    """h1, h2, n (weight of the vectors linked with it, in this block), other (h1 of one it is connected with here)."""

    def each(key: tuple, columns: list) -> list | None:
        _, table, i, j = key
        side, h1, h2, weights, dimension, vectors = columns
        side, h1, h2, weights = (np.array(c) for c in (side, h1, h2, weights))
        n, every = len(side), np.arange(len(side))
        # vectors of other dimensions have other cells
        a, b = block_links(plan_of[dimension[0]], table, unit_vectors(list(vectors), form), every[side == i], every[side == j], i == j)
        if not len(a):
            return None
        total = np.bincount(a, weights[b], n) + np.bincount(b, weights[a], n)
        label = _labels(n, a, b)
        some = np.flatnonzero(total)
        return [h1[some], h2[some], total[some].astype(np.int64), h1[label[some]]]

    return _by_block(blocks.select("cell", "tab", "i", "j", "block", "h1", "h2", "weight", "dimension", "vector"), each, "h1 long, h2 long, n long, other long")


def _in_blocks(rows: DataFrame, counted: DataFrame, least: int) -> DataFrame:
    """rows (cell, tab, h1 and more) with block, and the pairs of blocks i, j of its cell that each meets in.

    A cell of at most so many rows, as counted (cell, tab) says, is one block; each block of a crowded one meets itself and all others.
    """
    crowded = checkpointed(counted.groupBy("cell", "tab").agg(F.count("*").alias("size")).where(F.col("size") > least))
    # sent to all tasks if it is small; else joined by shuffles
    sizes = F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded
    blocks = F.coalesce(F.ceil(F.col("size") / F.greatest(F.lit(least), F.ceil(GROWTH * F.sqrt("size")))), F.lit(1)).cast("int")
    cut = rows.join(sizes, ["cell", "tab"], "left").withColumn("blocks", blocks)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int"))
    met = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("with", "blocks", "size")


def near_vectors(rows: DataFrame, threshold: float = 0.95, recall: float = 0.998, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links of cosine threshold or more between vectors, their counts and components.

    Returns id_col, n_links (other rows linked directly), component_id (the smallest id reachable by links)
    and kept (whether that is the row's own), one row for each input row. No pair below the threshold is
    linked; a pair at it is found with the recall asked for, closer ones more surely, equal vectors always.
    A vector that is null, empty or zero or holds a null or non-finite component links with nothing, as do
    vectors of different lengths among each other and rows without an id, whose component is null and which
    are kept. Repeated ids are rows of their own. An empty table gives no rows; other columns are left out.
    """
    single = rows.schema[vector_col].dataType.simpleString() == "array<float>"
    form = "<f4" if single else "<f8"
    column = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    units = checkpointed(_vectors(rows.select(F.col(id_col).alias("id"), column.alias("vector")), form))
    linkable = units.where("id is not null and vector is not null")
    # equal vectors are one from here on, with a weight
    vectors = checkpointed(linkable.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector"), F.first("dimension").alias("dimension")))
    plan_of = plans(vectors, form, threshold, recall)
    cells = _in_blocks(_cells(vectors, form, plan_of, True), _cells(vectors, form, plan_of, False), BLOCK)
    some = checkpointed(marked(cells, plan_of).distinct())
    meeting = some.join(vectors.select("h1", "h2", "weight", "dimension", "vector"), ["h1", "h2"])
    found = checkpointed(link_counts(_in_blocks(meeting, some, LINK_BLOCK), form, plan_of))

    counts = found.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    reached = components(found.select(F.col("h1").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "h1")
    linked = checkpointed(vectors.select("h1", "h2", "id", "weight").join(counts, ["h1", "h2"], "left").join(reached, "h1", "left"))
    lowest = linked.where("component is not null").groupBy("component").agg(F.min("id").alias("lowest"))
    named = linked.join(lowest, "component", "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("lowest", "id").alias("lowest"))
    joined = units.select("id", "h1", "h2").join(named, ["h1", "h2"], "left")
    known = F.col("id").isNotNull()
    component = F.when(known, F.coalesce("lowest", "id"))
    return joined.select(
        F.col("id").alias(id_col),
        F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
