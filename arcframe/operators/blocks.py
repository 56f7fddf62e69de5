"""File contents as blocks: cutting, zero runs, digests, deduplication, packing of tails, offsets, reads.

files have path, seq (their order) and content BINARY; blocks have path, seq, idx, size and data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed
from .order import join_counted, running_total, scan

#: Size words: this bit says that a block is stored as it is; 0 is a block of zeros.
RAW_BIT = 1 << 24


def split(files: DataFrame, block_size: int, tails: bool = True, content: str = "content") -> DataFrame:
    """Blocks of each file: path, seq, idx, size, data, first, last, tail.

    With tails, what is left of a file beyond whole blocks is marked as a tail; otherwise it is a short block.
    An empty file has no blocks.
    """
    length = F.octet_length(F.col(content)).cast("long")
    count = F.ceil(length / F.lit(block_size)).cast("int")
    rows = files.where(length > 0).select("path", "seq", F.col(content).alias("c"), length.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("idx"))
    at = F.col("idx").cast("long") * block_size
    data = F.expr(f"substring(c, cast(idx as int) * {block_size} + 1, {block_size})")
    size = F.least(F.lit(block_size).cast("long"), F.col("n") - at)
    last = at + block_size >= F.col("n")
    tail = last & (size < block_size) if tails else F.lit(False)
    return rows.select("path", "seq", F.col("idx").cast("long").alias("idx"), size.alias("size"), data.alias("data"), (F.col("idx") == 0).alias("first"), last.alias("last"), tail.alias("tail"))


def is_zero(data: Column) -> Column:
    """Whether a block holds nothing but zero bytes; an empty one does."""
    return F.hex(data).rlike("^0*+\\z")


def with_sparse(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("sparse", is_zero(F.col("data")))


def sparse_bytes(blocks: DataFrame) -> DataFrame:
    """path and sparse_bytes: what each file's blocks of zeros save."""
    return with_sparse(blocks).groupBy("path").agg(F.sum(F.when(F.col("sparse"), F.col("size")).otherwise(0)).alias("sparse_bytes"))


def with_digest(blocks: DataFrame) -> DataFrame:
    """blocks with the SHA-256 of their bytes: blocks of the same size and digest are taken as equal, so that no bytes are compared."""
    return blocks.withColumn("digest", F.sha2("data", 256))


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """digest, size, the first (seq, idx) of each different block and its uses. Minima are combined before the shuffle."""
    first = F.min(F.struct("seq", "idx"))
    return with_digest(blocks).groupBy("digest", "size").agg(first.alias("first"), F.count("*").alias("uses")).select("digest", "size", F.col("first.seq").alias("first_seq"), F.col("first.idx").alias("first_idx"), "uses")


def duplicate_files(files: DataFrame, content: str = "content") -> DataFrame:
    """path, seq and duplicate_of: for each file the first with the same bytes, null if that is itself.

    Files of the same size and SHA-256 are taken as equal; bytes are not compared. Empty files have no blocks
    and are no duplicates.
    """
    rows = files.where(F.octet_length(content) > 0).select("path", "seq", F.octet_length(content).alias("size"), F.sha2(F.col(content), 256).alias("digest"))
    first = rows.groupBy("size", "digest").agg(F.min(F.struct("seq", "path")).alias("first"), F.count("*").alias("files"))
    return join_counted(rows, first, ["size", "digest"], "files").select("path", "seq", F.when(F.col("seq") != F.col("first.seq"), F.col("first.path")).alias("duplicate_of"))


def duplicate_runs(blocks: DataFrame) -> DataFrame:
    """path and start: where in the list of stored blocks each file's run of blocks is first found.

    The exact rule of the writer: stored blocks stand in one list in the order of files; a file whose run of
    (size, digest) occurs there before is not stored again and starts at that place, which may lie inside
    another file's run. Blocks of zeros aren't in the list.

    A file none of whose blocks occurs a second time can neither be found nor hold what is found: only its
    number of blocks matters, which a running total adds up. The others, those with a repeated block, are
    looked at one after another by an ordered scan over words.
    """
    words = with_digest(with_sparse(blocks)).where("not sparse").select("path", "seq", "idx", F.concat_ws(":", F.col("size").cast("string"), "digest").alias("word"))
    uses = words.groupBy("word").agg(F.count("*").alias("uses")).where("uses > 1")
    marked = join_counted(words, uses, ["word"], "uses", "left")
    held = F.sort_array(F.collect_list(F.struct("idx", "word")))
    files = checkpointed(marked.groupBy("path", "seq").agg(F.count("*").alias("blocks"), F.max(F.col("uses").isNotNull()).alias("repeated")))
    some = files.where("repeated").select("path", "seq", F.lit(True).alias("repeated"))
    runs = words.join(some, ["path", "seq"]).groupBy("path", "seq").agg(held.alias("run"))
    # of each file with repeated blocks: the blocks of plain files before it
    plain = running_total(files.withColumn("plain", F.when(F.col("repeated"), 0).otherwise(F.col("blocks"))), "seq", "plain", "before")
    rows = runs.join(plain.where("repeated").select("path", "seq", "before"), ["path", "seq"]).select(F.lit(0).alias("image"), "seq", "path", "before", F.transform("run", lambda x: x["word"]).alias("run"))

    def step() -> Callable[[dict | None], list[dict]]:
        stored: dict[int, str] = {}  # words by their place, without those of plain files
        places: dict[str, list[int]] = {}
        kept = 0

        def take(row: dict | None) -> list[dict]:
            nonlocal kept
            if row is None:
                return []
            run, start = row["run"], row["before"] + kept
            # the run may overlap itself: what lies from its start on is its own
            fits = lambda at: all((stored.get(at + j) if at + j < start else run[at + j - start]) == word for j, word in enumerate(run))
            at = next((i for i in places.get(run[0], ()) if fits(i)), start)
            fresh = max(0, at + len(run) - start)
            for j in range(len(run) - fresh, len(run)):
                place = at + j
                stored[place] = run[j]
                places.setdefault(run[j], []).append(place)
            kept += fresh
            return [{"path": row["path"], "seq": row["seq"], "start": at, "blocks": len(run), "duplicate": at < start, "fresh": fresh}]

        return take

    found = checkpointed(scan(rows, "image", ["seq"], step, "path string, seq long, start long, blocks long, duplicate boolean, fresh long"))
    others = files.where("not repeated").select("path", "seq", "blocks", F.col("blocks").alias("fresh"), F.lit(None).cast("long").alias("found"), F.lit(False).alias("duplicate"))
    every = others.unionByName(found.select("path", "seq", "blocks", "fresh", F.col("start").alias("found"), "duplicate"))
    return running_total(every, "seq", "fresh", "total").select("path", "seq", F.coalesce("found", "total").alias("start"), "blocks", "duplicate")


def tails(blocks: DataFrame) -> DataFrame:
    """The tails that go into fragment blocks: those that aren't all zeros."""
    return with_sparse(blocks).where("tail and not sparse")


def distinct_tails(blocks: DataFrame) -> DataFrame:
    """Each tail with first_seq, the first file whose tail has the same size and SHA-256."""
    rows = with_digest(tails(blocks)).select("path", "seq", "size", "digest")
    first = rows.groupBy("size", "digest").agg(F.min("seq").alias("first_seq"), F.count("*").alias("uses"))
    return join_counted(rows, first, ["size", "digest"], "uses").select("path", "seq", "size", "digest", "first_seq")


def _closings(sizes: np.ndarray, block_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a run of tails: their ends; and, for a block that starts at each of them, the tail that starts the next
    one, the bytes that are used in the last block of the run, and the blocks that are started from there on."""
    n = len(sizes)
    ends = np.r_[0, np.cumsum(sizes)]
    following = np.maximum(np.searchsorted(ends, ends[:-1] + block_size, "right") - 1, np.arange(n) + 1)
    used, count = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        j = following[i]
        used[i], count[i] = (ends[n] - ends[i], 1) if j == n else (used[j], 1 + count[j])
    return ends, following, used, count


def pack_tails(blocks: DataFrame, block_size: int) -> DataFrame:
    """path, seq, fragment and fragment_offset: where each tail lies.

    Tails of different bytes, in the order of files, go into the open fragment block; one that doesn't fit
    closes it and opens the next. What a range of tails does depends on the ranges before it only by the
    bytes used in the open block: each range says how it ends for every such number, a few steps, the steps
    of all ranges are put together, and each range then places its own tails.
    """
    return place_tails(checkpointed(distinct_tails(blocks)), block_size)


def place_tails(all_tails: DataFrame, block_size: int) -> DataFrame:
    """As ``pack_tails``, from tails (path, seq, size, first_seq) that are already told apart."""
    kept = all_tails.where(F.col("seq") == F.col("first_seq")).select("seq", "size")
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = checkpointed(kept.repartitionByRange(parts, "seq").sortWithinPartitions("seq").select("seq", "size", F.spark_partition_id().alias("part")))
    steps_schema = pa.schema([("part", pa.int32()), ("up_to", pa.int64()), ("used", pa.int64()), ("adds", pa.int64()), ("opens", pa.int64())])

    def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
        got = [b for b in batches if b.num_rows]
        return pa.Table.from_batches(got) if got else None

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entered with up_to bytes used at most, and more than the step before says: how the range ends."""
        if (table := whole(batches)) is None:
            return
        ends, _, used, count = _closings(table["size"].to_numpy(), block_size)
        n, out = len(ends) - 1, []
        # with up to block_size - ends[i] bytes used, i tails still fit
        for i in range(n, -1, -1):
            if ends[i] <= block_size:
                adds = int(ends[n]) if i == n else None
                row = (block_size - int(ends[i]), None if i == n else int(used[i]), adds, 0 if i == n else int(count[i]))
                if out and out[-1][1:] == row[1:]:
                    out[-1] = row
                else:
                    out.append(row)
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([[table["part"][0].as_py()] * len(out), *columns], steps_schema, strict=True)], schema=steps_schema)

    known: dict[int, list] = {}
    for r in ranges.mapInArrow(steps, "part int, up_to long, used long, adds long, opens long").collect():  # some rows a range
        known.setdefault(r.part, []).append(r)
    entered, used, opened = {}, block_size, 0
    for part in sorted(known):
        entered[part] = (used, opened)
        r = min((r for r in known[part] if r.up_to >= used), key=lambda r: r.up_to)
        used, opened = (used + r.adds if r.used is None else r.used), opened + r.opens

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := whole(batches)) is None:
            return
        used, opened = entered[table["part"][0].as_py()]
        ends, following, *_ = _closings(table["size"].to_numpy(), block_size)
        n = len(ends) - 1
        first = int(np.searchsorted(ends, block_size - used, "right")) - 1  # so many still fit into the open block
        starts = []
        i = first
        while i < n:
            starts.append(i)
            i = int(following[i])
        begun = np.zeros(n, np.int64)
        begun[starts] = 1
        number = opened - 1 + np.cumsum(begun)
        base = np.where(np.arange(n) < first, -used, ends[np.array([0, *starts], np.int64)][np.minimum(np.cumsum(begun), len(starts))])
        yield pa.RecordBatch.from_arrays([table["seq"].combine_chunks(), pa.array(number), pa.array(ends[:-1] - base)], ["kept_seq", "fragment", "fragment_offset"])

    places = ranges.mapInArrow(place, "kept_seq long, fragment long, fragment_offset long")
    counted = all_tails.groupBy("first_seq").agg(F.count("*").alias("uses"))
    placed = places.join(counted, F.col("kept_seq") == F.col("first_seq")).drop("kept_seq")
    return join_counted(all_tails, checkpointed(placed), ["first_seq"], "uses").select("path", "seq", "size", "fragment", "fragment_offset")


def fragment_blocks(blocks: DataFrame, block_size: int) -> DataFrame:
    """fragment and data: the bytes of each fragment block."""
    placed = pack_tails(blocks, block_size)
    data = tails(blocks).select("seq", "data")
    once = placed.join(data, "seq").groupBy("fragment", "fragment_offset").agg(F.min(F.struct("seq", "data")).alias("one"))
    joined = once.groupBy("fragment").agg(F.sort_array(F.collect_list(F.struct("fragment_offset", F.hex("one.data").alias("text")))).alias("parts"))
    return joined.select("fragment", F.unhex(F.array_join(F.transform("parts", lambda x: x["text"]), "")).alias("data"))


def offsets(blocks: DataFrame, stored: str = "stored") -> DataFrame:
    """blocks with at: the place of each from the file's first block on, by the stored sizes before it."""
    before = Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("at", F.coalesce(F.sum(stored).over(before), F.lit(0)).cast("long"))


def submit(blocks: DataFrame, extra: DataFrame) -> DataFrame:
    """blocks and those of a caller's own (path, seq, idx, data and any of dont_compress, dont_fragment, user), which go
    through the same steps; columns that one side lacks are null."""
    sized = extra.withColumn("size", F.octet_length("data").cast("long")) if "size" not in extra.columns else extra
    return blocks.unionByName(sized, allowMissingColumns=True)


def sequenced(blocks: DataFrame, stored: str = "stored", start: int = 0) -> DataFrame:
    """blocks with written_at: where each lies in the output if they leave in the order of files and blocks.

    However the tasks that made them finished: places are running totals of the stored sizes over one order.
    """
    ordered = blocks.withColumn("io order", F.struct("seq", "idx"))
    return running_total(ordered, "io order", stored, "written_at").withColumn("written_at", F.col("written_at") + start).drop("io order")


def size_word(stored: Column, compressed: Column) -> Column:
    """The size word of a block: 0 if it is sparse, with the raw bit unless it is compressed."""
    return F.when(stored == 0, 0).when(compressed, stored).otherwise(stored.bitwiseOR(RAW_BIT)).cast("long")


def read_ranges(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (path, offset, length) with data: the bytes there, fewer at the end of a file, none beyond it.

    Each request has a row, equal ones too. blocks need at, the offset of each in its file. Only the blocks
    that a range touches are joined to it.
    """
    asked = wanted.groupBy("path", "offset", "length").agg(F.count("*").alias("asks"))
    start, end = F.greatest(F.col("offset"), F.col("at")), F.least(F.col("offset") + F.col("length"), F.col("at") + F.col("size"))
    part = F.expr("substring(data, cast(greatest(offset, at) - at + 1 as int), cast(least(offset + length, at + size) - greatest(offset, at) as int))")
    hit = asked.join(blocks.select(F.col("path").alias("p"), "at", "size", "data"), (F.col("path") == F.col("p")) & (F.col("at") < F.col("offset") + F.col("length")) & (F.col("at") + F.col("size") > F.col("offset")), "left")
    pieces = hit.groupBy("path", "offset", "length", "asks").agg(F.sort_array(F.collect_set(F.when(end > start, F.struct("at", F.hex(part).alias("text"))))).alias("parts"))
    again = pieces.withColumn("ask", F.explode(F.sequence(F.lit(1), F.col("asks").cast("int"))))
    return again.select("path", "offset", "length", F.unhex(F.array_join(F.transform("parts", lambda x: x["text"]), "")).alias("data"))


def join_blocks(blocks: DataFrame) -> DataFrame:
    """path and content: the bytes of each file, its blocks in order."""
    joined = blocks.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("idx", F.hex("data").alias("text")))).alias("parts"))
    return joined.select("path", F.unhex(F.array_join(F.transform("parts", lambda x: x["text"]), "")).alias("content"))


def pack_statistics(files: DataFrame, block_size: int, content: str = "content") -> DataFrame:
    """One row of counts for packing files without compression.

    bytes_read; bytes_written (blocks of files stored once, and fragment blocks); ratio, 100 * written / read
    in whole numbers; data_blocks, fragment_blocks, sparse_blocks; duplicate_blocks (those of files that are
    duplicates); fragments and duplicate_fragments.
    """
    pieces = with_sparse(split(files, block_size, content=content))
    whole = pieces.where("not tail").join(duplicate_files(files, content).select("path", F.col("duplicate_of").isNotNull().alias("copy")), "path")
    tail_rows = distinct_tails(pieces)
    placed = pack_tails(pieces, block_size)
    a = files.agg(F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).cast("long").alias("bytes_read"))
    b = whole.agg(
        F.coalesce(F.sum(F.when(~F.col("copy") & ~F.col("sparse"), F.col("size"))), F.lit(0)).cast("long").alias("block_bytes"),
        F.count_if(~F.col("sparse")).alias("data_blocks"),
        F.count_if(~F.col("sparse") & F.col("copy")).alias("duplicate_blocks"),
    )
    c = pieces.agg(F.count_if("sparse").alias("sparse_blocks"))
    d = tail_rows.agg(
        F.count("*").alias("fragments"), F.count_if(F.col("seq") != F.col("first_seq")).alias("duplicate_fragments"), F.coalesce(F.sum(F.when(F.col("seq") == F.col("first_seq"), F.col("size"))), F.lit(0)).cast("long").alias("tail_bytes")
    )
    e = placed.agg(F.countDistinct("fragment").alias("fragment_blocks"))
    one = a
    for part in (b, c, d, e):  # of one row each
        one = one.join(F.broadcast(part), F.lit(True))
    written = F.col("block_bytes") + F.col("tail_bytes")
    return one.select(
        "bytes_read", written.alias("bytes_written"), F.when(F.col("bytes_read") > 0, F.floor(written * 100 / F.col("bytes_read"))).otherwise(100).cast("long").alias("ratio"),
        "data_blocks", "fragment_blocks", "sparse_blocks", "duplicate_blocks", "fragments", "duplicate_fragments",
    )
