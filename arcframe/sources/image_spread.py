"""Images put together by all tasks: every piece's place is a running total, and each task writes its own pieces there.

An inode holds the place of a directory's listing and a listing those of inodes, both behind compressed blocks. The
knot is cut where directories are few beside what they hold: blocks of the inode table in which a directory lies are
stored as they are, so that their length is known before their bytes. A listing starts a run at every 256th entry at
least, and its index names these, so that the length of an inode doesn't follow from how the runs fall.
"""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import modes, paths
from ..functions.codecs import IDS, Codec
from ..operators import attributes, blocks, links, tree
from ..operators.order import join_counted, numbered, running_total
from ..session import checkpointed
from . import image as im
from .files import pour

PIECES = "at long, data binary"


def _map(rows: DataFrame, work: Callable[[Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows through a function of a partition's rows one after another, some out at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for start in range(0, batch.num_rows, 512) for row in batch.slice(start, 512).to_pylist())
        out: list[tuple] = []
        size = 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        for row in work(each):
            out.append(row)
            size += sum(len(v) for v in row if isinstance(v, bytes))
            if len(out) >= 4096 or size > 1 << 22:
                yield pack()
                out, size = [], 0
        if out:
            yield pack()

    return rows.mapInArrow(run, schema)


def _total(rows: DataFrame, value: Column) -> int:
    return rows.agg(F.coalesce(F.sum(value), F.lit(0)).cast("long")).first()[0]


def _cut(pieces: DataFrame, size: int = im.META) -> DataFrame:
    """block and parts (off, data): pieces (at, data) of a stream of bytes, by the metadata blocks that they lie in."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        begin, held = 0, bytearray()
        for row in rows:
            if row["at"] != begin + len(held):
                if held:
                    yield begin // size, begin % size, bytes(held)
                begin, held = row["at"], bytearray()
            held += row["data"]
            while begin % size + len(held) >= size:
                n = size - begin % size
                yield begin // size, begin % size, bytes(held[:n])
                begin += n
                del held[:n]
        if held:
            yield begin // size, begin % size, bytes(held)

    ordered = pieces.select("at", "data").repartitionByRange(parts, "at").sortWithinPartitions("at")
    return _map(ordered, run, "block long, off int, data binary").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("off", "data"))).alias("parts"))


def _compressed(grouped: DataFrame, codec: Codec) -> DataFrame:
    """block and data: metadata blocks with their heads."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            one = im.MetaWriter(codec)
            one.write(b"".join(p["data"] for p in row["parts"]))
            yield row["block"], one.finish()

    return checkpointed(_map(grouped, run, "block long, data binary"))


def _started(sizes: DataFrame) -> DataFrame:
    """block and start from block and n: where each lies behind those before it."""
    return checkpointed(running_total(sizes, "block", "n", "start").select("block", "n", "start"))


def _table(pieces: DataFrame, codec: Codec, path: str, at: int) -> tuple[int, int]:
    """Writes a lookup table at a place; where its list stands, and its end."""
    packed = _compressed(_cut(pieces), codec)
    starts = _started(packed.select("block", F.octet_length("data").cast("long").alias("n")))
    pour(packed.join(starts, "block").select((F.col("start") + at).alias("at"), "data"), path)
    rows = starts.orderBy("block").collect()  # 8 bytes for each 8192 of the table
    here = at + sum(r.n for r in rows)
    with open(path, "r+b") as file:
        file.seek(here)
        file.write(struct.pack(f"<{len(rows)}Q", *[at + r.start for r in rows]))
    return here, here + 8 * len(rows)


def _column(rows: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)


# --- data ---------------------------------------------------------------------------------------------------------------


def _place_data(ready: DataFrame, order: list[Column], path: str, codec: Codec, begin: int) -> tuple[DataFrame, DataFrame, int]:
    """Writes blocks and fragment blocks; row id, start, fragment and offset of the files, the fragment table, and the end.

    Files are stored in their order, equal ones and equal tails once, then the fragment blocks.
    """
    hard = F.coalesce(F.col("hard_link"), F.lit(False)) if "hard_link" in ready.columns else F.lit(False)
    files = ready.where(modes.is_type(F.col("mode"), modes.FILE) & ~hard)
    narrow = files.select("path", "row id", *[c.alias(f"order {i}") for i, c in enumerate(order)], "digest", F.octet_length("stored").cast("long").alias("n"), "tail_digest", F.octet_length("tail").cast("long").alias("tail_size"))
    placed = checkpointed(numbered(narrow, [F.col(f"order {i}") for i in range(len(order))], "spot", 0).select("path", "row id", "spot", "digest", "n", "tail_digest", "tail_size"))

    stored = placed.where("digest is not null")
    first = stored.groupBy("digest").agg(F.min_by(F.struct("spot", "row id", "n"), "spot").alias("f"), F.count("*").alias("uses")).select("digest", "uses", "f.spot", F.col("f.row id").alias("first id"), "f.n")
    kept = checkpointed(running_total(first, "spot", "n", "start"))
    end = begin + _total(kept, F.col("n"))
    starts = join_counted(stored.select("row id", "digest"), kept.select("digest", "uses", (F.col("start") + begin).alias("start")), ["digest"], "uses").select("row id", "start")
    pour(files.select("row id", F.col("stored").alias("data")).join(kept.select(F.col("first id").alias("row id"), (F.col("start") + begin).alias("at")), "row id"), path)

    tails = placed.where("tail_digest is not null").select("row id", "path", F.col("spot").alias("seq"), F.col("tail_size").alias("size"), "tail_digest")
    firsts = tails.groupBy("size", "tail_digest").agg(F.min("seq").alias("first_seq"), F.count("*").alias("uses"))
    told = checkpointed(join_counted(tails, firsts, ["size", "tail_digest"], "uses").select("row id", "path", "seq", "size", "first_seq"))
    spots = checkpointed(told.select("row id", "seq", "first_seq").join(blocks.place_tails(told.drop("row id"), codec.block_size).drop("path"), "seq"))
    data = spots.where("seq = first_seq").select("row id", "fragment", "fragment_offset").join(files.select("row id", "tail"), "row id")
    grouped = data.groupBy("fragment").agg(F.sort_array(F.collect_list(F.struct(F.col("fragment_offset").alias("off"), F.col("tail").alias("data")))).alias("parts"))

    def pack(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            whole = b"".join(p["data"] for p in row["parts"])
            packed = codec.compress(whole)
            yield row["fragment"], whole if packed is None else packed, packed is None

    packed = checkpointed(_map(grouped, pack, "fragment long, data binary, raw boolean"))
    sized = packed.select("fragment", F.octet_length("data").cast("long").alias("n"), "raw")
    fragments = checkpointed(running_total(sized, "fragment", "n", "start").withColumn("start", F.col("start") + end))
    pour(packed.join(fragments.select("fragment", F.col("start").alias("at")), "fragment"), path)
    located = spots.select("row id", "fragment", "fragment_offset")
    return placed.select("row id").join(starts, "row id", "left").join(located, "row id", "left"), fragments, end + _total(fragments, F.col("n"))


# --- nodes --------------------------------------------------------------------------------------------------------------


def _fail(rows: DataFrame, text: str, code: int) -> None:
    if found := rows.select("path").limit(1).collect():
        raise im.ImageError(f"{found[0].path!r} {text}", code)


def _nodes(ready: DataFrame, located: DataFrame, mtime: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with numbers, and the names that stand in directories: path and inode."""
    kinds = {"mode": "int", "uid": "long", "gid": "long", "mtime": "long", "rdev": "long", "target": "string", "hard_link": "boolean", "xattrs": "map<string,binary>", "size": "long"}
    words, stored_bytes = F.col("words"), F.when(F.octet_length("tail") > 0, F.octet_length("tail")).otherwise(0)
    # a tail of zeros is a sparse block
    zeros = (F.octet_length("tail") > 0) & F.col("tail_digest").isNull()
    block = F.lit(0).cast("long")
    rows = ready.select(
        "path", "row id", *[_column(ready, c, k) for c, k in kinds.items()],
        F.when(zeros, F.array_append(words, block)).otherwise(words).alias("words"), F.when(zeros, stored_bytes).otherwise(0).cast("long").alias("zero_tail"),
    )
    rows = checkpointed(tree.with_implied(rows, mtime=mtime).withColumn("hard_link", F.coalesce("hard_link", F.lit(False))))
    _fail(rows.groupBy("path").count().where("count > 1"), "is there twice", -16)
    if rows.where("hard_link").isEmpty():
        names = rows.select("path", F.col("path").alias("own"))
    else:
        found = checkpointed(links.resolve(rows))
        for error, text, code in (("loop", "is a link to itself", -14), ("missing", "is a link to nothing", -13), ("directory", "is a hard link to a directory", -16)):
            _fail(found.where(F.col("error") == error), text, code)
        rows = checkpointed(rows.join(found.select("path", "resolved"), "path", "left").withColumn("target", F.coalesce("resolved", "target")).drop("resolved"))
        names = rows.select("path", F.when(F.col("hard_link"), F.col("target")).otherwise(F.col("path")).alias("own"))
    numbers = checkpointed(tree.inode_numbers(rows))
    counts = tree.link_counts(rows)
    nodes = rows.where("not hard_link").join(numbers, "path").join(counts, "path").join(located, "row id", "left")
    return nodes, names.join(numbers.withColumnRenamed("path", "own"), "own").select("path", "inode")


def _kind() -> Column:
    out = F.lit(None).cast("int")
    for bits, number in im.BITS_TYPE.items():
        out = F.when(modes.is_type(F.col("mode"), bits), number).otherwise(out)
    return out


def _inode(row: dict, block_size: int) -> im.Inode:
    i = im.Inode(row["inode"], row["kind"], row["mode"], row["uid_index"], row["gid_index"], min(max(row["mtime"] or 0, 0), 0xFFFFFFFF), nlink=row["nlink"], rdev=row["rdev"] or 0)
    i.xattr = im.NONE32 if row["xattr_index"] is None else row["xattr_index"]
    if i.basic == im.LNK:
        i.target = (row["target"] or "").encode("utf-8", "surrogateescape")
    elif i.basic == im.REG:
        i.size, i.block_sizes, i.block_start = row["size"] or 0, row["words"] or [], row["start"] or 0
        whole = len(i.block_sizes) - (row["zero_tail"] > 0 if row["zero_tail"] is not None else 0)
        i.sparse_bytes = sum(min(block_size, i.size - n * block_size) for n in range(whole) if not i.block_sizes[n]) + (row["zero_tail"] or 0)
        if row["fragment"] is not None:
            i.fragment, i.fragment_offset = row["fragment"], row["fragment_offset"]
    return i


def _measured(dirents: DataFrame) -> DataFrame:
    """parent, entries, names (of every 256th entry, of long directories) and bound, more bytes than a listing may take."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        now, count, names, bound = None, 0, [], 0
        for row in rows:
            if row["parent"] != now:
                if now is not None:
                    yield now, count, names if count >= im.INDEXED_ENTRIES else [], bound
                now, count, names, bound = row["parent"], 0, [], 3
            name = row["name"].encode("utf-8", "surrogateescape")
            if count % im.RUN_ENTRIES == 0:
                names.append(name)
            count, bound = count + 1, bound + 20 + len(name)
        if now is not None:
            yield now, count, names if count >= im.INDEXED_ENTRIES else [], bound

    return _map(dirents, run, "parent long, entries long, names array<binary>, bound long")


def _listings(dirents: DataFrame) -> DataFrame:
    """parent, part, data, size and places: the listings in parts of some runs. A directory's last part has the size
    of all and where the runs of its index begin."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        held: list[tuple[dict, bytes]] = []

        def listing(run: list) -> bytes:
            first = run[0][0]
            data = struct.pack("<III", len(run) - 1, first["start"], first["inode"])
            return data + b"".join(struct.pack("<HhHH", r["at"] % im.META, r["inode"] - first["inode"], r["kind"], len(name) - 1) + name for r, name in run)

        now, part, out, total, places, count, length = None, 0, bytearray(), 0, [], 0, 0

        def close() -> None:
            nonlocal total, held, length
            if held:
                data = listing(held)
                out.extend(data)
                total += len(data)
                held, length = [], 0

        for row in rows:
            name = row["name"].encode("utf-8", "surrogateescape")
            if row["parent"] != now:
                close()
                if now is not None:
                    yield now, part, bytes(out), total, places if count >= im.INDEXED_ENTRIES else []
                now, part, out, total, places, count = row["parent"], 0, bytearray(), 0, [], 0
            first = held[0][0] if held else None
            if first and (row["block"] != first["block"] or abs(row["inode"] - first["inode"]) > im.RUN_DELTA or count % im.RUN_ENTRIES == 0 or length + 20 + len(name) > im.META):
                close()
                if len(out) > 1 << 20:
                    yield now, part, bytes(out), None, None
                    part, out = part + 1, bytearray()
            if count % im.RUN_ENTRIES == 0:
                places.append(total)
            held.append((row, name))
            count, length = count + 1, length + 8 + len(name)
        close()
        if now is not None:
            yield now, part, bytes(out), total, places if count >= im.INDEXED_ENTRIES else []

    return _map(dirents, run, "parent long, part int, data binary, size long, places array<long>")


def _by_parent(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "parent").sortWithinPartitions("parent", "name")


# --- the image ----------------------------------------------------------------------------------------------------------


def write_spread(ready: DataFrame, order: list[Column], path: str, codec: Codec, mtime: int = 0, exportable: bool = False, device_block: int = 4096) -> None:
    """Writes prepared entries (``image.prepare``, with a row id) as one image; the file appears when it is whole."""
    spark, temporary = ready.sparkSession, f"{path}.part"
    options = codec.pack_options()
    head = b"" if options is None else struct.pack("<H", len(options) | im.RAW_META) + options
    with open(temporary, "wb") as file:
        file.write(bytes(im.SUPER.size) + head)
    try:
        _fill(spark, ready, order, temporary, codec, mtime, exportable, device_block, im.SUPER.size + len(head), options is not None)
        os.replace(temporary, path)
    except BaseException:
        os.remove(temporary)
        raise


def _fill(spark, ready: DataFrame, order: list[Column], path: str, codec: Codec, mtime: int, exportable: bool, device_block: int, begin: int, has_options: bool) -> None:
    located, fragments, end = _place_data(ready, order, path, codec, begin)
    nodes, names = _nodes(ready, located, mtime)
    nodes = checkpointed(nodes.withColumns({"uid": F.coalesce("uid", F.lit(0).cast("long")), "gid": F.coalesce("gid", F.lit(0).cast("long")), "kind": _kind()}))

    # owners and attribute sets
    firsts = nodes.select(F.posexplode(F.array("uid", "gid")).alias("which", "id"), "inode").groupBy("id").agg(F.min(F.struct("inode", "which")).alias("first"))
    ids = [r.id for r in firsts.orderBy("first").limit((1 << 16) + 1).collect()]
    if len(ids) > 1 << 16:
        raise im.ImageError("there are too many different ids", -7)
    id_table = F.broadcast(spark.createDataFrame([(v, n) for n, v in enumerate(ids)], "id long, idx int"))
    for c in ("uid", "gid"):
        nodes = nodes.join(id_table.select(F.col("id").alias(c), F.col("idx").alias(f"{c}_index")), c)
    pairs = nodes.select(F.col("inode").alias("owner"), F.col("inode").alias("seq"), F.explode("xattrs").alias("key", "value"))
    sets = None
    if pairs.isEmpty():
        nodes = nodes.withColumn("xattr_index", F.lit(None).cast("long"))
    else:
        owners = checkpointed(attributes.attribute_sets(pairs))
        nodes = nodes.join(owners.withColumnRenamed("owner", "inode"), "inode", "left")
        sets = pairs.join(owners.groupBy("xattr_index").agg(F.min("owner").alias("owner")), "owner").groupBy("xattr_index").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("pairs"))

    # what stands in directories
    directories = nodes.where(F.col("kind") == im.DIR)
    inside = names.where("path != ''").select("path", "inode", F.coalesce(paths.parent(F.col("path")), F.lit("")).alias("above"), paths.name(F.col("path")).alias("name"))
    held = checkpointed(inside.join(directories.select(F.col("path").alias("above"), F.col("inode").alias("parent")), "above", "left").select("path", "parent", "name", "inode"))
    _fail(held.where("parent is null"), "lies in what is no directory", -12)
    measured = checkpointed(_measured(_by_parent(held.select("parent", "name"))))

    # lengths of inodes, and with them their places
    size = codec.block_size
    plain = nodes.where(F.col("kind") != im.DIR).drop("path", "xattrs", "uid", "gid")

    def encode(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            data = im.encode_inode(_inode(row, size))
            yield row["inode"], row["kind"], len(data), data

    encoded = _map(plain, encode, "inode long, kind int, n long, data binary")
    index_bytes = F.aggregate("names", F.lit(0), lambda a, x: a + 12 + F.octet_length(x))
    about = directories.select("inode", "mode", "uid_index", "gid_index", "mtime", "nlink", "xattr_index", F.coalesce(paths.parent(F.col("path")), F.lit("")).alias("above"), "path").join(measured.withColumnRenamed("parent", "inode"), "inode", "left")
    extended = F.col("xattr_index").isNotNull() | (F.coalesce("bound", F.lit(3)) > 0xFFFF) | (F.coalesce(F.size("names"), F.lit(0)) > 0)
    about = checkpointed(about.withColumn("n", F.when(extended, 40 + F.coalesce(index_bytes, F.lit(0))).otherwise(32).cast("long")))
    every = encoded.unionByName(about.select("inode", F.lit(im.DIR).alias("kind"), "n", F.lit(None).cast("binary").alias("data")))
    layout = checkpointed(running_total(checkpointed(every), "inode", "n", "at"))
    count, total = layout.agg(F.count("*"), F.sum("n")).first()

    # the inode table: blocks without a directory are compressed
    spans = layout.where(F.col("kind") == im.DIR).select(F.explode(F.sequence(F.floor(F.col("at") / im.META), F.floor((F.col("at") + F.col("n") - 1) / im.META))).alias("block")).distinct()
    raw = checkpointed(spans.withColumn("n", (F.least(F.lit(im.META), F.lit(total) - F.col("block") * im.META) + 2).cast("long")))
    grouped = checkpointed(_cut(layout.where(F.col("kind") != im.DIR)))
    packed = _compressed(grouped.join(raw.select("block"), "block", "left_anti"), codec)
    starts = _started(packed.select("block", F.octet_length("data").cast("long").alias("n")).unionByName(raw))
    inode_table, inode_bytes = end, _total(starts, F.col("n"))
    pour(packed.join(starts, "block").select((F.col("start") + inode_table).alias("at"), "data"), path)
    heads = _map(raw, lambda rows: ((r["block"], struct.pack("<H", r["n"] - 2 | im.RAW_META)) for r in rows), "block long, data binary")
    pour(heads.join(starts, "block").select((F.col("start") + inode_table).alias("at"), "data"), path)
    beside = grouped.join(raw.select("block"), "block", "left_semi").select("block", F.explode("parts").alias("p")).join(starts, "block")
    pour(beside.select((F.col("start") + 2 + F.col("p.off") + inode_table).alias("at"), F.col("p.data").alias("data")), path)

    # the directory table
    spots = layout.select("inode", "kind", "at", F.floor(F.col("at") / im.META).alias("block")).join(starts.select("block", "start"), "block")
    listed = checkpointed(_listings(_by_parent(held.select("parent", "name", "inode").join(spots, "inode"))))
    parts = checkpointed(running_total(listed.withColumns({"n": F.octet_length("data").cast("long"), "part order": F.struct("parent", "part")}), "part order", "n", "at"))
    listing_blocks = _compressed(_cut(parts), codec)
    listing_starts = _started(listing_blocks.select("block", F.octet_length("data").cast("long").alias("n")))
    directory_table = inode_table + inode_bytes
    pour(listing_blocks.join(listing_starts, "block").select((F.col("start") + directory_table).alias("at"), "data"), path)
    at = directory_table + _total(listing_starts, F.col("n"))

    # directories, now that their listings have places
    place = parts.groupBy("parent").agg(F.min("at").alias("list_at"), F.max("size").alias("size"), F.max("places").alias("places"))
    dirs = about.join(place.withColumnRenamed("parent", "inode"), "inode", "left").join(layout.select("inode", "at"), "inode")
    own = about.select(F.col("path").alias("above"), F.col("inode").alias("up"))
    dirs = checkpointed(dirs.join(own, "above", "left"))
    # -1 is where the listing itself begins, others where the runs of the index do
    asked = dirs.where("list_at is not null").select("inode", F.explode(F.array_append(F.coalesce("places", F.array().cast("array<long>")), F.lit(-1).cast("long"))).alias("place"), "list_at")
    asked = asked.withColumn("block", F.floor((F.col("list_at") + F.greatest("place", F.lit(0))) / im.META)).join(listing_starts.select("block", "start"), "block")
    answers = asked.groupBy("inode").agg(F.sort_array(F.collect_list(F.struct("place", "start"))).alias("answers"))

    def encode_directory(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            found = row["answers"] or [{"start": 0}]
            i = im.Inode(row["inode"], im.DIR, row["mode"], row["uid_index"], row["gid_index"], min(max(row["mtime"] or 0, 0), 0xFFFFFFFF), nlink=row["nlink"])
            i.xattr = im.NONE32 if row["xattr_index"] is None else row["xattr_index"]
            i.size, i.dir_start, i.dir_offset = 3 + (row["size"] or 0), found[0]["start"], (row["list_at"] or 0) % im.META
            i.parent = row["up"] if row["path"] else 0
            i.index = [(a["place"], a["start"], name) for a, name in zip(found[1:], row["names"] or [], strict=True)]
            data = im.encode_inode(i, row["n"] > 32)
            if len(data) != row["n"]:
                raise im.ImageError("a directory's inode isn't as long as was said")
            begin = 0
            while begin < len(data):
                at = row["at"] + begin
                part = data[begin : begin + im.META - at % im.META]
                yield at // im.META, at % im.META, part
                begin += len(part)

    cut = _map(dirs.join(answers, "inode", "left"), encode_directory, "block long, off int, data binary")
    pour(cut.join(starts, "block").select((F.col("start") + 2 + F.col("off") + inode_table).alias("at"), "data"), path)
    root_at, root_start = spots.where(F.col("inode") == count).select("at", "start").first()  # the root is the last

    # lookup tables
    flags = im.DUPLICATES | (im.OPTIONS if has_options else 0)
    fragment_count, all_raw = fragments.agg(F.count("*"), F.coalesce(F.min("raw"), F.lit(False))).first()
    fragment_table = export_table = xattr_table = im.NONE64
    if fragment_count:
        flags |= im.ALWAYS_FRAGMENTS | (im.RAW_FRAGMENTS if all_raw else 0)
        row = lambda r: (16 * r["fragment"], struct.pack("<QII", r["start"], r["n"] | (im.RAW_BLOCK if r["raw"] else 0), 0))
        fragment_table, at = _table(checkpointed(_map(fragments, lambda rows: map(row, rows), PIECES)), codec, path, at)
    else:
        flags |= im.NO_FRAGMENTS
    if exportable:
        flags |= im.EXPORTABLE
        ref = lambda r: (8 * (r["inode"] - 1), struct.pack("<Q", r["start"] << 16 | r["at"] % im.META))
        export_table, at = _table(checkpointed(_map(spots, lambda rows: map(ref, rows), PIECES)), codec, path, at)
    with open(path, "r+b") as file:
        file.seek(at)
        id_at = im.TableWriter(file, codec)._table(b"".join(struct.pack("<I", i) for i in ids))
        at = file.tell()
    if sets is None:
        flags |= im.NO_XATTRS
    else:
        # one task: its memory grows with the sets that differ

        def write_sets(rows: Iterator[dict]) -> Iterator[tuple]:
            held = [tuple((p["key"], p["value"]) for p in r["pairs"]) for r in rows]
            with open(path, "r+b") as file:
                file.seek(at)
                here = im.TableWriter(file, codec)._xattrs(held)
                yield here, file.tell()

        xattr_table, at = _map(sets.repartition(1).sortWithinPartitions("xattr_index"), write_sets, "here long, used long").first()
    with open(path, "r+b") as file:
        file.seek(at)
        file.write(bytes(-at % device_block))
        file.seek(0)
        root = root_start << 16 | root_at % im.META
        file.write(im.SUPER.pack(im.MAGIC, count, mtime, size, fragment_count, IDS[codec.name], int(math.log2(size)), flags, len(ids), 4, 0, root, at, id_at, xattr_table, inode_table, directory_table, fragment_table, export_table))
        file.flush()
        os.fsync(file.fileno())
