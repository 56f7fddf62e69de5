"""Queries over formats, sinks, codecs, streams and whole runs of the engine, each beside the SQL that says the same.

Those that write do so in the folder that all executors share, and read back what they wrote.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import codecs, modes, numbers, text
from ..operators import attributes, blocks, dictionary, diff, inodes, links, rules, tree
from ..operators import entries as E
from ..session import checkpointed
from ..sources import directory, image, tar
from ..streaming import ingest
from . import views
from .catalogue import _B, _HEX, _NUMBERS, _SETS, BLOCK, _pieces, _shared, query

# --- archives ---------------------------------------------------------------------------------------------------------


def _archived(docs: DataFrame, make: Callable[[tarfile.TarInfo, int, bytes], tuple[bytes, int]]) -> DataFrame:
    """path and content: for each document (path, seq, content) an archive that holds it, made by the standard library."""

    def one(path: str, seq: int, content: bytes) -> bytes:
        out = io.BytesIO()
        info = tarfile.TarInfo(path)
        info.mode, info.uid, info.gid, info.mtime = 0o640, seq % 9, seq % 5, seq
        content, kind = make(info, seq, bytes(content or b""))
        info.size = len(content)
        with tarfile.open(fileobj=out, mode="w", format=kind) as archive:
            archive.addfile(info, io.BytesIO(content))
        return out.getvalue()

    packed = F.pandas_udf(lambda p, s, c: p.combine(s, lambda a, b: (a, b)).combine(c, lambda ab, d: one(*ab, d)), "binary")
    return docs.select("path", packed("path", "seq", "content").alias("content"))


_LONG = "repeat('folder-with-a-long-name/', 6)"


@query(
    f"WITH {views.CONTENTS} SELECT CASE WHEN seq % 3 = 0 THEN path ELSE {_LONG} || path END AS path, 33184 AS mode, CAST(seq % 9 + CASE WHEN seq % 3 = 2 THEN 3000000 ELSE 0 END AS BIGINT) AS uid, CAST(seq % 5 AS BIGINT) AS gid, CAST(seq AS BIGINT) AS mtime, CAST(octet_length(content) AS BIGINT) AS size, md5(text) AS digest FROM contents"
)
def tar_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives in three formats: ustar, with long names and base-256 numbers as GNU writes them, and pax."""
    formats = (tarfile.USTAR_FORMAT, tarfile.PAX_FORMAT, tarfile.GNU_FORMAT)

    def make(info: tarfile.TarInfo, seq: int, content: bytes) -> tuple[bytes, int]:
        info.uid += 3_000_000 if seq % 3 == 2 else 0
        return content, formats[seq % 3]

    docs = views.contents(spark, sf_dir)
    named = docs.withColumn("path", F.when(F.col("seq") % 3 == 0, F.col("path")).otherwise(F.concat(F.expr(_LONG), "path")))
    found = tar.parse_tars(_archived(named, make))
    return found.select("path", "mode", "uid", "gid", "mtime", "size", F.md5("content").alias("digest"))


@query(f"WITH {views.CONTENTS} SELECT path, key, value FROM (SELECT path, 'user.a b' AS key, 'first ' || CAST(seq AS VARCHAR) AS value FROM contents UNION ALL SELECT path, 'security.n', CAST(seq * 7 AS VARCHAR) FROM contents)")
def tar_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended attributes in pax headers, plain ones and those with an encoded key and value."""

    def make(info: tarfile.TarInfo, seq: int, content: bytes) -> tuple[bytes, int]:
        from base64 import b64encode

        info.pax_headers = {"LIBARCHIVE.xattr.user.a%20b": b64encode(b"first %d" % seq).decode(), "SCHILY.xattr.security.n": str(seq * 7)}
        return content, tarfile.PAX_FORMAT

    found = tar.parse_tars(_archived(views.contents(spark, sf_dir), make))
    return found.select("path", F.explode("xattrs").alias("key", "value")).select("path", "key", F.col("value").cast("string").alias("value"))


@query(f"WITH {views.CONTENTS} SELECT path, CAST(1000 + octet_length(content) + seq % 3 AS BIGINT) AS size, CAST(1000 AS BIGINT) AS \"offset\", CAST(octet_length(content) AS BIGINT) AS count, md5(text) AS digest, true AS zeros FROM contents")
def tar_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse files in four forms: old GNU headers, pairs, a map in a header, and a map in front of the data."""

    def make(info: tarfile.TarInfo, seq: int, content: bytes) -> tuple[bytes, int]:
        size = 1000 + len(content) + seq % 3
        if seq % 3 == 0:
            info.pax_headers = {"GNU.sparse.size": str(size), "GNU.sparse.map": f"1000,{len(content)}"}
        elif seq % 3 == 1:
            info.pax_headers = {"GNU.sparse.size": str(size), "GNU.sparse.offset": "1000", "GNU.sparse.numbytes": str(len(content))}
        else:
            info.pax_headers = {"GNU.sparse.major": "1", "GNU.sparse.minor": "0", "GNU.sparse.realsize": str(size)}
            table = f"1\n1000\n{len(content)}\n".encode()
            content = table + bytes(512 - len(table)) + content
        return content, tarfile.PAX_FORMAT

    def old(path: str, seq: int, content: bytes) -> bytes:
        header = bytearray(tarfile.TarInfo(path).tobuf(tarfile.GNU_FORMAT))
        octal = lambda n: f"{n:011o}\0".encode()
        header[124:136], header[136:148], header[156:157] = octal(len(content)), octal(seq), b"S"
        header[386:410], header[483:495] = octal(1000) + octal(len(content)), octal(1000 + len(content) + seq % 3)
        header[148:156] = b" " * 8
        header[148:156] = f"{sum(header):06o}\0 ".encode()
        return bytes(header) + content + bytes(-len(content) % 512) + bytes(1024)

    docs = views.contents(spark, sf_dir)
    old_packed = F.pandas_udf(lambda p, s, c: p.combine(s, lambda a, b: (a, b)).combine(c, lambda ab, d: old(*ab, bytes(d))), "binary")
    is_old = F.col("seq") % 4 == 3
    archives = _archived(docs.where(~is_old), make).union(docs.where(is_old).select("path", old_packed("path", "seq", "content")))
    found = tar.parse_tars(archives).withColumn("e", F.col("sparse")[0])
    data = F.expr("substring(content, cast(e.offset as int) + 1, cast(e.count as int))")
    around = F.concat(F.expr("substring(content, 1, 1000)"), F.expr("substring(content, cast(e.offset + e.count as int) + 1)"))
    return found.select("path", "size", F.col("e.offset").alias("offset"), F.col("e.count").alias("count"), F.md5(data).alias("digest"), blocks.is_zero(around).alias("zeros"))


@query("SELECT o_orderkey AS k, CAST(o_orderkey * 3 AS BIGINT) AS small, CAST(o_orderkey * 8589934592 AS BIGINT) AS large, CAST(-o_orderkey AS BIGINT) AS negative FROM orders")
def tar_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as octal digits and, where these don't hold them or they are negative, in base 256."""
    write = lambda n: bytes(tar.write_number(n, 12))
    packed = F.pandas_udf(lambda n: n.map(write), "binary")
    back = F.pandas_udf(lambda b: b.map(lambda x: tar.read_number(bytes(x))), "long")
    two = F.pandas_udf(lambda n: n.map(lambda v: (v & ((1 << 95) - 1) | 1 << 95).to_bytes(12, "big")), "binary")
    k = F.col("o_orderkey")
    rows = views.read(spark, sf_dir, "orders").select(k.alias("k"), packed(k * 3).alias("a"), packed(k * (1 << 33)).alias("b"), two(-k).alias("c"))
    return rows.select("k", back("a").alias("small"), back("b").alias("large"), back("c").alias("negative"))


# --- images: attributes, tables, streams of files -----------------------------------------------------------------------


def _with_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda v: v.cast("binary")
    pairs = F.create_map(F.lit("user.kind"), value(F.concat(F.lit("kind number "), (F.col("seq") % 4).cast("string"))), F.lit("security.one"), value(F.lit("the same for all of them")))
    files = views.contents(spark, sf_dir).withColumns({"mode": F.lit(0o100644), "uid": F.col("seq") % 7, "gid": F.col("seq") % 3, "mtime": F.col("seq")})
    return files.withColumn("xattrs", F.when(F.col("seq") % 5 > 0, pairs))


def _image(spark: SparkSession, rows: DataFrame, name: str, compressor: str = "zstd", block_size: int = 4096, **options) -> str:
    path = _shared(spark, name)
    image.write_image(rows, path, compressor, block_size, **options)
    return path


@query(f"WITH {views.CONTENTS} SELECT path, 'user.kind' AS key, 'kind number ' || CAST(seq % 4 AS VARCHAR) AS value FROM contents WHERE seq % 5 > 0 UNION ALL SELECT path, 'security.one', 'the same for all of them' FROM contents WHERE seq % 5 > 0")
def image_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes written into an image and read again with its entries."""
    path = _image(spark, _with_attributes(spark, sf_dir), "attributes.img")
    rows = image.read_image(spark, path, content=False, slices=4)
    return rows.select("path", F.explode("xattrs").alias("key", "value")).select("path", "key", F.col("value").cast("string").alias("value"))


@query(f"WITH {views.CONTENTS} SELECT DISTINCT 'kind number ' || CAST(seq % 4 AS VARCHAR) AS kind, 'the same for all of them' AS one FROM contents WHERE seq % 5 > 0")
def image_attribute_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of attribute sets: each different set once, repeated values out of line."""
    path = _image(spark, _with_attributes(spark, sf_dir), "sets.img")
    sets = image.read_image(spark, path, "xattrs")
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value").cast("string")))
    return sets.groupBy("xattr_index").agg(value("user.kind").alias("kind"), value("security.one").alias("one")).select("kind", "one")


@query(f"WITH {views.TAGS}, won AS (SELECT owner, key, arg_max(text, seq) AS text FROM tags GROUP BY owner, key) SELECT CAST(o_orderkey AS BIGINT) AS k, coalesce(string_agg(key || '=' || text, ',' ORDER BY key), '') AS pairs FROM orders LEFT JOIN won ON owner = o_custkey GROUP BY o_orderkey")
def attribute_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes of each order's customer, by the index of their set."""
    pairs = views.tags(spark, sf_dir)
    owners = checkpointed(attributes.attribute_sets(pairs))
    stored = attributes.last_wins(pairs).join(owners.groupBy("xattr_index").agg(F.min("owner").alias("owner")), "owner").select("xattr_index", "key", "value")
    rows = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("owner")).join(owners, "owner", "left")
    found = attributes.collect(rows, stored)
    keys = F.array_sort(F.map_keys("xattrs"))
    return found.select("k", F.array_join(F.transform(keys, lambda key: F.concat(key, F.lit("="), F.element_at("xattrs", key).cast("string"))), ",").alias("pairs"))


@query(f"WITH {views.CONTENTS} SELECT path, 33188 AS mode, CAST(seq % 7 AS BIGINT) AS uid, CAST(seq % 3 AS BIGINT) AS gid, CAST(seq AS BIGINT) AS mtime, CAST(octet_length(content) AS BIGINT) AS size FROM contents")
def image_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries put together from the tables of an image: inodes, directory entries and ids."""
    path = _image(spark, _with_attributes(spark, sf_dir), "tables.img")
    root = image.read_image(spark, path, "super").select("inode_count").first()[0]  # the root is the last
    read = lambda table: image.read_image(spark, path, table)
    found = inodes.entries(read("inodes"), read("dirents"), read("ids"), root)
    return found.where(modes.is_type(F.col("mode"), modes.FILE)).select("path", "mode", F.col("uid").cast("long").alias("uid"), F.col("gid").cast("long").alias("gid"), "mtime", "size")


@query(f"WITH {views.CONTENTS} SELECT path, CAST(octet_length(content) AS BIGINT) AS size, md5(text) AS digest FROM contents")
def image_file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an image without fragments as streams of their blocks, put together again."""
    rows = views.contents(spark, sf_dir).withColumns({"mode": F.lit(0o100644)})
    path = _image(spark, rows, "stream.img", "gzip", tails=False)
    numbers_of = image.read_image(spark, path, content=False).where(modes.is_type(F.col("mode"), modes.FILE)).select("path", "inode", "size")
    data = image.read_image(spark, path, "blocks").where("data is not null").select("inode", "idx", "data")
    joined = blocks.join_blocks(data.withColumnRenamed("inode", "path")).withColumnRenamed("path", "inode")
    whole = numbers_of.join(joined, "inode", "left").withColumn("content", F.coalesce("content", F.lit("").cast("binary")))
    # copies of a file share their blocks but not their inode
    return whole.select("path", "size", F.md5("content").alias("digest"))


@query(f"WITH {views.CONTENTS}, {_HEX} SELECT path, CAST(n AS BIGINT) AS size, CAST(ceil(n / 4096.0) AS BIGINT) AS blocks FROM hexed")
def image_block_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of files by the size words of their inodes."""
    rows = views.contents(spark, sf_dir).withColumns({"mode": F.lit(0o100644)})
    path = _image(spark, rows, "words.img", "gzip", tails=False)
    entries = image.read_image(spark, path, content=False).where(modes.is_type(F.col("mode"), modes.FILE)).select("path", "inode", "size")
    table = inodes.block_table(image.read_image(spark, path, "inodes").where("type in (2, 9)"))
    counted = table.groupBy("inode").agg(F.count("idx").alias("blocks"))
    return entries.join(counted, "inode").select("path", "size", "blocks")


# --- trees: links, inserts, orders, numbers ---------------------------------------------------------------------------------


@query(
    f"WITH {views.TREE}, {_NUMBERS}, linked AS (SELECT substr(parent_path, 1, length(parent_path) - length(string_split(parent_path, '/')[-1]) - 1) AS holder, 'link' || CAST(key AS VARCHAR) AS link, path AS target FROM parted WHERE key % 10 = 1), "
    "firsts AS (SELECT target, min(struct_pack(holder_inode := n.inode, link := link)) AS first FROM linked JOIN numbers n ON n.path = holder GROUP BY target), "
    "placed AS (SELECT n.path, CASE WHEN first.holder_inode < n.inode THEN first.holder_inode ELSE n.inode END AS place, CASE WHEN first.holder_inode < n.inode THEN 0 ELSE 1 END AS late, CASE WHEN first.holder_inode < n.inode THEN first.link END AS link FROM numbers n LEFT JOIN firsts ON target = n.path) "
    "SELECT path, CAST(row_number() OVER (ORDER BY place, late, link) AS BIGINT) AS inode FROM placed"
)
def inode_numbers_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inode numbers where the folder above a customer's holds hard links to some of the customer's orders."""
    rows = views.tree(spark, sf_dir).select("path", "mode", "key").withColumns({"hard_link": F.lit(False), "target": F.lit(None).cast("string")})
    above = F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -2)) - 1)")
    hard = rows.where("key % 10 = 1").select(F.concat(above, F.lit("/link"), F.col("key").cast("string")).alias("path"), F.lit(modes.LINK | 0o777).alias("mode"), "key", F.lit(True).alias("hard_link"), F.col("path").alias("target"))
    return tree.inode_numbers(rows.unionByName(hard))


@query(
    f"WITH {views.TREE}, hard AS (SELECT path || '-again' AS path, path AS target FROM files WHERE key % 4 = 1), here AS (SELECT path, mode, parent_path FROM parted UNION ALL SELECT h.path, 41471, parent_path FROM hard h JOIN parted p ON p.path = h.target) "
    "SELECT p.path, CAST(CASE WHEN (p.mode & 61440) = 16384 THEN 2 ELSE 1 END + (SELECT count(*) FROM here c WHERE c.parent_path = p.path) + (SELECT count(*) FROM hard WHERE target = p.path) AS BIGINT) AS nlink FROM parted p"
)
def link_counts_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.tree(spark, sf_dir).select("path", "mode", "key").withColumns({"hard_link": F.lit(False), "target": F.lit(None).cast("string")})
    hard = rows.where("key % 4 = 1").select(F.concat("path", F.lit("-again")).alias("path"), F.lit(modes.LINK | 0o777).alias("mode"), "key", F.lit(True).alias("hard_link"), F.col("path").alias("target"))
    return tree.link_counts(rows.unionByName(hard))


@query(f"WITH {views.TREE} SELECT path, CAST(mode AS INT) AS mode FROM (SELECT path, CASE WHEN (mode & 61440) = 40960 THEN 41471 ELSE mode END AS mode FROM files UNION ALL SELECT path, CASE WHEN path LIKE '%/%/%' THEN mode ELSE 16877 END FROM folders)")
def tree_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders put into a tree that has the customers' folders: the folders above are made."""
    rows = views.tree(spark, sf_dir).select("path", "mode", "uid", "gid", "mtime", "target").withColumn("hard_link", F.lit(False))
    there = rows.where(modes.is_type(F.col("mode"), modes.DIRECTORY) & F.col("path").like("%/%/%"))
    return tree.insert(there, rows.where(~modes.is_type(F.col("mode"), modes.DIRECTORY))).select("path", "mode")


@query(
    f"WITH {views.TREE}, more AS (SELECT path, mode FROM tree UNION ALL SELECT path, mode FROM files WHERE key % 90 = 1 UNION ALL SELECT path || '/below', 33188 FROM files WHERE key % 90 = 2) "
    "SELECT path, 'exists' AS reason FROM more GROUP BY path HAVING count(*) > 1 UNION ALL SELECT path || '/below', 'not a directory' FROM files WHERE key % 90 = 2"
)
def tree_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that can't be put into the tree: names that are there, and names below files."""
    rows = views.tree(spark, sf_dir).select("path", "mode", "key")
    twice = rows.where("key % 90 = 1")
    below = rows.where("key % 90 = 2").select(F.concat("path", F.lit("/below")).alias("path"), F.lit(0o100644).alias("mode"), "key")
    return tree.conflicts(rows.union(twice).union(below).select("path", "mode"))


@query(f"WITH {views.TREE} SELECT path || '/back' AS path FROM folders WHERE path LIKE '%/%/%'")
def link_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of customers' folders that lead back to the folder of the nation."""
    rows = E.with_parts(views.folders(spark, sf_dir)).withColumn("id", F.xxhash64("path"))
    root = rows.where("path = ''").select("id").first()[0]
    dirents = rows.where("path != ''").select(F.xxhash64("parent_path").alias("parent_inode"), "name", F.col("id").alias("inode"), F.lit(1).alias("type"))
    back = rows.where("depth = 3").select(F.col("id").alias("parent_inode"), F.lit("back").alias("name"), F.xxhash64("parent_path").alias("inode"), F.lit(1).alias("type"))
    return tree.loops(tree.walk(dirents.union(back), root)).select("path")


@query(f"WITH {views.TREE} SELECT 'top/' || path AS path, mode FROM tree WHERE path <> '' UNION ALL SELECT 'top', mode FROM tree WHERE path = ''")
def prefixed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_prefix(views.tree(spark, sf_dir), "top").select("path", "mode")


@query(f"WITH {views.TREE} SELECT path, CAST(row_number() OVER (PARTITION BY parent_path ORDER BY name) - 1 AS BIGINT) AS position FROM parted WHERE path <> ''")
def children_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.position_in_directory(views.tree(spark, sf_dir)).select("path", "position")


@query(f"WITH {views.TREE} SELECT path, CAST(row_number() OVER (ORDER BY depth DESC, path) - 1 AS BIGINT) AS position FROM parted")
def children_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which attributes are set."""
    return tree.attribute_order(views.tree(spark, sf_dir)).select("path", "position")


_PLACED = "SELECT path, CASE WHEN key % 3 = 0 THEN key % 50 END AS fragment, CASE WHEN key % 2 = 0 THEN key * 7 % 1000 END AS block_start FROM files"


@query(f"WITH {views.TREE}, placed AS ({_PLACED}) SELECT path, CAST(row_number() OVER (ORDER BY fragment IS NULL, fragment, block_start IS NULL, block_start, path) - 1 AS BIGINT) AS position FROM placed")
def unpack_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the order in which their data lie in an image."""
    key = F.col("key")
    rows = views.files(spark, sf_dir).select("path", F.when(key % 3 == 0, key % 50).alias("fragment"), F.when(key % 2 == 0, key * 7 % 1000).alias("block_start"))
    return E.unpack_positions(rows).select("path", "position")


@query(f"WITH {views.TREE} SELECT path, mode, size FROM files WHERE key = (SELECT min(key) FROM files)")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path is looked for, and the search stops at it."""
    rows = views.files(spark, sf_dir)
    path = rows.agg(F.min_by("path", "key")).first()[0]
    return E.first_match(rows, path).select("path", "mode", "size")


_ID_TABLE = "used AS (SELECT uid AS id, inode * 2 AS place FROM numbers UNION ALL SELECT gid, inode * 2 + 1 FROM numbers), dictionary AS (SELECT id, row_number() OVER (ORDER BY first) - 1 AS idx FROM (SELECT id, min(place) AS first FROM used GROUP BY id))"


@query(f"WITH {views.TREE}, {_NUMBERS}, {_ID_TABLE} SELECT path, CAST(u.idx AS BIGINT) AS uid_index, CAST(g.idx AS BIGINT) AS gid_index FROM numbers JOIN dictionary u ON u.id = uid JOIN dictionary g ON g.id = gid")
def encoded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.tree(spark, sf_dir)
    ids = checkpointed(dictionary.id_dictionary(rows.join(tree.inode_numbers(rows), "path")))
    return dictionary.encode_ids(rows, ids).select("path", "uid_index", "gid_index")


@query(f"WITH {views.TREE} SELECT path, uid, gid FROM tree")
def decoded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners by their index and back."""
    rows = views.tree(spark, sf_dir)
    ids = checkpointed(dictionary.id_dictionary(rows.join(tree.inode_numbers(rows), "path")))
    return dictionary.decode_ids(dictionary.encode_ids(rows, ids).drop("uid", "gid"), ids).select("path", "uid", "gid")


@query(f"WITH {views.TREE}, {_NUMBERS} SELECT CAST(i AS BIGINT) AS inode, CASE WHEN i <= (SELECT max(inode) FROM numbers) AND i % 7 <> 3 THEN CAST(i * 65536 + i % 8192 AS BIGINT) END AS ref FROM range(1, (SELECT max(inode) + 6 FROM numbers)) r(i)")
def inode_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of inodes by number; every seventh and those beyond the last have none."""
    numbered = checkpointed(tree.inode_numbers(views.tree(spark, sf_dir)).select("inode"))
    last = numbered.agg(F.max("inode")).first()[0]
    known = numbered.where("inode % 7 != 3").select("inode", (F.col("inode") * 65536 + F.col("inode") % 8192).alias("ref"))
    return inodes.resolve_numbers(known, spark.range(1, last + 6).withColumnRenamed("id", "inode")).select("inode", "ref")


@query(f"WITH {views.TREE} SELECT path, CAST(CASE (mode & 61440) WHEN 40960 THEN 3 WHEN 24576 THEN 4 WHEN 8192 THEN 5 WHEN 4096 THEN 6 ELSE 7 END + CASE WHEN key % 4 = 1 THEN 7 ELSE 0 END AS INT) AS type, mode, CAST(1 AS BIGINT) AS nlink, rdev, target FROM files WHERE (mode & 61440) <> 32768")
def special_inodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inodes of links, devices, pipes and sockets from their entries."""
    rows = views.files(spark, sf_dir).withColumns({"xattr_index": F.when(F.col("key") % 4 == 1, F.col("key")), "nlink": F.lit(1).cast("long")})
    return inodes.from_entries(rows)


# --- blocks ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {_B} SELECT path, CAST(idx AS BIGINT) AS idx, CAST(96 + coalesce(sum(size) OVER (ORDER BY seq, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS written_at FROM pieces")
def io_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where blocks lie that leave in the order in which they were submitted."""
    return blocks.sequenced(_pieces(spark, sf_dir).withColumn("stored", F.col("size")), start=96).select("path", "idx", "written_at")


@query(f"WITH {_B}, extra AS (SELECT DISTINCT path, seq FROM contents WHERE seq % 4 = 0) SELECT path, CAST(idx AS BIGINT) AS idx, CAST(size AS BIGINT) AS size, md5(h) AS digest, CAST(NULL AS VARCHAR) AS \"user\" FROM pieces UNION ALL SELECT path, CAST(1000000 AS BIGINT), CAST(octet_length(encode('own ' || path)) AS BIGINT), md5(hex(encode('own ' || path))), 'caller' FROM extra")
def manual_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of files and a caller's own among them."""
    own = views.contents(spark, sf_dir).where("seq % 4 = 0").select("path", "seq", F.lit(1_000_000).cast("long").alias("idx"), F.concat(F.lit("own "), "path").cast("binary").alias("data"), F.lit("caller").alias("user"))
    return blocks.submit(_pieces(spark, sf_dir), own).select("path", "idx", "size", F.md5(F.hex("data")).alias("digest"), "user")


def _codec_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        codec = codecs.codec(name, BLOCK)
        done = codecs.restore_blocks(codecs.transform_blocks(_pieces(spark, sf_dir, False), codec), codec)
        fits = (F.col("stored_size") < F.col("size")) == (F.col("compressed") | F.col("sparse"))
        return done.select("path", "idx", "size", F.md5(F.hex("restored")).alias("digest"), fits.alias("fits"))

    run.__name__ = f"codec_{name}"
    run.__doc__ = f"Blocks compressed by {name} and restored; one that doesn't get smaller is stored as it is."
    query(f"WITH {_B} SELECT path, CAST(idx AS BIGINT) AS idx, CAST(size AS BIGINT) AS size, md5(h) AS digest, true AS fits FROM pieces")(run)


for _name in codecs.available():
    _codec_query(_name)


def _stream_query(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pack = codecs.block_function(lambda b: codecs.pack_stream(kind, b))
        unpack = codecs.block_function(lambda b: codecs.open_stream(io.BytesIO(b)).read())
        rows = views.contents(spark, sf_dir).select("path", pack("content").alias("packed"))
        return rows.select("path", codecs.stream_kind_column(F.col("packed")).alias("kind"), F.md5(unpack("packed")).alias("digest"))

    run.__name__ = f"stream_{kind}"
    run.__doc__ = f"Contents as {kind} streams, recognized by their first bytes and unpacked."
    query(f"WITH {views.CONTENTS} SELECT path, '{kind}' AS kind, md5(text) AS digest FROM contents")(run)


for _name in ("gzip", "xz", "bzip2"):
    _stream_query(_name)


# --- text and numbers ----------------------------------------------------------------------------------------------------------


@query("SELECT page_id, url AS decoded FROM pages")
def url_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with every byte but letters and digits written as a percent sign and two hex digits, read again."""
    encode = F.pandas_udf(lambda s: s.map(lambda u: None if u is None else "".join(chr(b) if chr(b).isalnum() and b < 128 else f"%{b:02X}" for b in u.encode())), "string")
    decode = F.pandas_udf(lambda s: s.map(lambda u: None if u is None else text.decode_url(u.encode()).decode()), "string")
    return views.read(spark, sf_dir, "pages").select("page_id", decode(encode("url")).alias("decoded"))


@query(f"WITH {views.CONTENTS} SELECT path, regexp_replace(hex(content), '(.)(.)', '\\2\\1', 'g') AS nibbles FROM contents")
def nibble_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.contents(spark, sf_dir).select("path", text.nibbles(F.col("content")).alias("nibbles"))


_ROT = "(((x << 17) & 4294967295) | (x >> 15))"
_XXH32 = (
    "words AS (SELECT o_orderkey AS k, CAST(o_orderkey % 16777216 + o_custkey % 256 * 16777216 AS HUGEINT) AS w FROM orders), "
    "a AS (SELECT k, CAST((374761393 + 4 + w * 3266489917) % 4294967296 AS BIGINT) AS x FROM words), "
    f"b AS (SELECT k, CAST(CAST({_ROT} AS HUGEINT) * 668265263 % 4294967296 AS BIGINT) AS x FROM a), "
    "c AS (SELECT k, CAST(CAST(xor(x, x >> 15) AS HUGEINT) * 2246822519 % 4294967296 AS BIGINT) AS x FROM b), "
    "d AS (SELECT k, CAST(CAST(xor(x, x >> 13) AS HUGEINT) * 3266489917 % 4294967296 AS BIGINT) AS x FROM c)"
)


@query(f"WITH {_XXH32} SELECT k, xor(x, x >> 16) AS checksum FROM d")
def block_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of values of four bytes."""
    k = F.col("o_orderkey")
    value = [F.lpad(F.hex((v % 256).cast("long")), 2, "0") for v in (k, F.floor(k / 256), F.floor(k / 65536), F.col("o_custkey"))]
    rows = views.read(spark, sf_dir, "orders").select(k.alias("k"), F.unhex(F.concat(*value)).alias("v"))
    return rows.select("k", text.xxh32_column("v").alias("checksum"))


@query("SELECT o_orderkey AS k, CAST(floor(o_orderkey * 97.7) - 100 AS BIGINT) AS seconds FROM orders")
def file_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in tenths of microseconds since 1601 as seconds since 1970."""
    return views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), directory.filetime_to_seconds(F.expr("116444736000000000L - 1000000000L + o_orderkey * 977L * 1000000L")).alias("seconds"))


@query("SELECT o_orderkey AS k, CAST(CASE o_orderkey % 20 WHEN 1 THEN 'MemoryError' WHEN 2 THEN 'OSError' WHEN 7 THEN 'OverflowError' WHEN 8 THEN 'IndexError' WHEN 12 THEN 'NotADirectoryError' WHEN 13 THEN 'FileNotFoundError' WHEN 14 THEN 'RecursionError' WHEN 15 THEN 'IsADirectoryError' WHEN 16 THEN 'ValueError' WHEN 0 THEN NULL WHEN 18 THEN NULL WHEN 19 THEN NULL ELSE 'ImageError' END AS VARCHAR) AS error FROM orders")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), numbers.error_class(-(F.col("o_orderkey") % 20)).alias("error"))


@query(f"WITH {views.TREE} SELECT path, CAST(5 AS BIGINT) AS uid, gid, CAST(1700000000 AS BIGINT) AS mtime, (mode & 61440) | 488 AS mode FROM tree")
def default_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes replaced by defaults as they are given on a command line, the time by that of the environment."""
    defaults = rules.parse_defaults("uid=5,mode=0750")
    defaults["mtime"] = rules.source_date({"SOURCE_DATE_EPOCH": "1700000000"})
    return E.override(views.tree(spark, sf_dir), keep=["gid"], **defaults).select("path", "uid", "gid", "mtime", "mode")


@query(f"WITH {views.CONTENTS} SELECT path, key, value FROM (SELECT path, 'user.text' AS key, md5('say \"' || string_split(path, '/')[1] || '\"') AS value FROM contents UNION ALL SELECT path, 'user.hex', md5(text) FROM contents WHERE seq % 2 = 0 UNION ALL SELECT path, 'user.hex', md5('later') FROM contents WHERE seq % 2 = 1)")
def attribute_map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map file with a block for each document: quoted text, hex digits, and a setting that a later one replaces."""
    docs = views.read_spread(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "source", "doc_id", F.col("text").cast("binary").alias("v"))
    wanted = [
        F.concat(F.lit("# file: /"), "path"),
        F.lit("# a remark"),
        F.concat(F.lit('user.text="say \\"'), "source", F.lit('\\""')),
        F.concat(F.lit("user.hex=0x"), F.hex("v")),
        F.when(F.col("doc_id") % 2 == 1, F.lit('  user.hex="later"  ')),
    ]
    lines = docs.select(F.col("doc_id"), F.posexplode(F.array(*wanted)).alias("at", "line")).where("line is not null").select((F.col("doc_id") * 8 + F.col("at") + 1).cast("long").alias("line_no"), "line")
    parsed = rules.parse_attribute_map(lines).where("error is null")
    found = attributes.apply_map(docs.select("path"), parsed)
    return found.select("path", "key", F.md5("value").alias("value"))


# --- directories ----------------------------------------------------------------------------------------------------------------


def _unpacked(spark: SparkSession, rows: DataFrame, name: str) -> str:
    import os

    top = _shared(spark, name)
    os.makedirs(top, exist_ok=True)
    directory.unpack(rows, top, times=True, permissions=True).count()
    return top


@query(f"WITH {views.CONTENTS} SELECT path, 33184 AS mode, CAST(seq AS BIGINT) AS mtime, CAST(octet_length(content) AS BIGINT) AS size, md5(text) AS digest FROM contents")
def directory_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents unpacked to a folder, with times and permissions, and scanned again."""
    rows = tree.with_implied(views.contents(spark, sf_dir).withColumns({"mode": F.lit(0o100640), "uid": F.lit(0).cast("long"), "gid": F.lit(0).cast("long"), "mtime": F.col("seq")}))
    top = _unpacked(spark, rows, "unpacked")
    found = directory.scan_directory(spark, top)
    return found.where(modes.is_type(F.col("mode"), modes.FILE)).select("path", "mode", "mtime", "size", F.md5("content").alias("digest"))


_OWN = "own AS (SELECT path, seq, text, CASE WHEN seq % 10 = 3 THEN text || '!' ELSE text END AS other FROM contents)"


@query(f"WITH {views.CONTENTS}, {_OWN} SELECT 'old' AS side, path, md5(text) AS digest FROM own WHERE seq % 10 IN (3, 5) UNION ALL SELECT 'new', path, md5(other) FROM own WHERE seq % 10 IN (3, 7)")
def extract_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two trees that differ, or that one of them lacks."""
    rows = views.contents(spark, sf_dir).withColumn("mode", F.lit(0o100644))
    changed = F.when(F.col("seq") % 10 == 3, F.concat(F.col("content").cast("string"), F.lit("!")).cast("binary")).otherwise(F.col("content"))
    old = rows.where("seq % 10 != 7").select("path", "mode", "content")
    new = rows.where("seq % 10 != 5").select("path", "mode", changed.alias("content"))
    return diff.extract(old, new).select("side", "path", F.md5("content").alias("digest"))


# --- whole runs of the engine ------------------------------------------------------------------------------------------------------


@query(f"WITH {views.CONTENTS} SELECT path, md5(text) AS digest FROM contents WHERE seq = (SELECT min(seq) FROM contents)")
def cat_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file's bytes out of an image."""
    rows = views.contents(spark, sf_dir).withColumn("mode", F.lit(0o100644))
    first = rows.agg(F.min_by("path", "seq")).first()[0]
    engine = Engine(spark)
    entries = engine.image(_image(spark, rows, "cat.img"))
    return spark.createDataFrame([(first, bytearray(engine.cat(entries, first)))], "path string, content binary").select("path", F.md5("content").alias("digest"))


@query(f"WITH {views.TREE} SELECT path, mode, CASE WHEN (mode & 61440) IN (8192, 24576) THEN ((rdev & 1048320) >> 8 << 8) | (rdev & 255) END AS rdev, target FROM files")
def engine_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tree with links, devices and pipes packed into an image and inspected."""
    engine = Engine(spark)
    path = _shared(spark, "pack.img")
    engine.pack(views.tree(spark, sf_dir).select("path", "mode", "uid", "gid", "mtime", "rdev", "target"), path, compressor="gzip", block_size=4096)
    found = engine.image(path, content=False, slices=4).where(~modes.is_type(F.col("mode"), modes.DIRECTORY))
    # a link's permissions are always those of links
    return found.select("path", "mode", F.when(modes.is_type(F.col("mode"), modes.BLOCK, modes.CHARACTER), F.col("rdev")).alias("rdev"), "target")


@query(f"WITH {views.CONTENTS} SELECT path, CAST(seq AS BIGINT) AS mtime, md5(text) AS digest FROM contents")
def engine_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image turned into an archive, and the archive into an image."""
    engine = Engine(spark)
    rows = views.contents(spark, sf_dir).withColumns({"mode": F.lit(0o100644), "uid": F.lit(1).cast("long"), "gid": F.lit(2).cast("long"), "mtime": F.col("seq")})
    archive, second = _shared(spark, "convert.tar"), _shared(spark, "convert.img")
    engine.to_tar(engine.image(_image(spark, rows, "first.img")), archive, hard_links=False)
    engine.from_tar(archive, second, compressor="gzip", block_size=8192)
    found = engine.image(second, slices=4).where(modes.is_type(F.col("mode"), modes.FILE))
    return found.select("path", "mtime", F.md5("content").alias("digest"))


@query(f"WITH {views.CONTENTS} SELECT path, CASE WHEN seq % 10 = 5 THEN '<' WHEN seq % 10 = 7 THEN '>' ELSE 'content' END AS difference FROM contents WHERE seq % 10 IN (5, 7) OR (seq % 10 = 3)")
def engine_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two images compared: files on one side, and files whose contents differ."""
    rows = views.contents(spark, sf_dir).withColumn("mode", F.lit(0o100644))
    changed = F.when(F.col("seq") % 10 == 3, F.concat(F.col("content").cast("string"), F.lit("!")).cast("binary")).otherwise(F.col("content"))
    old = _image(spark, rows.where("seq % 10 != 7"), "old.img")
    new = _image(spark, rows.where("seq % 10 != 5").withColumn("content", changed), "new.img")
    found = Engine(spark).diff_images(old, new)
    # a folder may be on one side only, too
    return found.where(F.col("path").rlike("/[0-9]+$"))


@query(f"WITH {views.CONTENTS} SELECT path, CAST(seq AS BIGINT) AS mtime, md5(text) AS digest FROM contents WHERE path LIKE 'src1%'")
def engine_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of an image unpacked, with times, and scanned: those that begin with src1, one after another."""
    import os

    engine = Engine(spark)
    rows = views.contents(spark, sf_dir).withColumns({"mode": F.lit(0o100644), "mtime": F.col("seq")})
    entries = engine.image(_image(spark, rows, "unpack.img"))
    top = _shared(spark, "engine-unpacked")
    os.makedirs(top, exist_ok=True)
    wanted = entries.where(F.col("path").startswith("src1") | (F.col("path") == ""))
    engine.unpack(wanted, top, times=True).count()
    found = engine.directory(top, hard_links=False)
    return found.where(modes.is_type(F.col("mode"), modes.FILE)).select("path", "mtime", F.md5("content").alias("digest"))


# --- streams ------------------------------------------------------------------------------------------------------------------------


def _ended(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """All rows that a stream gives until nothing new is there."""
    out = _shared(spark, name)
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _chunks(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of chunks of 700 bytes, the first two of each file in one wave and the others in a second."""
    import glob
    import os

    out = _shared(spark, name)
    cut = blocks.split(views.contents(spark, sf_dir), 700, tails=False).select("path", F.col("idx").alias("seq"), "data", "last")
    cut.where("seq < 2").write.parquet(f"{out}/wave=1")
    first = max(1, len(glob.glob(f"{out}/wave=1/*.parquet")))
    # files are taken by their time: the second wave's are later
    cut.where("seq >= 2").write.parquet(f"{out}/wave=2")
    later = max(os.stat(f).st_mtime for f in glob.glob(f"{out}/wave=1/*.parquet")) + 5
    for f in glob.glob(f"{out}/wave=2/*.parquet"):
        os.utime(f, (later, later))
    return spark.readStream.schema("path string, seq long, data binary, last boolean, wave int").option("maxFilesPerTrigger", first).parquet(out).drop("wave")


@query(f"WITH {_B} SELECT path, CAST(idx AS BIGINT) AS idx, CAST(size AS BIGINT) AS size, md5(h) AS digest, last FROM pieces")
def stream_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that arrive in two waves cut into blocks; what doesn't fill one waits for more."""
    done = _ended(ingest.cut_stream(_chunks(spark, sf_dir, "chunks"), BLOCK), spark, "cut")
    return done.select("path", "idx", F.octet_length("data").cast("long").alias("size"), F.md5(F.hex("data")).alias("digest"), "last")


@query(f"WITH {_B} SELECT DISTINCT md5(h) AS digest, CAST(size AS BIGINT) AS size FROM pieces")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a stream, each different one once."""
    out = _shared(spark, "pieces")
    _pieces(spark, sf_dir).select("path", "idx", "size", "data").write.parquet(out)
    stream = spark.readStream.schema("path string, idx long, size long, data binary").option("maxFilesPerTrigger", 2).parquet(out)
    return _ended(ingest.first_seen(stream), spark, "seen").select(F.md5(F.hex("data")).alias("digest"), "size")


@query(f"WITH {views.CONTENTS}, {_HEX} SELECT path, CAST(least(n, 1500) AS BIGINT) AS size FROM hexed WHERE n > 0")
def stream_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1500 bytes of each file out of a stream of chunks."""
    done = _ended(ingest.splice(_chunks(spark, sf_dir, "spliced"), 1500), spark, "splice")
    return done.groupBy("path").agg(F.sum(F.octet_length("data")).cast("long").alias("size"))


@query(f"WITH {views.CONTENTS} SELECT path, CAST(octet_length(content) AS BIGINT) AS size, md5(text) AS digest, CAST(4 AS BIGINT) AS batches FROM contents")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four archives that arrive in a folder, one a batch, written to a table as they come."""
    import os

    folder, out = _shared(spark, "incoming"), _shared(spark, "ingested")
    os.makedirs(folder, exist_ok=True)
    rows = views.contents(spark, sf_dir).withColumn("mode", F.lit(0o100644))
    for part in range(4):
        tar.write_tar(rows.where(F.col("seq") % 4 == part), f"{folder}/{part}.tar")
    ingest.ingest(ingest.archives(spark, folder, files_at_a_time=1), f"{out}/rows", f"{out}/state").awaitTermination()
    found = spark.read.parquet(f"{out}/rows")
    batches = found.agg(F.countDistinct("batch").alias("batches"))
    return found.crossJoin(F.broadcast(batches)).select("path", "size", F.md5("content").alias("digest"), "batches")


# --- functions as extension points -----------------------------------------------------------------------------------------------------


@query(f"WITH {views.CONTENTS} SELECT path, sha256(text) AS digest FROM contents")
def worker_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's own function of bytes, run by the workers on batches."""
    from hashlib import sha256

    digest = codecs.block_function(lambda data: sha256(data).hexdigest().encode())
    return views.contents(spark, sf_dir).select("path", digest("content").cast("string").alias("digest"))
