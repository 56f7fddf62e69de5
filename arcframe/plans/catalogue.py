"""The queries over the driver tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, modes, numbers, paths, text
from ..operators import attributes, blocks, dictionary, diff, inodes, links, rules, tree
from ..operators import entries as E
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BLOCK = 1024


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _first_folder(spark: SparkSession, sf_dir: str) -> str:
    return views.folders(spark, sf_dir).where("path like '%/%/%'").agg(F.min("path")).first()[0]


# --- listing and projections --------------------------------------------------------------------------------------

_PRINTED = f"CASE (mode & 61440) WHEN 40960 THEN {views.sql_size('strlen(target)')} WHEN 32768 THEN {views.sql_size('size')} WHEN 16384 THEN {views.sql_size('size')} WHEN 24576 THEN CAST((rdev & 1048320) >> 8 AS VARCHAR) || ':' || CAST((rdev & 255) | ((rdev >> 12) & 1048320) AS VARCHAR) WHEN 8192 THEN CAST((rdev & 1048320) >> 8 AS VARCHAR) || ':' || CAST((rdev & 255) | ((rdev >> 12) & 1048320) AS VARCHAR) ELSE '0' END"


@query(
    f"WITH {views.TREE}, here AS (SELECT *, {_PRINTED} AS printed FROM parted WHERE parent_path = (SELECT min(path) FROM folders WHERE path LIKE '%/%/%')), wide AS (SELECT max(length(CAST(uid AS VARCHAR))) u, max(length(CAST(gid AS VARCHAR))) g, max(length(printed)) p FROM here) "
    f"SELECT name, {views.sql_mode('mode')} || ' ' || lpad(CAST(uid AS VARCHAR), CAST(u AS INT), ' ') || '/' || rpad(CAST(gid AS VARCHAR), CAST(g AS INT), ' ') || ' ' || lpad(printed, CAST(p AS INT), ' ') || ' ' || name || CASE WHEN (mode & 61440) = 40960 THEN ' -> ' || target ELSE '' END AS line FROM here, wide"
)
def list_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of the first customer's folder; its ids have one digit, where both ways of counting agree."""
    return E.list_directory(views.tree(spark, sf_dir), _first_folder(spark, sf_dir))


@query(
    f"WITH {views.TREE} SELECT path, {views.sql_mode('mode')} AS mode_text, {views.sql_octal('mode')} AS permissions, uid, gid, size, strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%a, %d %b %Y %H:%M:%S') AS modified, target FROM tree WHERE key = 7"
)
def stat_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.tree(spark, sf_dir)
    path = rows.where("key = 7").select("path").first()[0]
    return E.stat(rows.drop("rdev", "key"), path)


@query(
    f"WITH {views.TREE} SELECT path, CASE (mode & 61440) WHEN 49152 THEN 'sock' WHEN 40960 THEN 'slink' WHEN 4096 THEN 'pipe' WHEN 32768 THEN 'file' WHEN 16384 THEN 'dir' ELSE 'nod' END || ' ' || CASE WHEN contains(path, ' ') THEN chr(34) || path || chr(34) ELSE path END || ' ' || {views.sql_octal('mode')} || ' ' || CAST(uid AS VARCHAR) || ' ' || CAST(gid AS VARCHAR) || "
    "CASE (mode & 61440) WHEN 40960 THEN ' ' || target WHEN 8192 THEN ' c ' || CAST((rdev & 1048320) >> 8 AS VARCHAR) || ' ' || CAST(rdev & 255 AS VARCHAR) WHEN 24576 THEN ' b ' || CAST((rdev & 1048320) >> 8 AS VARCHAR) || ' ' || CAST(rdev & 255 AS VARCHAR) ELSE '' END AS line FROM tree WHERE path <> ''"
)
def describe_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.describe(views.tree(spark, sf_dir))


@query(f"WITH {views.TREE} SELECT path, uid, CAST(0 AS BIGINT) AS gid, CAST(1000 AS BIGINT) AS mtime, (mode & 61440) | 448 AS mode FROM tree")
def override_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.override(views.tree(spark, sf_dir), keep=["uid"], mtime=1000, mode=0o700).select("path", "uid", "gid", "mtime", "mode")


@query(
    f"WITH {views.TREE}, top AS (SELECT min(r_name) AS top FROM named), inside AS (SELECT substr(path, length(top) + 2) AS rest, mode FROM tree, top WHERE starts_with(path, top || '/')), "
    "under AS (SELECT 'img/' || rest AS path, mode FROM inside UNION ALL SELECT 'img', mode FROM tree, top WHERE path = top) SELECT path || CASE WHEN (mode & 61440) = 16384 THEN '/' ELSE '' END AS path, mode FROM under"
)
def reroot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region as an archive names it, under a root of its own."""
    top = views.read(spark, sf_dir, "region").agg(F.min("r_name")).first()[0]
    return E.reroot_out(views.tree(spark, sf_dir), [top], "img").select("path", "mode")


@query(
    f"WITH {views.TREE}, top AS (SELECT min(r_name) AS top FROM named) SELECT CASE WHEN path = top THEN '' ELSE substr(path, length(top) + 2) END AS path, mode, CASE WHEN key % 5 = 0 AND target IS NOT NULL THEN 'x' || CAST(key AS VARCHAR) ELSE target END AS target FROM tree, top WHERE path = top OR starts_with(path, top || '/')"
)
def root_becomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region as the root of a tree; hard links to paths in it are made to follow."""
    top = views.read(spark, sf_dir, "region").agg(F.min("r_name")).first()[0]
    hard = F.coalesce((F.col("key") % 5 == 0) & F.col("target").isNotNull(), F.lit(False))
    rows = views.tree(spark, sf_dir).withColumns({"hard_link": hard, "target": F.when(hard, F.concat(F.lit(top + "/x"), F.col("key").cast("string"))).otherwise(F.col("target"))})
    return E.reroot_in(rows, top).select("path", "mode", "target")


# --- filters --------------------------------------------------------------------------------------------------------


@query(f"WITH {views.TREE} SELECT path, mode FROM tree WHERE (mode & 61440) IN (32768, 40960)")
def find_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.of_types(views.tree(spark, sf_dir), ["f", "l"]).select("path", "mode")


@query(f"WITH {views.TREE} SELECT path, mode FROM tree WHERE (mode & 61440) NOT IN (8192, 24576, 49152, 4096, 16384)")
def without_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.without_types(views.tree(spark, sf_dir), modes.CHARACTER, modes.BLOCK, modes.SOCKET, modes.FIFO)
    return E.without_directories(rows).select("path", "mode")


@query(
    f"WITH {views.URLS}, n AS (SELECT *, string_split(path, '/')[-1] AS name FROM canonical) SELECT page_id, path FROM n WHERE regexp_full_match(name, '[1-7][0-9].*') AND regexp_full_match(name, '.*[^.]..') AND NOT regexp_full_match(name, '[1-7][0-9].*[^0-9].*[^.]..')"
)
def find_name_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.urls(spark, sf_dir).withColumn("path", paths.canonicalize(F.col("raw")))
    matches = lambda pattern: paths.glob(paths.name(F.col("path")), pattern)
    return rows.where(matches("[1-7][0-9]*") & matches("*[!.]??") & ~matches("[1-7][0-9]*[!0-9]*[!.]??")).select("page_id", "path")


@query(f"WITH {views.URLS} SELECT page_id, path FROM canonical WHERE regexp_full_match(path, '[^/]*th[^/]*/[ef][^/]/[^/]*')")
def find_path_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.urls(spark, sf_dir).withColumn("path", paths.canonicalize(F.col("raw")))
    return E.path_matches(rows, "*th*/[ef]?/*").select("page_id", "path")


@query(f"WITH {views.TREE} SELECT path, CAST(depth AS INT) AS depth FROM parted WHERE depth <= 2")
def max_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.up_to_depth(E.with_parts(views.tree(spark, sf_dir)), 2).select("path", "depth")


@query(f"WITH {views.TREE} SELECT path FROM parted WHERE depth = 1")
def no_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_level(views.tree(spark, sf_dir)).select("path")


_TOPS = "tops AS (SELECT folder AS top FROM named WHERE c_custkey = 3 UNION SELECT n_path FROM named WHERE c_custkey = 4)"


@query(f"WITH {views.TREE}, {_TOPS} SELECT DISTINCT path FROM tree, tops WHERE path = top OR starts_with(path, top || '/') OR starts_with(top, path || '/') OR path = ''")
def subtree_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.tree(spark, sf_dir)
    customers = views.read(spark, sf_dir, "customer").where("c_custkey in (3, 4)").select("c_custkey", "c_name").collect()
    name = {r.c_custkey: r.c_name for r in customers}
    folder = {k: views.folders(spark, sf_dir).where(F.col("path").endswith("/" + n)).first().path for k, n in name.items()}
    return E.select_subtrees(rows, [folder[3], folder[4].rpartition("/")[0]]).select("path")


@query(f"WITH {views.TREE} SELECT path FROM tree WHERE NOT contains(path, 'NATION_1') AND NOT regexp_matches(path, '[13579]$')")
def subtree_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.exclude_globs(views.tree(spark, sf_dir), ["*NATION_1*", "*[13579]"]).select("path")


@query(
    f"WITH {views.TREE}, more AS (SELECT path, mode, parts FROM parted UNION ALL SELECT ltrim(path || '/empty', '/'), 16877, list_append(CASE WHEN path = '' THEN [] ELSE parts END, 'empty') FROM parted WHERE key IS NULL UNION ALL SELECT ltrim(path || '/empty/deeper', '/'), 16877, list_append(list_append(CASE WHEN path = '' THEN [] ELSE parts END, 'empty'), 'deeper') FROM parted WHERE key IS NULL), "
    "held AS (SELECT DISTINCT array_to_string(list_slice(parts, 1, n), '/') AS path FROM more, range(1, 6) r(n) WHERE (mode & 61440) <> 16384 AND n < len(parts)) SELECT path FROM more WHERE (mode & 61440) <> 16384 OR path = '' OR path IN (SELECT path FROM held)"
)
def prune_empty_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tree, with empty folders, one in the other, put into each of its folders."""
    rows = views.tree(spark, sf_dir).select("path", "mode", "key")
    empty = lambda name: rows.where("key is null").select(F.ltrim(F.concat("path", F.lit(name)), F.lit("/")).alias("path"), F.lit(0o040755).alias("mode"))
    rows = rows.select("path", "mode")
    return E.prune_empty(rows.unionByName(empty("/empty")).unionByName(empty("/empty/deeper"))).select("path")


@query(f"WITH {views.URLS}, there AS (SELECT DISTINCT string_split(path, '/')[1] AS host FROM canonical WHERE page_id % 3 = 0) SELECT DISTINCT path FROM canonical WHERE string_split(path, '/')[1] IN (SELECT host FROM there) AND (len(string_split(path, '/')) <= 2 OR string_split(path, '/')[2] = 'en') AND contains(path, '/')")
def existing_parent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.urls(spark, sf_dir).withColumn("path", paths.canonicalize(F.col("raw")))
    host = F.substring_index("path", "/", 1)
    directories = rows.where("page_id % 3 = 0").select(host.alias("path")).union(rows.select(F.concat(host, F.lit("/en")).alias("path"))).distinct().withColumn("mode", F.lit(modes.DIRECTORY))
    return E.with_parents_in(rows.where(F.col("path").contains("/")).select("path").distinct(), directories)


@query(f"WITH {views.TREE} SELECT path, CAST(count(*) AS BIGINT) AS count FROM (SELECT path FROM tree UNION ALL SELECT path FROM tree WHERE key % 101 = 1) GROUP BY path HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.tree(spark, sf_dir).select("path", "key")
    return E.duplicates(rows.union(rows.where("key % 101 = 1")))


@query(f"WITH {views.URLS} SELECT page_id, path, NOT (list_contains(string_split(path, '/'), '') OR list_contains(string_split(path, '/'), '..')) AS sane FROM canonical")
def sane_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.urls(spark, sf_dir).withColumn("path", paths.canonicalize(F.col("raw")))
    return rows.select("page_id", "path", F.forall(F.split("path", "/"), lambda x: paths.is_sane_name(x)).alias("sane"))


# --- trees ------------------------------------------------------------------------------------------------------------


@query(f"WITH {views.URLS} SELECT page_id, raw, CASE WHEN list_contains(string_split(raw, '/'), '..') THEN NULL ELSE path END AS path FROM canonical")
def canonicalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.urls(spark, sf_dir).select("page_id", "raw", paths.canonicalize(F.col("raw")).alias("path"))


@query(
    f"WITH {views.URLS}, steps AS (SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS path FROM canonical, range(1, 12) r(n) WHERE n < len(string_split(path, '/')) UNION SELECT '') SELECT path, 16877 AS mode FROM steps WHERE path NOT IN (SELECT path FROM canonical)"
)
def implied_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.urls(spark, sf_dir).select(paths.canonicalize(F.col("raw")).alias("path")).distinct()
    return tree.implied_directories(rows).select("path", "mode")


@query(
    f"WITH RECURSIVE {views.TREE}, ids AS (SELECT path, parent_path, name, mode, row_number() OVER (ORDER BY path) AS id FROM parted), adjacent AS (SELECT c.id, p.id AS up, c.name FROM ids c JOIN ids p ON c.parent_path = p.path), "
    "walk AS (SELECT id, '' AS path, 0 AS depth FROM ids WHERE path = '' UNION ALL SELECT a.id, CASE WHEN w.path = '' THEN a.name ELSE w.path || '/' || a.name END, w.depth + 1 FROM walk w JOIN adjacent a ON a.up = w.id) SELECT path, depth FROM walk"
)
def recursive_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree from its rows (directory, name, entry), level by level."""
    rows = E.with_parts(views.tree(spark, sf_dir)).withColumn("id", F.xxhash64("path"))
    root = rows.where("path = ''").select("id").first()[0]
    kind = F.when(modes.is_type(F.col("mode"), modes.DIRECTORY), 1).otherwise(2)
    dirents = rows.where("path != ''").select(F.xxhash64("parent_path").alias("parent_inode"), "name", F.col("id").alias("inode"), kind.alias("type"))
    return tree.walk(dirents, root).select("path", "depth")


@query(
    f"WITH {views.TREE}, wanted AS (SELECT path AS asked, path FROM files WHERE key % 50 = 1 UNION ALL SELECT path || '/below', path || '/below' FROM files WHERE key % 50 = 2 UNION ALL SELECT '/' || path || '/', path FROM folders WHERE path <> '' UNION ALL SELECT path || '/none', path || '/none' FROM folders WHERE path <> '') "
    "SELECT asked, path, mode, CASE WHEN mode IS NOT NULL THEN NULL WHEN ends_with(path, '/below') THEN 'not a directory' ELSE 'no such entry' END AS error FROM wanted LEFT JOIN (SELECT path, mode FROM tree) USING (path)"
)
def resolve_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.tree(spark, sf_dir).select("path", "mode", "key")
    folders = rows.where("key is null and path != ''")
    wanted = [rows.where("key % 50 = 1").select("path"), rows.where("key % 50 = 2").select(F.concat("path", F.lit("/below")).alias("path"))]
    wanted += [folders.select(F.concat(F.lit("/"), "path", F.lit("/")).alias("path")), folders.select(F.concat("path", F.lit("/none")).alias("path"))]
    asked = wanted[0]
    for more in wanted[1:]:
        asked = asked.union(more)
    return tree.resolve(rows.select("path", "mode"), asked).select("asked", "path", "mode", "error")


@query(
    f"WITH {views.TREE} SELECT CAST(count(*) FILTER (WHERE (mode & 61440) = 32768) AS BIGINT) AS files, CAST(count(*) FILTER (WHERE (mode & 61440) = 16384) AS BIGINT) AS directories, CAST(count(*) FILTER (WHERE (mode & 61440) IN (4096, 49152)) AS BIGINT) AS ipc, "
    "CAST(count(*) FILTER (WHERE (mode & 61440) IN (8192, 24576)) AS BIGINT) AS devices, CAST(0 AS BIGINT) AS hard_links, CAST(count(*) FILTER (WHERE (mode & 61440) = 40960) AS BIGINT) AS symlinks FROM tree"
)
def tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.statistics(views.tree(spark, sf_dir).withColumn("hard_link", F.lit(False)))


@query(f"WITH {views.TREE} SELECT p.path, CAST(CASE WHEN (p.mode & 61440) = 16384 THEN 2 ELSE 1 END + count(c.path) AS BIGINT) AS nlink FROM tree p LEFT JOIN parted c ON c.parent_path = p.path GROUP BY p.path, p.mode")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.link_counts(views.tree(spark, sf_dir).withColumn("hard_link", F.lit(False)))


_NUMBERS = "numbers AS (SELECT path, uid, gid, row_number() OVER (ORDER BY CASE WHEN path = '' THEN 1 ELSE 0 END, list_append(CASE WHEN parent_path IS NULL OR parent_path = '' THEN [] ELSE string_split(parent_path, '/') END, chr(1114111)), name) AS inode FROM parted)"


@query(f"WITH {views.TREE}, {_NUMBERS} SELECT path, CAST(inode AS BIGINT) AS inode FROM numbers")
def inode_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.inode_numbers(views.tree(spark, sf_dir))


@query(
    f"WITH {views.TREE}, {_NUMBERS}, used AS (SELECT uid AS id, inode * 2 AS place FROM numbers UNION ALL SELECT gid, inode * 2 + 1 FROM numbers) SELECT id, CAST(row_number() OVER (ORDER BY first) - 1 AS BIGINT) AS idx FROM (SELECT id, min(place) AS first FROM used GROUP BY id)"
)
def id_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.tree(spark, sf_dir)
    return dictionary.id_dictionary(rows.join(tree.inode_numbers(rows), "path"))


@query(f"WITH {views.TREE}, {_NUMBERS}, kept AS (SELECT inode FROM numbers WHERE inode % 7 <> 3) SELECT CAST(i AS BIGINT) AS inode, CASE WHEN i % 7 <> 3 THEN CAST(i * 65536 + i % 8192 AS BIGINT) END AS ref FROM range(1, (SELECT max(inode) + 1 FROM kept)) r(i)")
def export_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inode references by number, every seventh number left out."""
    numbered = tree.inode_numbers(views.tree(spark, sf_dir)).where("inode % 7 != 3")
    return inodes.export_table(numbered.select("inode", (F.col("inode") * 65536 + F.col("inode") % 8192).alias("ref")))


@query(
    f"WITH {views.TREE}, {_NUMBERS}, held AS (SELECT p.inode AS parent_inode, n.path, n.inode, string_split(n.path, '/')[-1] AS name FROM numbers n JOIN parted t USING (path) JOIN numbers p ON p.path = t.parent_path), "
    "marked AS (SELECT *, inode // 100 AS block, CASE WHEN lag(inode // 100) OVER (PARTITION BY parent_inode ORDER BY name) IS DISTINCT FROM inode // 100 THEN 1 ELSE 0 END AS fresh FROM held), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY parent_inode ORDER BY name) - 1 AS run FROM marked) "
    "SELECT CAST(parent_inode AS BIGINT) AS parent_inode, CAST(run AS BIGINT) AS run, CAST(block AS BIGINT) AS start, CAST(arg_min(inode, name) AS BIGINT) AS first, min(name) AS name, CAST(count(*) AS BIGINT) AS entries, CAST(12 + sum(8 + strlen(name)) AS BIGINT) AS bytes FROM runs GROUP BY parent_inode, run, block"
)
def directory_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of directories whose inodes lie a hundred to a block; none is long enough for the other rules."""
    rows = views.tree(spark, sf_dir)
    numbered = tree.inode_numbers(rows)
    inside = E.with_parts(numbered).where("path != ''")
    parents = numbered.select(F.col("path").alias("parent_path"), F.col("inode").alias("parent_inode"))
    return inodes.directory_runs(inside.join(parents, "parent_path").select("parent_inode", "name", "inode", (F.floor(F.col("inode") / 100) * 65536).alias("ref")))


@query(f"WITH {views.TREE} SELECT path, (mode & 61440) = 32768 AND (size > 40000000 OR key % 6 = 1) OR key % 9 = 2 AS extended, CASE WHEN (mode & 61440) = 32768 THEN CAST(size // 4096 + CASE WHEN key % 2 = 0 AND size % 4096 > 0 THEN 1 ELSE 0 END AS BIGINT) ELSE 0 END AS blocks FROM files")
def inode_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which inodes need the extended layout, and how many blocks they have."""
    key = F.col("key")
    none = F.lit(None).cast("long")
    rows = views.files(spark, sf_dir).withColumns({
        "xattr_index": F.when(key % 9 == 2, key), "dir_index": F.lit(None).cast("array<int>"), "nlink": F.when(key % 6 == 1, 2).otherwise(1), "sparse_bytes": none,
        "block_start": F.when(F.col("size") > 40000000, F.lit(2**32)), "fragment": F.when(key % 2 == 1, key), "fragment_offset": none,
    })
    return rows.select("path", inodes.needs_extended().alias("extended"), inodes.block_count(4096).alias("blocks"))


@query("WITH h AS (SELECT o_orderkey AS k, o_orderkey % 100 AS a FROM orders) SELECT k, a NOT BETWEEN 10 AND 19 AND a NOT BETWEEN 50 AND 79 AS hole, CAST(CASE WHEN a < 10 THEN 10 - a WHEN a BETWEEN 20 AND 49 THEN 50 - a WHEN a >= 80 THEN 100 - a ELSE 0 END AS BIGINT) AS left_over FROM h")
def sparse_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets in a file of 100 bytes whose data are at 10 to 19 and 50 to 79."""
    extents = F.array(*[F.struct(F.lit(a).cast("long").alias("offset"), F.lit(n).cast("long").alias("count")) for a, n in ((10, 10), (50, 30))])
    at = F.col("o_orderkey") % 100
    rows = views.read(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("k"), inodes.in_hole(extents, at).alias("hole"), inodes.to_next_data(extents, at, F.lit(100)).cast("long").alias("left_over"))


@query(f"WITH {views.TREE} SELECT name, CAST(row_number() OVER (ORDER BY min(path), name) - 1 AS BIGINT) AS idx, CAST(count(*) AS BIGINT) AS uses FROM parted WHERE path <> '' GROUP BY name")
def name_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.value_dictionary(E.with_parts(views.tree(spark, sf_dir)).where("path != ''"), "name", "path")


@query(f"WITH {views.TREE} SELECT path, CAST(row_number() OVER (ORDER BY parts) - 1 AS BIGINT) AS seq FROM parted WHERE (mode & 61440) = 32768")
def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.file_list(views.tree(spark, sf_dir)).select("path", "seq")


@query(f"WITH {views.TREE} SELECT path, repeat('  ', depth - 1) || name AS line FROM parted WHERE path <> ''")
def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tree_lines(views.tree(spark, sf_dir))


@query(f"WITH {views.TREE} SELECT path FROM tree WHERE NOT regexp_matches(path, 'Customer#[0-9]*7(/|$)')")
def one_filesystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree without the folders, and what is in them, that lie on a device of their own."""
    foreign = F.col("path").rlike("Customer#[0-9]*7(/|$)")
    return E.one_filesystem(views.tree(spark, sf_dir).withColumn("dev", F.when(foreign, 2).otherwise(1))).select("path")


@query(f"WITH {views.TREE}, {_NUMBERS} SELECT CAST(inode AS BIGINT) AS node, path FROM numbers")
def node_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths found by walking from each node to the root."""
    rows = views.tree(spark, sf_dir)
    numbered = E.with_parts(tree.inode_numbers(rows))
    parents = numbered.select(F.col("path").alias("parent_path"), F.col("inode").alias("parent"))
    return tree.path_of_nodes(numbered.join(parents, "parent_path", "left").select(F.col("inode").alias("node"), "parent", "name"))


@query(f"WITH {views.TREE} SELECT CAST(count(*) AS BIGINT) AS entries FROM tree")
def count_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.count_entries(views.tree(spark, sf_dir))


@query(f"WITH {views.TAGS} SELECT CAST(seq AS VARCHAR) AS path, key, key || '=' || CASE WHEN seq % 3 = 0 THEN '0x' || hex(encode(text || chr(1))) ELSE text END AS line FROM tags")
def xattr_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes as text, every third value made unprintable."""
    value = F.when(F.col("seq") % 3 == 0, F.concat("text", F.lit("\x01"))).otherwise(F.col("text"))
    return attributes.dump(views.tags(spark, sf_dir).select(F.col("seq").cast("string").alias("path"), "key", value.cast("binary").alias("value")))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 1 THEN 'gzip' WHEN 2 THEN 'lzma' WHEN 3 THEN 'lzo' WHEN 4 THEN 'xz' WHEN 5 THEN 'lz4' WHEN 6 THEN 'zstd' END AS name, CASE WHEN o_orderkey % 8 BETWEEN 1 AND 6 THEN CAST(o_orderkey % 8 AS INT) END AS id FROM orders")
def codec_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), codecs.codec_name(F.col("o_orderkey") % 8).alias("name"))
    return rows.select("k", "name", codecs.codec_id(F.col("name")).alias("id"))


# --- links ------------------------------------------------------------------------------------------------------------


@query(
    f"WITH {views.CONTENTS}, firsts AS (SELECT path, seq, first_value(path) OVER (PARTITION BY text ORDER BY seq) AS f FROM contents) SELECT path, path <> f AS hard_link, CASE WHEN path <> f THEN f END AS target FROM firsts"
)
def hard_link_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the same text as names of one file."""
    rows = views.contents(spark, sf_dir).select("path", "seq", F.lit(modes.FILE | 0o644).alias("mode"), F.lit(1).alias("dev"), F.md5("content").alias("inode"))
    return links.detect(rows).select("path", "hard_link", "target")


@query(
    "WITH RECURSIVE chain AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 < 7 AND o_orderkey % 10 > 0 THEN o_orderkey - 1 WHEN o_orderkey % 10 = 8 THEN o_orderkey + 1 WHEN o_orderkey % 10 = 9 THEN o_orderkey - 1 END AS target FROM orders), "
    "ends AS (SELECT id, target, id - id % 10 AS base FROM chain WHERE target IS NOT NULL) "
    "SELECT 'f' || CAST(id AS VARCHAR) AS path, 'f' || CAST(target AS VARCHAR) AS target, CASE WHEN id % 10 < 7 AND base % 30 <> 0 AND base IN (SELECT id FROM chain) THEN 'f' || CAST(base AS VARCHAR) END AS resolved, "
    "CASE WHEN id % 10 >= 8 THEN CASE WHEN (CASE WHEN id % 10 = 8 THEN id + 1 ELSE id - 1 END) IN (SELECT id FROM chain) THEN 'loop' ELSE 'missing' END WHEN base % 30 = 0 THEN 'directory' END AS error FROM ends"
)
def hard_link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of links to the first of ten, loops of two, and chains that end at directories."""
    k = F.col("o_orderkey")
    d = k % 10
    to = F.when((d > 0) & (d < 7), k - 1).when(d == 8, k + 1).when(d == 9, k - 1)
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    mode = F.when(k % 30 == 0, modes.DIRECTORY).otherwise(modes.FILE)
    rows = views.read(spark, sf_dir, "orders").select(name(k).alias("path"), mode.alias("mode"), to.isNotNull().alias("hard_link"), F.when(to.isNotNull(), name(to)).alias("target"))
    return links.resolve(rows)


# --- blocks -----------------------------------------------------------------------------------------------------------

_HEX = "hexed AS (SELECT path, seq, hex(content) AS h, octet_length(content) AS n FROM contents)"
_SPLIT = f"pieces AS (SELECT path, seq, i AS idx, least({BLOCK}, n - i * {BLOCK}) AS size, substr(h, CAST(i * {2 * BLOCK} + 1 AS BIGINT), {2 * BLOCK}) AS h, (i + 1) * {BLOCK} >= n AS last, n - i * {BLOCK} < {BLOCK} AS tail FROM hexed, range(0, 4000) r(i) WHERE i * {BLOCK} < n)"
_B = f"{views.CONTENTS}, {_HEX}, {_SPLIT}"


def _pieces(spark: SparkSession, sf_dir: str, tails: bool = True) -> DataFrame:
    return blocks.split(views.contents(spark, sf_dir), BLOCK, tails)


@query(f"WITH {_B} SELECT path, CAST(idx AS BIGINT) AS idx, CAST(size AS BIGINT) AS size, md5(h) AS digest, idx = 0 AS first, last, tail FROM pieces")
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("path", "idx", "size", F.md5(F.hex("data")).alias("digest"), "first", "last", "tail")


_ZERO = "CASE WHEN (seq + idx) % 7 = 0 THEN repeat('00', CAST(size AS BIGINT)) ELSE h END"


@query(f"WITH {_B} SELECT path, CAST(coalesce(sum(CASE WHEN regexp_full_match({_ZERO}, '(00)*') THEN size ELSE 0 END), 0) AS BIGINT) AS sparse_bytes FROM pieces GROUP BY path")
def sparse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes saved where every seventh block is made of zeros."""
    zeros = F.expr("unhex(repeat('00', cast(size as int)))")
    rows = _pieces(spark, sf_dir).withColumn("data", F.when((F.col("seq") + F.col("idx")) % 7 == 0, zeros).otherwise(F.col("data")))
    return blocks.sparse_bytes(rows)


@query(f"WITH {_B} SELECT sha256(unhex(h)) AS digest, CAST(size AS BIGINT) AS size, CAST(min(seq) AS BIGINT) AS first_seq, CAST(arg_min(idx, seq * 100000 + idx) AS BIGINT) AS first_idx, CAST(count(*) AS BIGINT) AS uses FROM pieces GROUP BY h, size")
def block_digest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.distinct_blocks(_pieces(spark, sf_dir))


@query(f"WITH {views.CONTENTS} SELECT path, CAST(seq AS BIGINT) AS seq, CASE WHEN f <> path THEN f END AS duplicate_of FROM (SELECT path, seq, first_value(path) OVER (PARTITION BY text ORDER BY seq) AS f FROM contents WHERE length(text) > 0)")
def file_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.duplicate_files(views.contents(spark, sf_dir))


@query(f"WITH {_B} SELECT path, CAST(seq AS BIGINT) AS seq, CAST(size AS BIGINT) AS size, CAST(min(seq) OVER (PARTITION BY h) AS BIGINT) AS first_seq FROM pieces WHERE tail")
def fragment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.distinct_tails(_pieces(spark, sf_dir)).select("path", "seq", "size", "first_seq")


_PACK = (
    f"tails AS (SELECT path, seq, size, min(seq) OVER (PARTITION BY h) AS first_seq FROM pieces WHERE tail), kept AS (SELECT seq, size, row_number() OVER (ORDER BY seq) AS r FROM tails WHERE seq = first_seq), "
    f"packed AS (SELECT r, seq, CAST(0 AS BIGINT) AS fragment, CAST(0 AS BIGINT) AS fragment_offset, CAST(size AS BIGINT) AS used FROM kept WHERE r = 1 UNION ALL SELECT k.r, k.seq, CASE WHEN p.used + k.size > {BLOCK} THEN p.fragment + 1 ELSE p.fragment END, CASE WHEN p.used + k.size > {BLOCK} THEN 0 ELSE p.used END, CASE WHEN p.used + k.size > {BLOCK} THEN k.size ELSE p.used + k.size END FROM packed p JOIN kept k ON k.r = p.r + 1)"
)


@query(f"WITH RECURSIVE {_B}, {_PACK} SELECT t.path, CAST(t.seq AS BIGINT) AS seq, CAST(t.size AS BIGINT) AS size, CAST(fragment AS BIGINT) AS fragment, CAST(fragment_offset AS BIGINT) AS fragment_offset FROM tails t JOIN packed p ON t.first_seq = p.seq")
def fragment_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.pack_tails(_pieces(spark, sf_dir), BLOCK)


@query(f"WITH {_B} SELECT path, CAST(idx AS BIGINT) AS idx, CAST(idx * {BLOCK} AS BIGINT) AS at, CAST(CASE WHEN idx % 3 = 1 THEN size ELSE size + {1 << 24} END AS BIGINT) AS word FROM pieces")
def block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks.offsets(_pieces(spark, sf_dir).withColumn("stored", F.col("size")))
    return rows.select("path", "idx", "at", blocks.size_word(F.col("size"), F.col("idx") % 3 == 1).alias("word"))


@query(f"WITH {views.CONTENTS}, {_HEX}, wanted AS (SELECT path, seq % 1500 AS a, 700 + seq % 900 AS l, h FROM hexed) SELECT path, CAST(a AS BIGINT) AS \"offset\", CAST(l AS BIGINT) AS length, lower(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * l AS BIGINT))) AS data FROM wanted")
def byte_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks.offsets(_pieces(spark, sf_dir).withColumn("stored", F.col("size")))
    wanted = views.contents(spark, sf_dir).select("path", (F.col("seq") % 1500).alias("offset"), (700 + F.col("seq") % 900).alias("length"))
    return blocks.read_ranges(rows, wanted).select("path", "offset", "length", F.lower(F.hex("data")).alias("data"))


@query(f"WITH {views.CONTENTS} SELECT path, md5(text) AS digest FROM contents WHERE length(text) > 0")
def join_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.join_blocks(_pieces(spark, sf_dir)).select("path", F.md5("content").alias("digest"))


@query(
    f"WITH RECURSIVE {_B}, {_PACK}, copies AS (SELECT path, path <> first_value(path) OVER (PARTITION BY text ORDER BY seq) AS copy FROM contents), whole AS (SELECT p.*, copy FROM pieces p JOIN copies USING (path) WHERE NOT tail), "
    "sums AS (SELECT (SELECT CAST(sum(n) AS BIGINT) FROM hexed) AS bytes_read, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM whole WHERE NOT copy) + (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM kept) AS bytes_written) "
    "SELECT bytes_read, bytes_written, CAST(100 * bytes_written // bytes_read AS BIGINT) AS ratio, (SELECT CAST(count(*) AS BIGINT) FROM whole) AS data_blocks, (SELECT CAST(count(DISTINCT fragment) AS BIGINT) FROM packed) AS fragment_blocks, CAST(0 AS BIGINT) AS sparse_blocks, "
    "(SELECT CAST(count(*) AS BIGINT) FROM whole WHERE copy) AS duplicate_blocks, (SELECT CAST(count(*) AS BIGINT) FROM tails) AS fragments, (SELECT CAST(count(*) AS BIGINT) FROM tails WHERE seq <> first_seq) AS duplicate_fragments FROM sums"
)
def pack_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.pack_statistics(views.contents(spark, sf_dir), BLOCK)


# --- attributes and rules ---------------------------------------------------------------------------------------------

_SETS = (
    f"{views.TAGS}, won AS (SELECT owner, key, arg_max(text, seq) AS text FROM tags GROUP BY owner, key), sets AS (SELECT owner, string_agg(key || '=' || text, ',' ORDER BY key) AS s FROM won GROUP BY owner), "
    "firsts AS (SELECT owner, min(seq) AS first FROM tags GROUP BY owner), ids AS (SELECT s, row_number() OVER (ORDER BY min(first)) - 1 AS i FROM sets JOIN firsts USING (owner) GROUP BY s)"
)


@query(f"WITH {_SETS} SELECT owner, CAST(i AS BIGINT) AS xattr_index FROM sets JOIN ids USING (s)")
def xattr_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.attribute_sets(views.tags(spark, sf_dir))


@query(
    f"WITH {_SETS}, one AS (SELECT i, min(owner) AS owner FROM sets JOIN ids USING (s) GROUP BY i), stored AS (SELECT i, key, text || '-long' AS text FROM won JOIN one USING (owner)) SELECT CAST(i AS BIGINT) AS xattr_index, key, text, row_number() OVER (PARTITION BY text ORDER BY i, key) > 1 AS out_of_line FROM stored"
)
def xattr_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that are stored, and which of their values are stored before."""
    pairs = views.tags(spark, sf_dir).withColumn("value", F.concat("text", F.lit("-long")).cast("binary"))
    return attributes.stored_pairs(pairs).select("xattr_index", "key", F.col("value").cast("string").alias("text"), "out_of_line")


@query(
    f"WITH {views.TREE}, {views.TAGS}, rules AS (SELECT f.path, t.seq, t.key, t.text FROM tags t JOIN files f ON f.key = t.owner) SELECT path, key, arg_max(text, seq) AS text FROM rules GROUP BY path, key"
)
def xattr_map_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the rules of a map file; half of its paths begin with a slash."""
    rows = views.files(spark, sf_dir)
    tags = views.tags(spark, sf_dir)
    named = tags.join(rows.select(F.col("key").alias("owner"), "path"), "owner")
    slashed = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("/"), "path")).otherwise(F.col("path"))
    found = attributes.apply_map(rows, named.select(slashed.alias("path"), F.col("owner").alias("block"), "seq", "key", "value"))
    return found.select("path", "key", F.col("value").cast("string").alias("text"))


SORT_FILE = ["# first the large sources", "-10 [glob_no_path,dont_fragment] src1*/en/*", "5 [glob] src?/de/*", "7 [dont_compress, nosparse] src0/en/0", '  3 [glob] "*/es/*"  ', "-10000 src2/fr/1"]


@query(
    f"WITH {views.CONTENTS}, ruled AS (SELECT path, seq, CASE WHEN regexp_full_match(path, 'src1.*/en/.*') THEN 2 WHEN regexp_full_match(path, 'src[^/]/de/[^/]*') THEN 3 WHEN path = 'src0/en/0' THEN 4 WHEN regexp_full_match(path, '[^/]*/es/[^/]*') THEN 5 WHEN path = 'src2/fr/1' THEN 6 END AS rule FROM contents), "
    "valued AS (SELECT *, CASE rule WHEN 2 THEN -10 WHEN 3 THEN 5 WHEN 4 THEN 7 WHEN 5 THEN 3 WHEN 6 THEN -10000 ELSE 0 END AS priority FROM ruled) SELECT path, CAST(rule AS INT) AS rule, CAST(priority AS BIGINT) AS priority, CASE rule WHEN 2 THEN 'dont_fragment' WHEN 4 THEN 'dont_compress,nosparse' ELSE '' END AS flags, CAST(row_number() OVER (ORDER BY priority, seq) - 1 AS BIGINT) AS position FROM valued"
)
def sort_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame(list(enumerate(SORT_FILE, 1)), "line_no int, line string")
    order = rules.packing_order(views.contents(spark, sf_dir).select("path", "seq"), rules.parse_sort_rules(lines))
    return order.select("path", "rule", "priority", F.array_join("flags", ",").alias("flags"), "position")


LABELS = [("/.*", None, "any"), ("/src1[0-9]*/.*", None, "ten"), ("/.*/de/.*", modes.FILE, "german"), ("/src0", modes.DIRECTORY, "never")]


@query(f"WITH {views.CONTENTS} SELECT path, CASE WHEN regexp_full_match(path, '.*/de/.*') THEN 'german' WHEN regexp_full_match(path, 'src1[0-9]*/.*') THEN 'ten' ELSE 'any' END AS label FROM contents")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.contents(spark, sf_dir).select("path", F.lit(modes.FILE | 0o644).alias("mode"))
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(LABELS)], "rule int, pattern string, type int, label string")
    return attributes.labels(rows, table, "none")


# --- differences ------------------------------------------------------------------------------------------------------


@query(f"WITH {views.VERSIONS} SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN '<' ELSE '>' END AS side FROM old o FULL JOIN new n ON o.path = n.path WHERE (o.path IS NULL OR n.path IS NULL) AND coalesce(o.path, n.path) NOT IN (SELECT path FROM hidden)")
def diff_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.only(*views.versions(spark, sf_dir))


_BOTH = "both_sides AS (SELECT o.path, o.mode AS om, n.mode AS nm, o.uid AS ou, n.uid AS nu, o.gid AS og, n.gid AS ng, o.mtime AS ot, n.mtime AS nt, o.size AS os, n.size AS ns, o.rdev AS ord, n.rdev AS nrd, o.target AS otg, n.target AS ntg, (o.mode & 61440) = (n.mode & 61440) AS same, o.mode & 61440 AS kind FROM old o JOIN new n ON o.path = n.path WHERE o.path NOT IN (SELECT path FROM hidden))"


@query(
    f"WITH {views.VERSIONS}, {_BOTH} SELECT path, 'type' AS difference FROM both_sides WHERE NOT same UNION ALL SELECT path, 'permissions' FROM both_sides WHERE same AND (om & 4095) <> (nm & 4095) UNION ALL SELECT path, 'owner' FROM both_sides WHERE same AND (ou <> nu OR og <> ng) "
    "UNION ALL SELECT path, 'timestamp' FROM both_sides WHERE same AND ot <> nt UNION ALL SELECT path, 'device' FROM both_sides WHERE same AND kind IN (8192, 24576) AND ord IS DISTINCT FROM nrd UNION ALL SELECT path, 'target' FROM both_sides WHERE same AND kind = 40960 AND otg IS DISTINCT FROM ntg "
    "UNION ALL SELECT path, 'content' FROM both_sides WHERE same AND kind = 32768 AND os <> ns"
)
def diff_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.attributes(*views.versions(spark, sf_dir), compare=[*diff.DEFAULT, "timestamp"])


_CHANGED = "CASE WHEN seq % 10 = 3 THEN text || '!' WHEN seq % 10 = 4 AND length(text) > 0 THEN '#' || substr(text, 2) ELSE text END"


@query(
    f"WITH {views.CONTENTS}, newer AS (SELECT path, seq, text AS a, {_CHANGED} AS b FROM contents), sized AS (SELECT path, octet_length(encode(a)) AS n, octet_length(encode(b)) AS m, a, b FROM newer) "
    "SELECT path, CAST(n AS BIGINT) AS old_size, CAST(m AS BIGINT) AS new_size, CASE WHEN n = m THEN CAST(0 AS BIGINT) END AS first_difference FROM sized WHERE a <> b"
)
def diff_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = views.contents(spark, sf_dir)
    changed = old.withColumn("text", F.col("content").cast("string")).withColumn("content", F.expr(_CHANGED).cast("binary"))
    return diff.contents(old.select("path", "content"), changed.select("path", "content"), BLOCK)


@query(
    f"WITH {views.VERSIONS}, a AS (SELECT count(*) AS inode_count, max(mtime) AS mtime, count(DISTINCT uid) AS id_count, CASE WHEN count(*) % 2 = 0 THEN 64 ELSE 16 END AS flags FROM old), b AS (SELECT count(*) AS inode_count, max(mtime) AS mtime, count(DISTINCT uid) AS id_count, 128 AS flags FROM new), "
    + "rows AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST(a.{c} AS BIGINT) AS old, CAST(b.{c} AS BIGINT) AS new FROM a, b" for c in ("inode_count", "mtime", "id_count"))
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT 'flag: {name}', CAST((a.flags & {bit}) <> 0 AS BIGINT), CAST((b.flags & {bit}) <> 0 AS BIGINT) FROM a, b" for bit, name in diff.FLAGS.items())
    + ') SELECT field, "old", "new", "new" - "old" AS delta FROM rows WHERE "old" IS DISTINCT FROM "new"'
)
def diff_super(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = views.versions(spark, sf_dir)
    one = lambda t, flags: t.agg(F.count("*").alias("inode_count"), F.max("mtime").alias("mtime"), F.countDistinct("uid").alias("id_count"), flags.alias("flags"))
    return diff.super_blocks(one(old, F.when(F.count("*") % 2 == 0, 64).otherwise(16)), one(new, F.lit(128)))


@query(f"WITH {views.TREE}, {views.URLS} SELECT path, mode FROM tree UNION ALL SELECT DISTINCT path, 33188 FROM canonical")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.urls(spark, sf_dir).select(paths.canonicalize(F.col("raw")).alias("path")).distinct().withColumn("mode", F.lit(0o100644))
    return views.tree(spark, sf_dir).select("path", "mode").unionByName(pages)


# --- scalars ----------------------------------------------------------------------------------------------------------

_SIZES = "sizes AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) || CASE o_orderkey % 6 WHEN 0 THEN 'k' WHEN 1 THEN 'M' WHEN 2 THEN 'g' WHEN 3 THEN '' WHEN 4 THEN 'x' ELSE ' ' END AS t FROM orders)"


@query(f"WITH {_SIZES} SELECT k, t, CAST(CASE k % 6 WHEN 0 THEN k * 1024 WHEN 1 THEN k * 1048576 WHEN 2 THEN k * 1073741824 WHEN 3 THEN k END AS BIGINT) AS size FROM sizes")
def parse_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("k", "M", "g", "", "x", " ")]), (k % 6 + 1).cast("int"))
    rows = views.read(spark, sf_dir, "orders").select(k.alias("k"), F.concat(k.cast("string"), suffix).alias("t"))
    return rows.withColumn("size", numbers.parse_size(F.col("t")))


@query(f"WITH s AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) * (CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 100000 ELSE 0 END) + o_orderkey % 2000 AS n FROM orders) SELECT k, {views.sql_size('n')} AS rounded, {views.sql_size('n', False)} AS exact FROM s")
def print_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    factor = F.element_at(F.array(*[F.lit(n).cast("long") for n in (1, 1000, 100000, 0)]), (k % 4 + 1).cast("int"))
    rows = views.read(spark, sf_dir, "orders").select(k.alias("k"), (F.floor(F.col("o_totalprice") * 100 + 0.5) * factor + k % 2000).alias("n"))
    return rows.select("k", numbers.print_size(F.col("n")).alias("rounded"), numbers.print_size(F.col("n"), False).alias("exact"))


@query(f"SELECT m, {views.sql_mode('m')} AS text, {views.sql_octal('m')} AS octal FROM (SELECT DISTINCT o_orderkey * 7 % 65536 AS m FROM orders)")
def mode_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7 % 65536).alias("m")).distinct()
    m = F.col("m").cast("int")
    return rows.select("m", modes.mode_string(m).alias("text"), modes.octal(m).alias("octal"))


@query("WITH d AS (SELECT o_orderkey AS k, o_orderkey % 4096 AS major, o_custkey * 977 % 1048576 AS minor FROM orders), p AS (SELECT *, (major << 8) | (minor & 255) | ((minor & 1048320) << 12) AS device FROM d) SELECT k, CAST(device AS BIGINT) AS device, CAST((device & 1048320) >> 8 AS BIGINT) AS major, CAST((device & 255) | ((device >> 12) & 1048320) AS BIGINT) AS minor FROM p")
def device_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), modes.make_device(F.col("o_orderkey") % 4096, F.col("o_custkey") * 977 % 1048576).alias("device"))
    return rows.select("k", "device", modes.device_major(F.col("device")).alias("major"), modes.device_minor(F.col("device")).alias("minor"))


_TEXTS = "texts AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '-' || CAST(o_orderkey AS VARCHAR) WHEN 2 THEN CAST(o_orderkey AS VARCHAR) || 'z' WHEN 3 THEN '0' || CAST(o_orderkey % 8 AS VARCHAR) || CAST(o_orderkey // 8 % 8 AS VARCHAR) ELSE '' END AS t FROM orders)"


@query(
    f"WITH {_TEXTS} SELECT k, t, CASE WHEN regexp_full_match(t, '[0-9]+') THEN CAST(t AS BIGINT) END AS number, CASE WHEN regexp_full_match(t, '[0-9]+') AND CAST(t AS BIGINT) BETWEEN 10 AND 5000 THEN CAST(t AS BIGINT) END AS bounded, CASE WHEN regexp_full_match(t, '-?[0-9]+') THEN CAST(t AS BIGINT) END AS signed, "
    "CASE WHEN k % 5 = 3 THEN CAST(k % 8 * 8 + k // 8 % 8 AS BIGINT) END AS octal FROM texts"
)
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, F.concat(F.lit("-"), k.cast("string"))).when(k % 5 == 2, F.concat(k.cast("string"), F.lit("z")))
    t = t.when(k % 5 == 3, F.concat(F.lit("0"), (k % 8).cast("string"), (F.floor(k / 8) % 8).cast("string"))).otherwise("")
    rows = views.read(spark, sf_dir, "orders").select(k.alias("k"), t.alias("t"))
    t = F.col("t")
    return rows.select("k", "t", numbers.parse_unsigned(t).alias("number"), numbers.parse_unsigned(t, 10, 5000).alias("bounded"), numbers.parse_signed(t).alias("signed"), F.when(F.col("k") % 5 == 3, numbers.parse_octal(t)).alias("octal"))


@query("SELECT o_orderkey AS k, CAST(least(greatest((o_orderkey - 5000) * 1000000, 0), 4294967295) AS BIGINT) AS time FROM orders")
def clamp_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), numbers.clamp_time((F.col("o_orderkey") - 5000) * 1000000).alias("time"))


@query(
    f"WITH {views.TAGS} SELECT seq, CAST(CASE WHEN starts_with(key, 'user.') THEN 0 WHEN starts_with(key, 'trusted.') THEN 1 ELSE 2 END AS INT) AS prefix, regexp_replace(key, '^[a-z]*[.]', '') AS suffix, key AS whole FROM tags"
)
def xattr_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attributes.with_prefix_ids(views.tags(spark, sf_dir))
    return rows.select("seq", "prefix", "suffix", text.full_key(F.col("prefix"), F.col("suffix")).alias("whole"))


@query(f"WITH {views.CONTENTS} SELECT path, md5(text) AS hexed, md5(text) AS based FROM contents")
def decode_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole contents as values in hex and in base64, with and without padding, as a map file has them."""
    rows = views.contents(spark, sf_dir).select("path", "seq", F.col("content").alias("v"))
    base = F.translate(F.base64("v"), "\r\n", "")  # it comes in lines
    base = F.when(F.col("seq") % 2 == 0, F.regexp_replace(base, "=+$", "")).otherwise(base)
    decoded = rows.select("path", text.decode_value_column(F.concat(F.lit("0x"), F.hex("v"))).alias("a"), text.decode_value_column(F.concat(F.lit("0s"), base)).alias("b"))
    return decoded.select("path", F.md5("a").alias("hexed"), F.md5("b").alias("based"))


@query(f"WITH {views.CONTENTS} SELECT CAST(sum(octet_length(content)) AS BIGINT) AS bytes, 'zstd' AS kind FROM contents")
def stream_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contents through a stream codec and back."""
    from io import BytesIO

    pack = codecs.block_function(lambda b: codecs.pack_stream("zstd", b))
    unpack = codecs.block_function(lambda b: codecs.open_stream(BytesIO(b)).read())
    rows = views.contents(spark, sf_dir).select("content", pack("content").alias("packed"))
    rows = rows.select("content", unpack("packed").alias("back"), codecs.stream_kind_column(F.col("packed")).alias("kind"))
    return rows.where("content = back").agg(F.sum(F.octet_length("back")).cast("long").alias("bytes"), F.max("kind").alias("kind"))


# --- round trips, and what SQL can't say ---------------------------------------------------------------------------------------------


@query(
    f"WITH {views.TREE} SELECT path, mode, uid, gid, CAST(0 AS BIGINT) AS mtime, CASE WHEN (mode & 61440) IN (8192, 24576) THEN ((rdev & 1048320) >> 8 << 8) | (rdev & 255) END AS rdev, target, false AS hard_link, CASE WHEN (mode & 61440) = 32768 THEN path END AS source, CAST(NULL AS VARCHAR) AS error FROM tree WHERE path <> ''"
)
def listing_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree's listing, read again."""
    lines = E.describe(views.tree(spark, sf_dir)).select(F.lit(1).alias("line_no"), "line")
    return rules.parse_listing(lines).drop("line_no")


@query()
def compress_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all blocks as they are and under each codec."""
    out = None
    for name in ("gzip", "zstd"):
        done = codecs.transform_blocks(_pieces(spark, sf_dir, False), codecs.codec(name))
        row = done.agg(F.sum("size").alias("bytes"), F.sum("stored_size").alias("stored"), F.count_if("compressed").alias("compressed"), F.count_if("sparse").alias("sparse")).withColumn("codec", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    f"WITH RECURSIVE {_B}, runs AS MATERIALIZED (SELECT path, seq, string_agg('|' || md5(h || ':' || CAST(size AS VARCHAR)), '' ORDER BY idx) AS run, row_number() OVER (ORDER BY seq) AS r FROM pieces GROUP BY path, seq), "
    "found AS (SELECT CAST(0 AS BIGINT) AS r, '' AS path, CAST(0 AS BIGINT) AS seq, '' AS stored, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS taken, false AS duplicate UNION ALL "
    "SELECT r, path, seq, stored || substr(run, length(run) - greatest(0, place + length(run) - length(stored)) + 1), place, length(run), place < length(stored) FROM (SELECT k.r, k.path, k.seq, k.run, f.stored, instr(f.stored || k.run, k.run) - 1 AS place FROM found f JOIN runs k ON k.r = f.r + 1)) "
    'SELECT path, CAST(seq AS BIGINT) AS seq, CAST(place // 33 AS BIGINT) AS "start", CAST(taken // 33 AS BIGINT) AS blocks, duplicate FROM found WHERE r > 0'
)
def file_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each file's run of blocks is found in the list of stored ones."""
    return blocks.duplicate_runs(_pieces(spark, sf_dir))


def _shared(spark: SparkSession, name: str) -> str:
    """A place in the folder that all executors share, made if it isn't there."""
    import os
    import uuid

    from ..operators.order import checkpointed
    from ..sources.files import local

    checkpointed(spark.range(1))
    folder = local(spark.sparkContext.getCheckpointDir())
    os.makedirs(folder, exist_ok=True)
    return f"{folder}/{uuid.uuid4().hex}-{name}"


@query(f"WITH {views.CONTENTS} SELECT path, 33188 AS mode, CAST(7 AS BIGINT) AS uid, CAST(8 AS BIGINT) AS gid, CAST(seq AS BIGINT) AS mtime, CAST(octet_length(content) AS BIGINT) AS size, md5(text) AS digest FROM contents")
def tar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as an archive and read again."""
    from ..sources import tar

    rows = views.contents(spark, sf_dir).select("path", "seq", F.lit(0o100644).alias("mode"), F.lit(7).cast("long").alias("uid"), F.lit(8).cast("long").alias("gid"), F.col("seq").alias("mtime"), "content")
    path = _shared(spark, "documents.tar")
    tar.write_tar(rows, path)
    return tar.read_tar(spark, path).select("path", "mode", "uid", "gid", "mtime", "size", F.md5("content").alias("digest"))


@query(f"WITH {views.CONTENTS} SELECT path, 33188 AS mode, seq % 7 AS uid, seq % 3 AS gid, CAST(seq AS BIGINT) AS mtime, CAST(octet_length(content) AS BIGINT) AS size, md5(text) AS digest FROM contents")
def image_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as an image and read again."""
    from ..sources import image

    rows = views.contents(spark, sf_dir).select("path", "seq", F.lit(0o100644).alias("mode"), (F.col("seq") % 7).alias("uid"), (F.col("seq") % 3).alias("gid"), F.col("seq").alias("mtime"), "content")
    path = _shared(spark, "documents.img")
    image.write_image(rows, path, "zstd", 4096, exportable=True)
    rows = image.read_image(spark, path, slices=4).where(modes.is_type(F.col("mode"), modes.FILE))
    return rows.select("path", "mode", "uid", "gid", "mtime", "size", F.md5("content").alias("digest"))


# the queries of formats are registered beside these; that module takes its helpers from this one
from . import formats as formats  # noqa: E402
