"""Trees, files, names and attributes derived from the driver tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import modes


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes up to which a table in few files is dealt over all tasks: one split's worth by Spark's defaults.
SMALL = 128 << 20


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are worked on at length. A small one in fewer files than there are tasks is dealt over all."""
    df = read(spark, sf_dir, name)
    tasks = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(tasks) if size <= SMALL and len(df.inputFiles()) < tasks else df


#: Orders whose key is a multiple become something else than a regular file: the first that fits counts.
SPECIAL = ((29, 0o010644), (31, 0o140755), (37, 0o020660), (41, 0o060660), (11, 0o120777))
BY_STATUS = {"O": 0o100644, "F": 0o100600, "P": 0o104755}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the leaves of a tree: region, nation, customer, order."""
    orders, customer, nation, region = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    customers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    folders = customers.select("c_custkey", F.concat_ws("/", "r_name", "n_name", "c_name").alias("folder"))
    key = F.col("o_orderkey")
    mode = F.lit(None).cast("int")
    for status, bits in BY_STATUS.items():
        mode = F.when(F.col("o_orderstatus") == status, bits).otherwise(mode)
    for factor, bits in reversed(SPECIAL):
        mode = F.when(key % factor == 0, bits).otherwise(mode)
    kind = modes.type_of(F.col("mode"))
    return (
        orders.join(folders, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("mode", mode)
        .select(
            F.concat_ws("/", "folder", key.cast("string")).alias("path"),
            "mode",
            (F.col("o_custkey") % 7).alias("uid"),
            (F.col("o_custkey") % 3).alias("gid"),
            F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtime"),
            F.when(kind == modes.FILE, F.floor(F.col("o_totalprice") * 100 + 0.5)).otherwise(0).cast("long").alias("size"),
            F.when(kind.isin(modes.CHARACTER, modes.BLOCK), key % 200 * 256 + key % 256).alias("rdev"),
            F.when(kind == modes.LINK, F.concat(F.lit("../"), (key + 1).cast("string"))).alias("target"),
            key.alias("key"),
        )
    )


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories of all regions, nations and customers, and the root."""
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    steps = F.array(F.lit(""), F.col("r_name"), F.concat_ws("/", "r_name", "n_name"), F.concat_ws("/", "r_name", "n_name", "c_name"))
    names = joined.select(F.explode(steps).alias("path")).distinct()
    mode = F.when((F.col("path") != "") & ~F.col("path").contains("/"), 0o041777).otherwise(0o040755)
    zero = F.lit(0).cast("long")
    return names.select("path", mode.alias("mode"), zero.alias("uid"), zero.alias("gid"), zero.alias("mtime"), zero.alias("size"), F.lit(None).cast("long").alias("rdev"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("long").alias("key"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).unionByName(folders(spark, sf_dir))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses without scheme and query, as they are: page_id and raw."""
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "[?#].*$", "").alias("raw"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, seq and content."""
    docs = read_spread(spark, sf_dir, "documents")
    return docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("seq"), F.col("text").cast("binary").alias("content"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as attributes of users: owner, seq, key and value. The number in props picks key and value."""
    events = read(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    prefix = F.element_at(F.array(F.lit("user."), F.lit("trusted."), F.lit("security.")), (k % 3 + 1).cast("int"))
    return events.select(
        F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), F.concat(prefix, F.lit("k"), (k % 2).cast("string")).alias("key"), F.concat(F.lit("value-"), (k % 4).cast("string")).alias("text")
    ).withColumn("value", F.col("text").cast("binary"))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the tree: some orders on one side only, some changed, some customers' folders turned into files."""
    both = tree(spark, sf_dir)
    key = F.col("key")
    old = both.where(key.isNull() | (key % 19 != 3))
    new = both.where(key.isNull() | (key % 23 != 5))
    file = modes.type_of(F.col("mode")) == modes.FILE
    turned = F.col("path").rlike("Customer#[0-9]*77$")
    new = new.withColumns({
        "mode": F.when(turned, 0o100644).when((key % 17 == 2) & file, F.col("mode").bitwiseXOR(0o011)).when(key % 43 == 7, 0o120777).otherwise(F.col("mode")),
        "uid": F.when(key % 13 == 4, F.col("uid") + 1).otherwise(F.col("uid")),
        "mtime": F.when(key % 47 == 6, F.col("mtime") + 60).otherwise(F.col("mtime")),
        "size": F.when((key % 53 == 8) & file, F.col("size") + 1).otherwise(F.col("size")),
        "target": F.when(key % 22 == 0, F.lit("elsewhere")).otherwise(F.col("target")),
        "rdev": F.when(key % 74 == 0, F.col("rdev") + 1).otherwise(F.col("rdev")),
    })
    return old, new


# --- the same as SQL --------------------------------------------------------------------------------------------

_MODE = "CASE " + " ".join(f"WHEN o_orderkey % {f} = 0 THEN {m}" for f, m in SPECIAL) + " " + " ".join(f"WHEN o_orderstatus = '{s}' THEN {m}" for s, m in BY_STATUS.items()) + " END"

TREE = f"""
named AS (SELECT c_custkey, r_name, r_name || '/' || n_name AS n_path, r_name || '/' || n_name || '/' || c_name AS folder
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
moded AS (SELECT o_orderkey AS key, folder, o_custkey, o_totalprice, CAST(epoch(o_orderdate) AS BIGINT) AS mtime, {_MODE} AS mode FROM orders JOIN named ON o_custkey = c_custkey),
files AS (SELECT folder || '/' || CAST(key AS VARCHAR) AS path, mode, o_custkey % 7 AS uid, o_custkey % 3 AS gid, mtime,
    CASE WHEN (mode & 61440) = 32768 THEN CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) ELSE 0 END AS size,
    CASE WHEN (mode & 61440) IN (8192, 24576) THEN key % 200 * 256 + key % 256 END AS rdev,
    CASE WHEN (mode & 61440) = 40960 THEN '../' || CAST(key + 1 AS VARCHAR) END AS target, key FROM moded),
folders AS (SELECT path, CASE WHEN path <> '' AND NOT contains(path, '/') THEN 17407 ELSE 16877 END AS mode, 0 AS uid, 0 AS gid, 0 AS mtime, 0 AS size, CAST(NULL AS BIGINT) AS rdev, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS BIGINT) AS key
  FROM (SELECT '' AS path UNION SELECT r_name FROM named UNION SELECT n_path FROM named UNION SELECT folder FROM named)),
tree AS (SELECT * FROM files UNION ALL SELECT * FROM folders),
parted AS (SELECT *, string_split(path, '/') AS parts, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS depth,
    CASE WHEN path = '' THEN NULL WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent_path, string_split(path, '/')[-1] AS name FROM tree)
"""

URLS = """
urls AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?:/', ''), '[?#].*$', '') AS raw FROM pages),
canonical AS (SELECT page_id, raw, array_to_string(list_filter(string_split(raw, '/'), lambda x: x <> '' AND x <> '.'), '/') AS path FROM urls)
"""

CONTENTS = """
contents AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path, doc_id AS seq, encode(text) AS content, text FROM documents)
"""

TAGS = """
numbered AS (SELECT user_id AS owner, event_id AS seq, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events),
tags AS (SELECT owner, seq, CASE k % 3 WHEN 0 THEN 'user.' WHEN 1 THEN 'trusted.' ELSE 'security.' END || 'k' || CAST(k % 2 AS VARCHAR) AS key, 'value-' || CAST(k % 4 AS VARCHAR) AS text FROM numbered)
"""

VERSIONS = (
    TREE
    + """,
old AS (SELECT * FROM tree WHERE key IS NULL OR key % 19 <> 3),
new AS (SELECT path,
    CASE WHEN regexp_matches(path, 'Customer#[0-9]*77$') THEN 33188 WHEN key % 17 = 2 AND (mode & 61440) = 32768 THEN xor(mode, 9) WHEN key % 43 = 7 THEN 41471 ELSE mode END AS mode,
    CASE WHEN key % 13 = 4 THEN uid + 1 ELSE uid END AS uid, gid, CASE WHEN key % 47 = 6 THEN mtime + 60 ELSE mtime END AS mtime,
    CASE WHEN key % 53 = 8 AND (mode & 61440) = 32768 THEN size + 1 ELSE size END AS size,
    CASE WHEN key % 74 = 0 THEN rdev + 1 ELSE rdev END AS rdev, CASE WHEN key % 22 = 0 THEN 'elsewhere' ELSE target END AS target, key FROM tree WHERE key IS NULL OR key % 23 <> 5),
changed AS (SELECT o.path FROM old o JOIN new n ON o.path = n.path WHERE (o.mode & 61440) <> (n.mode & 61440)),
hidden AS (SELECT DISTINCT t.path FROM (SELECT path FROM old UNION SELECT path FROM new) t JOIN changed c ON starts_with(t.path, c.path || '/'))
"""
)


def sql_mode(m: str) -> str:
    """A mode string in SQL."""
    kind = f"CASE ({m} & 61440) WHEN 16384 THEN 'd' WHEN 8192 THEN 'c' WHEN 24576 THEN 'b' WHEN 32768 THEN '-' WHEN 40960 THEN 'l' WHEN 49152 THEN 's' WHEN 4096 THEN 'p' ELSE '?' END"
    bit = lambda b, c: f"CASE WHEN ({m} & {b}) <> 0 THEN '{c}' ELSE '-' END"
    run = lambda b, s, both, only: f"CASE WHEN ({m} & {b | s}) = {b | s} THEN '{both}' WHEN ({m} & {b}) <> 0 THEN 'x' WHEN ({m} & {s}) <> 0 THEN '{only}' ELSE '-' END"
    return " || ".join([kind, bit(256, "r"), bit(128, "w"), run(64, 2048, "s", "S"), bit(32, "r"), bit(16, "w"), run(8, 1024, "s", "S"), bit(4, "r"), bit(2, "w"), run(1, 512, "t", "T")])


def sql_size(n: str, rounded: bool = True) -> str:
    """A printed size in SQL."""
    cases = [f"WHEN {n} <= 1024 THEN CAST({n} AS VARCHAR)"]
    for i, suffix in enumerate("kMGT", 1):
        q, s = f"({n} >> {10 * i})", f"(({n} >> {10 * i - 4}) & 15)"
        text = f"CAST({q} + CASE WHEN {s} >= 8 THEN 1 ELSE 0 END AS VARCHAR) || '{suffix}'" if rounded else f"CAST({q} AS VARCHAR) || '.' || substr('0112334456678899', CAST({s} + 1 AS INT), 1) || '{suffix}'"
        cases.append(f"WHEN {q} <= 1024 THEN {text}")
    return f"CASE {' '.join(cases)} END"


def sql_octal(m: str) -> str:
    """Permissions in octal with a leading zero, in SQL."""
    p = f"({m} & 4095)"
    digits = f"CAST(({p} >> 9) & 7 AS VARCHAR) || CAST(({p} >> 6) & 7 AS VARCHAR) || CAST(({p} >> 3) & 7 AS VARCHAR) || CAST({p} & 7 AS VARCHAR)"
    return f"'0' || CASE WHEN {p} = 0 THEN '0' ELSE ltrim({digits}, '0') END"
