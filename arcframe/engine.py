"""The engine's entry points: one object for packing, inspecting, converting and comparing."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import modes, paths
from .operators import attributes, links, rules, tree
from .operators import diff as differences
from .operators import entries as E
from .sources import directory, image, tar
from .sources.files import expand


class Engine:
    """Queries over images, archives, directories and listings; all return DataFrames."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    # --- sources

    def image(self, path: str, table: str = "entries", **options) -> DataFrame:
        return image.read_image(self.spark, path, table, **options)

    def tar(self, path: str, exclude: Sequence[str] = (), **options) -> DataFrame:
        return E.exclude_globs(tar.read_tar(self.spark, path, **options), exclude)

    def directory(self, path: str, hard_links: bool = True, **options) -> DataFrame:
        found = directory.scan_directory(self.spark, path, **options)
        return links.detect(found) if hard_links else found

    def listing(self, path: str, directory_path: str | None = None, mtime: int = 0) -> DataFrame:
        """Entries of a listing file, globs expanded and contents taken from below directory_path."""
        lines = rules.lines(self.spark, path)
        parsed = rules.parse_listing(lines, mtime)
        wrong = rules.listing_errors(parsed).orderBy("line_no").limit(1).collect()
        if wrong:
            raise ValueError(f"{path}:{wrong[0].line_no}: {wrong[0].error}")
        found = parsed.where("error is null").drop("error", "line_no")
        if directory_path is not None:
            scanned = directory.scan_directory(self.spark, directory_path)
            for row in parsed.where("error = 'glob'").join(lines, "line_no").orderBy("line_no").collect():
                glob = rules.parse_glob(row.line)
                below = scanned.where(paths.is_below(F.col("path"), glob.start) & (F.col("path") != glob.start)) if glob.start else scanned
                below = below.withColumn("path", F.substring("path", F.lit(len(glob.start) + 2), F.length("path"))) if glob.start else below
                taken = rules.expand_glob(glob, below, tree.with_implied(found)).withColumn("source", F.lit(None).cast("string"))
                found = found.unionByName(taken.select(*[c for c in (*found.columns, "content") if c in taken.columns]), allowMissingColumns=True)
            contents = scanned.select(F.col("path").alias("source"), F.col("content").alias("c"))
            found = found.join(contents, "source", "left").withColumn("content", F.coalesce("content", "c") if "content" in found.columns else F.col("c")).drop("c")
        return found.drop("source")

    # --- inspecting

    def ls(self, entries: DataFrame, path: str = "") -> DataFrame:
        return E.list_directory(entries, path)

    def stat(self, entries: DataFrame, path: str) -> DataFrame:
        return E.stat(entries, path)

    def cat(self, entries: DataFrame, path: str) -> bytes:
        """The bytes of one file."""
        rows = entries.where((F.col("path") == path) & modes.is_type(F.col("mode"), modes.FILE)).select("content").limit(1).collect()
        if not rows:
            raise FileNotFoundError(path)
        return bytes(rows[0].content or b"")

    def find(self, entries: DataFrame, name: str | None = None, path: str | None = None, types: Sequence[str] = (), below: str = "") -> DataFrame:
        rows = E.of_types(tree.subtree(entries, below), types)
        rows = E.name_matches(rows, name) if name is not None else rows
        return E.path_matches(rows, path) if path is not None else rows

    def xattrs(self, entries: DataFrame, path: str) -> DataFrame:
        pairs = entries.where(F.col("path") == path).select("path", F.explode("xattrs").alias("key", "value"))
        return attributes.dump(pairs)

    def describe(self, entries: DataFrame, unpack_root: str | None = None) -> DataFrame:
        return E.describe(entries, unpack_root)

    def unpack(self, entries: DataFrame, target: str, path: str = "", drop_types: Sequence[int] = (), drop_empty: bool = False, **options) -> DataFrame:
        rows = tree.subtree(entries, path)
        rows = E.without_types(rows, *drop_types)
        rows = E.prune_empty(rows, path) if drop_empty else rows
        return directory.unpack(rows, target, **options)

    # --- packing and converting

    def pack(
        self, entries: DataFrame, path: str, sort_file: str | None = None, xattr_file: str | None = None, label_file: str | None = None, keep: Collection[str] = ("uid", "gid", "mtime", "mode"),
        defaults: str = "", **options,
    ) -> None:
        """Writes entries as an image. keep names the attributes that stay as they are, others come from defaults."""
        rows = E.override(entries, keep, **rules.parse_defaults(defaults)) if set(keep) != {"uid", "gid", "mtime", "mode"} else entries
        if xattr_file or label_file:
            pairs = self._pairs(rows, xattr_file, label_file)
            maps = pairs.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("more"))
            rows = rows.join(maps, "path", "left")
            have = F.coalesce("xattrs", F.create_map().cast("map<string,binary>")) if "xattrs" in rows.columns else F.create_map().cast("map<string,binary>")
            more = F.coalesce("more", F.create_map().cast("map<string,binary>"))
            rows = rows.withColumn("xattrs", F.map_concat(F.map_filter(have, lambda k, _: ~F.map_contains_key(more, k)), more)).drop("more")
        if sort_file:
            order = rules.parse_sort_rules(rules.lines(self.spark, sort_file))
            files = tree.file_list(rows).select("path", "seq")
            rows = rows.join(rules.packing_order(files, order).select("path", "position"), "path", "left")
        image.write_image(rows, path, **options)

    def _pairs(self, rows: DataFrame, xattr_file: str | None, label_file: str | None) -> DataFrame:
        out = None
        if xattr_file:
            parsed = rules.parse_attribute_map(rules.lines(self.spark, xattr_file)).where("error is null")
            out = attributes.apply_map(rows, parsed)
        if label_file:
            found = attributes.labels(rows, rules.parse_labels(rules.lines(self.spark, label_file))).where("label is not null")
            labels = found.select("path", F.lit("security.selinux").alias("key"), F.concat(F.col("label"), F.lit("\0")).cast("binary").alias("value"))
            out = labels if out is None else out.unionByName(labels)
        return out

    def to_tar(self, entries: DataFrame, path: str, subdirs: Sequence[str] = (), keep_as_dir: bool = False, root: str | None = None, hard_links: bool = True, **options) -> DataFrame:
        """Writes entries of an image as an archive; returns the rows that an archive can't hold."""
        rows = links.detect(entries.withColumn("dev", F.lit(0).cast("long"))) if hard_links and "inode" in entries.columns and "seq" in entries.columns else entries
        rows = E.reroot_out(rows, subdirs, root, keep_as_dir).withColumn("path", F.regexp_replace("path", "/$", ""))
        return tar.write_tar(rows, path, **options)

    def from_tar(self, source: str, path: str, root: str | None = None, exclude: Sequence[str] = (), retarget_symlinks: bool = True, keep_time: bool = True, **options) -> None:
        """Writes an archive as an image. A name that comes twice in the archive keeps its last entry."""
        self.pack_archive(self.tar(source, exclude), path, root, retarget_symlinks, keep_time, **options)

    def pack_archive(self, rows: DataFrame, path: str, root: str | None = None, retarget_symlinks: bool = True, keep_time: bool = True, defaults: dict[str, int] | None = None, **options) -> None:
        """Writes an archive's entries as an image, from root on. defaults are those of directories that it implies."""
        last = rows.groupBy("path").agg(F.max("seq").alias("seq"))
        rows = rows.join(last, ["path", "seq"], "left_semi")
        rows = E.reroot_in(rows, root, retarget_symlinks) if root else rows
        rows = rows if keep_time else rows.withColumn("mtime", F.lit(0).cast("long"))
        rows = tree.with_implied(rows, **defaults) if defaults else rows
        image.write_image(rows, path, **options)

    # --- comparing

    def diff(self, old: DataFrame, new: DataFrame, compare: Collection[str] = differences.DEFAULT) -> DataFrame:
        """path and difference: ``<``, ``>`` for paths on one side, or what differs."""
        sides = differences.only(old, new).select("path", F.col("side").alias("difference"))
        return sides.unionByName(differences.attributes(old, new, compare))

    def diff_images(self, old: str, new: str, compare: Collection[str] = differences.DEFAULT) -> DataFrame:
        """Differences of two images; of their super blocks only if their trees are the same."""
        return self.diff(self.image(old), self.image(new), compare)

    def diff_super(self, old: str, new: str) -> DataFrame:
        return differences.super_blocks(self.image(old, "super"), self.image(new, "super"))

    def browse(self, path: str) -> Browser:
        return Browser(self, path)


class Browser:
    """A place in an image: ls, cd, stat, cat, pwd."""

    def __init__(self, engine: Engine, path: str) -> None:
        self.engine, self.entries, self.at = engine, engine.image(expand(path)[0]), ""

    def _resolve(self, path: str) -> str:
        steps = [] if path.startswith("/") else self.at.split("/")
        for part in path.split("/"):
            if part == "..":
                steps = steps[:-1]
            elif part not in ("", "."):
                steps.append(part)
        return "/".join(s for s in steps if s)

    def pwd(self) -> str:
        return "/" + self.at

    def cd(self, path: str) -> None:
        to = self._resolve(path)
        found = self.entries.where((F.col("path") == to) & modes.is_type(F.col("mode"), modes.DIRECTORY))
        if found.isEmpty():
            raise NotADirectoryError(to)
        self.at = to

    def ls(self, path: str = "") -> DataFrame:
        return self.engine.ls(self.entries, self._resolve(path))

    def stat(self, path: str) -> DataFrame:
        return self.engine.stat(self.entries, self._resolve(path))

    def cat(self, path: str) -> bytes:
        return self.engine.cat(self.entries, self._resolve(path))
