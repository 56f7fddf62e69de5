"""Rules in text files: listings, sort orders, attribute maps, labels. Lines carry their number; what is wrong goes to errors."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import modes, numbers, paths, text
from . import entries as E
from .order import last_so_far, numbered

U32 = 0xFFFFFFFF


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1) and line of a text file, without line ends. LF and CRLF both end a line."""
    from ..sources.text import read_lines

    return read_lines(spark, path)


def clean(rows: DataFrame, ltrim: bool = True, rtrim: bool = True, skip_empty: bool = True) -> DataFrame:
    """Lines without blanks at their ends, and without empty ones; numbers stay."""
    line = F.regexp_replace("line", r"\r\z", "")
    line = F.regexp_replace(line, r"^[ \t\n\x0b\f\r]+", "") if ltrim else line
    line = F.regexp_replace(line, r"[ \t\n\x0b\f\r]+\z", "") if rtrim else line
    out = rows.withColumn("line", line)
    return out.where(F.length("line") > 0) if skip_empty else out


# --- listings -------------------------------------------------------------------------------------------------

#: Keyword of a line: type bits, whether it needs more fields and whether it may name the root.
KEYWORDS = {"dir": (modes.DIRECTORY, False, True), "slink": (modes.LINK, True, False), "link": (modes.LINK, True, False), "nod": (0, True, False), "pipe": (modes.FIFO, False, False), "sock": (modes.SOCKET, False, False), "file": (modes.FILE, False, False)}


def parse_listing(rows: DataFrame, mtime: int = 0) -> DataFrame:
    """Entries of a listing: line_no, path, mode, uid, gid, mtime, rdev, target, hard_link, source, and error.

    A line is ``type path mode uid gid [more]``; ``#`` starts a comment line. error says what is wrong with a
    line, whose other columns then don't count; lines of type glob have the error 'glob', see glob_lines.
    """
    good = clean(rows).where(~F.col("line").startswith("#"))
    fields = good.withColumn("f", text.split_line_column("line"))
    get = lambda i: F.get("f", F.lit(i))
    kind, path = get(0), paths.canonicalize(get(1))
    extra = F.when(F.size("f") > 5, F.slice("f", 6, 99))
    mode, uid, gid = numbers.parse_octal(get(2), 0, modes.PERMISSIONS), numbers.parse_unsigned(get(3), 0, U32), numbers.parse_unsigned(get(4), 0, U32)
    device = get(5)
    major, minor = numbers.parse_unsigned(get(6), 0, U32), numbers.parse_unsigned(get(7), 0, U32)
    more = F.coalesce(F.size("f") - 5, F.lit(0))
    nod = kind == "nod"
    error = (
        F.when(F.col("f").isNull(), "fields can't be split")
        .when(F.size("f") < 5, "too few fields")
        .when(kind == "glob", "glob")
        .when(~kind.isin(*KEYWORDS), "unknown type")
        .when(path.isNull(), "path leaves the tree")
        .when((path == "") & (kind != "dir"), "the root is a directory")
        .when(mode.isNull(), "mode isn't octal up to 07777")
        .when(uid.isNull() | gid.isNull(), "owner isn't a number below 2^32")
        .when(kind.isin("slink", "link", "nod") & (more < 1), "a field is missing")
        .when(nod & (more != 3), "a device takes three fields")
        .when(nod & ~F.lower(device).isin("b", "c"), "a device is b or c")
        .when(nod & (major.isNull() | minor.isNull()), "device numbers can't be read")
        .when(~nod & (more > 1), "too many fields")
    )
    bits = F.lit(0)
    for word, (value, _, _) in KEYWORDS.items():
        bits = F.when(kind == word, value).otherwise(bits)
    bits = F.when(nod, F.when(F.lower(device) == "c", modes.CHARACTER).otherwise(modes.BLOCK)).otherwise(bits)
    link = kind.isin("slink", "link")
    return fields.select(
        "line_no",
        path.alias("path"),
        F.when(link, modes.LINK | 0o777).otherwise(bits.bitwiseOR(mode.cast("int"))).cast("int").alias("mode"),
        uid.alias("uid"),
        gid.alias("gid"),
        F.lit(mtime).cast("long").alias("mtime"),
        F.when(nod, modes.make_device(major, minor)).alias("rdev"),
        F.when(kind == "slink", get(5)).when(kind == "link", paths.canonicalize(get(5))).alias("target"),
        (kind == "link").alias("hard_link"),
        F.when(kind == "file", F.coalesce(F.get(extra, F.lit(0)), path)).alias("source"),
        error.alias("error"),
    )


def listing_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull() & (F.col("error") != "glob")).select("line_no", "error")


@dataclass
class GlobLine:
    """A line of a listing that takes entries from a directory."""

    path: str
    mode: int | None
    uid: int | None
    gid: int | None
    start: str = ""
    types: list[str] = field(default_factory=list)
    name: str | None = None
    full_path: str | None = None
    one_filesystem: bool = False
    keep_time: bool = False
    recursive: bool = True
    hard_links: bool = True


def parse_glob(line: str) -> GlobLine:
    """``glob path mode uid gid [options] [directory]``; ``*`` for mode, uid or gid keeps what is found."""
    fields = text.split_line(line)
    if len(fields) < 5 or fields[0] != "glob":
        raise ValueError("not a glob line")
    number = lambda s, base: None if s == "*" else int(s, base)
    out = GlobLine("/".join(p for p in fields[1].split("/") if p not in ("", ".")), number(fields[2], 8), number(fields[3], 10), number(fields[4], 10))
    rest = fields[5:]
    while rest and rest[0].startswith("-"):
        option = rest.pop(0)
        if option == "--":
            break
        if option in ("-xdev", "-mount"):
            out.one_filesystem = True
        elif option == "-keeptime":
            out.keep_time = True
        elif option == "-nonrecursive":
            out.recursive = False
        elif option == "-nohardlinks":
            out.hard_links = False
        elif option in ("-type", "-name", "-path") and rest:
            value = rest.pop(0)
            if option == "-type":
                if value not in modes.SELECTORS:
                    raise ValueError(f"unknown type {value!r}")
                out.types.append(value)
            elif option == "-name":
                out.name, out.full_path = value, None
            else:
                out.name, out.full_path = None, value
        else:
            raise ValueError(f"unknown option {option!r}")
    out.start = rest[0] if rest else ""
    return out


def expand_glob(line: GlobLine, scanned: DataFrame, tree: DataFrame) -> DataFrame:
    """Entries that a glob line adds to a tree, from those scanned below its start directory.

    Name and path patterns choose among what is found and don't stop the walk; entries whose directory is
    neither in the tree nor among the entries are left out.
    """
    rows = E.one_filesystem(scanned) if line.one_filesystem else scanned
    rows = rows.where(F.col("path") != "") if line.recursive else E.first_level(rows)
    rows = E.with_prefix(rows, line.path)
    rows = E.of_types(rows, line.types) if line.types else rows
    if line.name is not None:
        rows = E.name_matches(rows, line.name)
    if line.full_path is not None:
        rows = E.path_matches(rows, line.full_path)
    keep = [c for c, v in (("mode", line.mode), ("uid", line.uid), ("gid", line.gid)) if v is None] + ["mtime"] * line.keep_time
    rows = E.override(rows, keep, uid=line.uid or 0, gid=line.gid or 0, mode=line.mode or 0)
    # the directory that the line names comes to be if it isn't there
    steps = line.path.split("/") if line.path else []
    own = tree.sparkSession.createDataFrame([("/".join(steps[: i + 1]), modes.DIRECTORY) for i in range(len(steps))], "path string, mode int")
    return E.with_parents_in(rows, tree.select("path", "mode").unionByName(rows.select("path", "mode")).unionByName(own))


# --- sort rules -----------------------------------------------------------------------------------------------

#: Flags of a sort rule.
FLAGS = ("dont_fragment", "dont_compress", "dont_deduplicate", "nosparse")
RULES = "rule int, priority long, flags array<string>, is_glob boolean, path_glob boolean, pattern string, regex string, error string"


def parse_sort_rules(rows: DataFrame) -> DataFrame:
    """Rules of a sort file: rule (the line's number), priority, flags, is_glob, path_glob, pattern, regex, error.

    A line is ``priority [flags] path``; flags are in brackets, paths may be quoted, ``#`` starts a comment.
    """
    import re

    def one(no: int, line: str) -> tuple:
        bad = lambda why: (no, None, None, None, None, None, None, why)
        m = re.fullmatch(r"(-?[0-9]+)(\s+(.*))?", line, re.S)
        if not m:
            return bad("a line starts with a priority")
        if abs(int(m[1])) >= numbers.MAX_LONG:
            return bad("priority is too large")
        rest, flags, is_glob, path_glob = m[3] or "", [], False, False
        if rest.startswith("["):
            inside, end, after = rest[1:].partition("]")
            if not end or not after[:1].isspace():
                return bad("flags end with a bracket and a blank")
            rest = after.lstrip()
            for flag in (f.strip() for f in inside.split(",") if f.strip()):
                if flag in ("glob", "glob_no_path"):
                    is_glob, path_glob = True, flag == "glob"
                elif flag in FLAGS:
                    flags.append(flag)
                else:
                    return bad(f"unknown flag {flag}")
        if rest.startswith('"'):
            q = re.fullmatch(r'"((?:[^"\\]|\\["\\])*)"', rest)
            if not q:
                return bad("quotes don't match")
            rest = re.sub(r'\\(["\\])', r"\1", q[1])
        parts = [p for p in rest.split("/") if p not in ("", ".")]
        if not parts or ".." in parts:
            return bad("a path is expected")
        pattern = "/".join(parts)
        return no, int(m[1]), flags, is_glob, path_glob, pattern, paths.glob_to_regex(pattern, path_glob) if is_glob else None, None

    def run(batches):
        for pdf in batches:
            out = [one(no, line) for no, line in zip(pdf["line_no"], pdf["line"], strict=True)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RULES.split(", ")], dtype=object)

    return clean(rows).where(~F.col("line").startswith("#")).select("line_no", "line").mapInPandas(run, RULES)


def sort_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (path, seq) with priority, flags and rule, the first rule that fits each: 0 and none without one.

    Rules with a literal path are joined by it. Globs are tried on every file: they are broadcast, after a look
    at how many there are.
    """
    from .attributes import broadcast_rules

    good = rules.where("error is null").drop("error")
    literal = files.select("path").join(good.where("not is_glob"), F.col("path") == F.col("pattern")).select("path", "rule", "priority", "flags")
    globbed = files.select("path").join(broadcast_rules(good.where("is_glob")), F.rlike(F.col("path"), F.col("regex"))).select("path", "rule", "priority", "flags")
    first = literal.unionByName(globbed).groupBy("path").agg(F.min(F.struct("rule", "priority", "flags")).alias("r"))
    none = F.array().cast("array<string>")
    return files.join(first, "path", "left").withColumns({"priority": F.coalesce("r.priority", F.lit(0).cast("long")), "flags": F.coalesce("r.flags", none), "rule": F.col("r.rule")}).drop("r")


def unused_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """rule and pattern of the rules that no file takes."""
    used = sort_files(files, rules).where("rule is not null").select("rule").distinct()
    return rules.where("error is null").join(used, "rule", "left_anti").select("rule", "pattern")


def packing_order(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files in ascending priority, equal ones as they were, with position from 0."""
    return numbered(sort_files(files, rules), [F.col("priority"), F.col("seq")], "position", 0)


# --- attribute maps -------------------------------------------------------------------------------------------


def parse_attribute_map(rows: DataFrame) -> DataFrame:
    """block, path, seq, key, value and error of a map file: ``# file: path`` starts a block, ``key=value`` lines follow.

    Blocks are numbered by their line, seq within the file; last setting wins by (block, seq).
    """
    good = clean(rows)
    header = F.regexp_extract("line", r"^# file: (.*)$", 1)
    headers = good.where(F.col("line").startswith("# file: ")).select(F.col("line_no").alias("block"), paths.canonicalize(header).alias("path"))
    pairs = good.where(~F.col("line").startswith("#") & F.col("line").contains("="))
    # a block's lines are those up to the next header: the headers of a file stay few beside its lines
    marked = headers.selectExpr("block line_no", "block", "path").withColumn("line", F.lit(None).cast("string")).unionByName(pairs.select("line_no", F.lit(None).cast("int").alias("block"), F.lit(None).cast("string").alias("path"), "line"))
    marked = marked.withColumn("header", F.when(F.col("block").isNotNull(), F.struct("block", "path")))
    held = last_so_far(marked, "line_no", "header", "head")
    out = held.where(F.col("line").isNotNull())
    key, value = F.substring_index("line", "=", 1), F.expr("substring(line, instr(line, '=') + 1)")
    decoded = text.decode_value_column(value)
    error = F.when(F.col("head").isNull(), "no file so far").when(F.col("head.path").isNull(), "path leaves the tree").when(decoded.isNull(), "value can't be decoded")
    return out.select("head.block", "head.path", F.col("line_no").alias("seq"), key.alias("key"), decoded.alias("value"), error.alias("error"))


# --- labels and defaults --------------------------------------------------------------------------------------

#: What a label file's type field stands for.
LABEL_TYPES = {"--": modes.FILE, "-d": modes.DIRECTORY, "-l": modes.LINK, "-c": modes.CHARACTER, "-b": modes.BLOCK, "-p": modes.FIFO, "-s": modes.SOCKET}


def parse_labels(rows: DataFrame) -> DataFrame:
    """rule, pattern, type and label of lines ``pattern [type] label``."""
    good = clean(rows).where(~F.col("line").startswith("#")).withColumn("f", F.split("line", r"\s+"))
    kind = F.lit(None).cast("int")
    for word, bits in LABEL_TYPES.items():
        kind = F.when(F.get("f", F.lit(1)) == word, bits).otherwise(kind)
    return good.where(F.size("f") >= 2).select(F.col("line_no").alias("rule"), F.get("f", F.lit(0)).alias("pattern"), F.when(F.size("f") > 2, kind).alias("type"), F.element_at("f", -1).alias("label"))


def parse_defaults(spec: str) -> dict[str, int]:
    """``uid=0,gid=0,mode=0755,mtime=0`` in any part; mode in octal."""
    out = {"uid": 0, "gid": 0, "mode": 0o755, "mtime": 0}
    limits = {"uid": U32, "gid": U32, "mode": modes.PERMISSIONS, "mtime": U32}
    for part in filter(None, spec.split(",")):
        name, _, value = part.partition("=")
        if name not in out or not value.isdigit():
            raise ValueError(f"unknown or bad default {part!r}")
        out[name] = int(value, 8 if name == "mode" else 10)
        if out[name] > limits[name]:
            raise ValueError(f"default {name} is too large")
    return out


def source_date(environment: dict[str, str]) -> int:
    """SOURCE_DATE_EPOCH as seconds; 0 if it isn't set or isn't a number below 2^32."""
    value = environment.get("SOURCE_DATE_EPOCH", "")
    return int(value) if value.isascii() and value.isdigit() and int(value) <= U32 else 0
