"""Operators on small tables, held against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from arcframe.functions import codecs, modes
from arcframe.operators import attributes, blocks, dictionary, diff, links, rules, tree
from arcframe.operators import entries as E

D, R, L = modes.DIRECTORY | 0o755, modes.FILE | 0o644, modes.LINK | 0o777
SCHEMA = "path string, mode int, uid long, gid long, mtime long, size long, rdev long, target string, hard_link boolean, dev long, inode long, seq long"


def entries(spark, *rows):
    full = [(r[0], r[1], 0, 0, 0, 0, None, *(r[2:4] if len(r) > 2 else (None, False)), 1, i, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def names(df, column="path"):
    return sorted(r[column] for r in df.collect())


def random_tree(seed, links_too=False):
    rng = random.Random(seed)
    dirs, rows = [""], []
    for i in range(60):
        at = rng.choice(dirs)
        path = f"{at}/{rng.choice('abcAB-.é')}{i}".lstrip("/")
        if rng.random() < 0.4:
            dirs.append(path)
            rows.append((path, D))
        else:
            rows.append((path, R))
    rows.append(("", D))
    if links_too:
        files = [p for p, m in rows if m == R]
        for i in range(8):
            rows.append((f"{rng.choice(dirs)}/z{i}".lstrip("/"), L, rng.choice(files), True))
    return rows


def numbering(rows):
    """Inode numbers by walking: subdirectories first, then the own entries by name, the root last; then links moved."""
    children = {}
    for r in rows:
        if r[0]:
            children.setdefault(r[0].rpartition("/")[0], []).append(r)
    order = []

    def walk(path):
        mine = sorted(children.get(path, []), key=lambda r: r[0].rpartition("/")[2].encode())
        for r in mine:
            if r[1] == D:
                walk(r[0])
        order.extend(r[0] for r in mine if not (len(r) > 3 and r[3]))

    walk("")
    order.append("")
    i = 0
    while i < len(order):
        if order[i] in children or order[i] == "":
            at = order[i]
            for r in sorted(children.get(at, []), key=lambda r: r[0].rpartition("/")[2].encode()):
                if len(r) > 3 and r[3] and order.index(r[2]) > i:
                    order.insert(i, order.pop(order.index(r[2])))
                    i += 1
        i += 1
    return {p: n for n, p in enumerate(order, 1)}


@pytest.mark.parametrize("seed", range(4))
def test_inode_numbers(spark, seed):
    rows = random_tree(seed, links_too=seed > 1)
    got = {r.path: r.inode for r in tree.inode_numbers(entries(spark, *rows)).collect()}
    assert got == numbering(rows)


def test_inode_numbers_of_small_trees(spark):
    assert [tuple(r) for r in tree.inode_numbers(entries(spark, ("", D))).collect()] == [("", 1)]
    rows = [("", D), *[(a, D) for a in "abc"], *[(f"{a}/{b}", D) for a in "abc" for b in "xyz"]]
    got = {r.path: r.inode for r in tree.inode_numbers(entries(spark, *rows)).collect()}
    assert sorted(got.values()) == list(range(1, 14)) and all(got[p] < got[p.rpartition("/")[0]] for p in got if p)


def test_implied_directories_and_inserts(spark):
    rows = entries(spark, ("a/b/c", R), ("a", modes.DIRECTORY | 0o700))
    full = tree.with_implied(rows)
    assert names(full) == ["", "a", "a/b", "a/b/c"] and full.where("path = 'a/b'").first().mode == D
    base = entries(spark, ("x", R))
    put = tree.insert(base, entries(spark, ("y/l", L | 0), ("y", modes.DIRECTORY | 0o711)))
    assert {r.path: r.mode for r in put.collect()} == {"x": R, "y/l": L, "y": modes.DIRECTORY | 0o711, "": D}
    for wrong in (("x", R), ("x/below", R)):
        with pytest.raises(Exception, match="exists|not a directory"):
            tree.insert(base, entries(spark, wrong)).collect()


def test_link_counts_and_statistics(spark):
    rows = [("", D), ("d", D), ("d/f", R), ("d/e", D), ("h", L, "d/f", True), ("s", L, "x", False), ("p", modes.FIFO | 0o644), ("c", modes.CHARACTER | 0o600)]
    t = entries(spark, *rows)
    assert {r.path: r.nlink for r in tree.link_counts(t).collect()} == {"": 2 + 5, "d": 4, "d/f": 2, "d/e": 2, "s": 1, "p": 1, "c": 1}
    assert tuple(tree.statistics(t).first()) == (1, 3, 1, 1, 1, 1)


def test_walks(spark):
    dirents = [(1, "a", 2, 1), (1, "f", 3, 2), (2, "b", 4, 1), (4, "up", 2, 1), (1, ".", 1, 1), (1, "..", 1, 1)]
    table = spark.createDataFrame(dirents, "parent_inode long, name string, inode long, type int")
    walked = tree.walk(table, 1)
    assert {(r.path, r.depth) for r in walked.collect()} == {("", 0), ("a", 1), ("f", 1), ("a/b", 2), ("a/b/up", 3)}
    assert names(tree.loops(walked)) == ["a/b/up"]
    assert names(tree.walk(table, 1, depth=1)) == ["", "a", "f"]


def test_paths_of_nodes(spark):
    nodes = [(1, None, ""), (2, 1, "a"), (3, 2, "b"), (4, 3, "c"), (5, 6, "x"), (6, 5, "y"), (7, 99, "lost"), (8, 7, "under")]
    got = {r.node: r.path for r in tree.path_of_nodes(spark.createDataFrame(nodes, "node long, parent long, name string")).collect()}
    assert got == {1: "", 2: "a", 3: "a/b", 4: "a/b/c", 5: None, 6: None, 7: None, 8: None}


def test_resolved_paths(spark):
    t = entries(spark, ("", D), ("d", D), ("d/f", R))
    wanted = spark.createDataFrame([("/d/f/",), ("d/x",), ("d/f/g",), ("",), ("a/../b",)], "path string")
    assert {r.asked: r.error for r in tree.resolve(t, wanted).collect()} == {"/d/f/": None, "d/x": "no such entry", "d/f/g": "not a directory", "": None, "a/../b": "no such entry"}


def test_hard_links(spark):
    rows = [("foo", 1, 1), ("bar", 1, 2), ("baz", 1, 3), ("blub", 1, 2), ("a", 2, 2), ("b", 2, 1), ("c", 2, 2)]
    t = spark.createDataFrame([(p, R, d, i, n) for n, (p, d, i) in enumerate(rows)] + [("dir", D, 1, 2, 99)], "path string, mode int, dev long, inode long, seq long")
    assert {r.path: r.target for r in links.detect(t).where("hard_link").collect()} == {"blub": "bar", "c": "a"}


def test_resolved_links(spark):
    rows = [("f", R), ("d", D), ("a", L, "f", True), *[(f"l{i}", L, f"l{i + 1}" if i < 20 else "a", True) for i in range(21)], ("x", L, "y", True), ("y", L, "x", True), ("m", L, "nowhere", True), ("q", L, "d", True), ("s", L, "s", True), ("into", L, "x", True)]
    got = {r.path: (r.resolved, r.error) for r in links.resolve(entries(spark, *rows)).collect()}
    want = {"a": ("f", None), **{f"l{i}": ("f", None) for i in range(21)}, "x": (None, "loop"), "y": (None, "loop"), "s": (None, "loop"), "into": (None, "loop"), "m": (None, "missing"), "q": (None, "directory")}
    assert got == want
    assert links.resolve(entries(spark, ("f", R))).count() == 0


def test_filters(spark):
    t = entries(spark, ("", D), ("d", D), ("d/f.c", R), ("d/e", D), ("d/e/x", R), ("o", D), ("o/l", L, "x", False))
    assert names(E.prune_empty(t.where("path != 'd/e/x'"))) == ["", "d", "d/f.c", "o", "o/l"]
    assert names(E.prune_empty(t.where(F.col("mode") == D), "d")) == ["d"]
    assert names(E.select_subtrees(t, ["d/e"])) == ["", "d", "d/e", "d/e/x"]
    assert names(E.name_matches(t, "*.c")) == ["d/f.c"] and names(E.path_matches(t, "*/*.c")) == ["d/f.c"]
    assert names(E.exclude_globs(t, ["d/*", "o"])) == ["", "d", "o/l"]
    assert names(E.without_types(t, modes.LINK, modes.DIRECTORY)) == ["", "d", "d/e", "d/e/x", "d/f.c", "o"]
    assert names(E.with_parents_in(t.where("path like '%/%'"), entries(spark, ("d", D)))) == ["d/e", "d/f.c"]
    mounts = t.withColumn("dev", F.when(F.col("path").startswith("d/e"), 9).otherwise(1))
    assert names(E.one_filesystem(mounts)) == ["", "d", "d/f.c", "o", "o/l"]
    assert [r.path for r in E.in_tree_order(entries(spark, ("a-b", R), ("a/b", R), ("a", D), ("", D))).collect()] == ["", "a", "a/b", "a-b"]
    with pytest.raises(ValueError):
        E.of_types(t, ["z"])


def test_listing_of_a_directory(spark):
    rows = [("", D, 0, 0, 3, None, None), ("f", R, 100, 5, 2048, None, None), ("lnk", L, 0, 10, 0, None, "target"), ("dev", modes.BLOCK | 0o660, 0, 6, 0, 0x801, None)]
    t = spark.createDataFrame(rows, "path string, mode int, uid long, gid long, size long, rdev long, target string")
    got = {r.name: r.line for r in E.list_directory(t).collect()}
    assert got == {"f": "-rw-r--r-- 100/5  2k f", "lnk": "lrwxrwxrwx  0/10   6 lnk -> target", "dev": "brw-rw----  0/6 8:1 dev"}


def test_rerooting(spark):
    t = entries(spark, ("", D), ("u", D), ("u/l", D), ("u/l/f", R), ("o", R))
    assert names(E.reroot_out(t, ["u/l"])) == ["f"]
    assert names(E.reroot_out(t, ["u/l"], keep_as_dir=True)) == ["u/", "u/l/", "u/l/f"]
    assert names(E.reroot_out(t, ["u/l"], "top")) == ["top/", "top/f"]
    assert names(E.reroot_out(t)) == ["o", "u/", "u/l/", "u/l/f"]
    back = entries(spark, ("u", D), ("u/a", L, "/u/x", False), ("u/h", L, "u/a", True), ("v", R))
    assert {r.path: r.target for r in E.reroot_in(back, "u").collect()} == {"": None, "a": "/x", "h": "a"}
    assert {r.path: r.target for r in E.reroot_in(back, "u", False).collect()}["a"] == "/u/x"


def contents(spark, *values):
    return spark.createDataFrame([(f"f{i}", i, bytearray(v)) for i, v in enumerate(values)], "path string, seq long, content binary")


def test_blocks(spark):
    values = [b"", b"a" * 10, b"a" * 8, b"\0" * 20, b"xy" * 9, b"a" * 10, bytes(8) + b"tail"]
    files = contents(spark, *values)
    cut = blocks.split(files, 8)
    assert {(r.path, r.idx): (r.size, r.tail) for r in cut.collect()} == {(f"f{i}", k): (min(8, len(v) - 8 * k), len(v) - 8 * k < 8) for i, v in enumerate(values) for k in range(-(-len(v) // 8))}
    assert {r.path: bytes(r.content) for r in blocks.join_blocks(cut).collect()} == {f"f{i}": v for i, v in enumerate(values) if v}
    assert {r.path: r.sparse_bytes for r in blocks.sparse_bytes(cut).collect()} == {"f1": 0, "f2": 0, "f3": 20, "f4": 0, "f5": 0, "f6": 8}
    assert {r.path: r.duplicate_of for r in blocks.duplicate_files(files).collect() if r.duplicate_of} == {"f5": "f1"}
    stats = blocks.pack_statistics(files, 8).first().asDict()
    assert stats == {"bytes_read": 78, "bytes_written": 8 + 8 + 16 + 2 + 2 + 4, "ratio": 51, "data_blocks": 5, "fragment_blocks": 1, "sparse_blocks": 4, "duplicate_blocks": 1, "fragments": 4, "duplicate_fragments": 1}
    packed = {r.path: (r.fragment, r.fragment_offset) for r in blocks.pack_tails(cut, 8).collect()}
    assert packed == {"f1": (0, 0), "f4": (0, 2), "f5": (0, 0), "f6": (0, 4)}
    assert {r.fragment: bytes(r.data) for r in blocks.fragment_blocks(cut, 8).collect()} == {0: b"aaxytail"}


def test_ranges(spark):
    rng = random.Random(5)
    values = [rng.randbytes(n) for n in (0, 5, 8, 29, 64)]
    table = blocks.offsets(blocks.split(contents(spark, *values), 8).withColumn("stored", F.col("size")))
    wanted = [(f"f{i}", rng.randrange(70), rng.randrange(30)) for i in range(5) for _ in range(12)]
    got = blocks.read_ranges(table, spark.createDataFrame(sorted(set(wanted)), "path string, offset long, length long")).collect()
    assert len(got) == len(set(wanted)) and all(bytes(r.data or b"") == values[int(r.path[1:])][r.offset : r.offset + r.length] for r in got)


def test_runs_of_stored_blocks(spark):
    def reference(files):
        stored, out = [], {}
        for i, run in enumerate(files):
            if not run:
                continue
            start, every = len(stored), stored + run
            at = next(k for k in range(start + 1) if every[k : k + len(run)] == run)
            if at < start:
                stored = every[: max(start, at + len(run))]
            else:
                stored = every
            out[f"f{i}"] = at
        return out

    rng = random.Random(7)
    files = [[rng.choice("ab") for _ in range(rng.randrange(5))] for _ in range(40)]
    rows = contents(spark, *["".join(c * 4 for c in f).encode() for f in files])
    got = {r.path: r.start for r in blocks.duplicate_runs(blocks.split(rows, 4)).collect()}
    assert got == reference(files)


def test_transformed_blocks(spark):
    values = [b"ab" * 3000, bytes(5000), random.Random(1).randbytes(5000)]
    got = codecs.transform_blocks(blocks.split(contents(spark, *values), 4096), codecs.codec("gzip", 4096)).collect()
    by = {(r.path, r.idx): r for r in got}
    assert by["f0", 0].compressed and by["f1", 0].sparse and not by["f2", 0].compressed and by["f2", 0].stored_size == 4096
    assert not by["f0", 1].compressed and by["f0", 1].tail


def test_attribute_sets(spark):
    pairs = [(0, 0, "user.a", b"1"), (0, 1, "user.b", b"long value"), (1, 2, "user.a", b"9"), (1, 3, "user.a", b"2"), (2, 4, "user.b", b"long value"), (2, 5, "user.a", b"1"), (3, 6, "user.a", b"2"), (4, 7, "user.c", b"long value")]
    t = spark.createDataFrame([(o, s, k, bytearray(v)) for o, s, k, v in pairs], "owner long, seq long, key string, value binary")
    assert {r.owner: r.xattr_index for r in attributes.attribute_sets(t).collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 2}
    assert {(r.xattr_index, r.key): r.out_of_line for r in attributes.stored_pairs(t).collect()} == {(0, "user.a"): False, (0, "user.b"): False, (1, "user.a"): False, (2, "user.c"): True}


def test_dictionaries(spark):
    t = spark.createDataFrame([(1, 5, 7), (2, 7, 5), (3, 0, 9)], "inode long, uid long, gid long")
    ids = dictionary.id_dictionary(t)
    assert {r.id: r.idx for r in ids.collect()} == {5: 0, 7: 1, 0: 2, 9: 3}
    coded = dictionary.encode_ids(t, ids)
    assert {(r.uid_index, r.gid_index) for r in coded.collect()} == {(0, 1), (1, 0), (2, 3)}
    assert dictionary.decode_ids(coded.drop("uid", "gid"), ids).select("inode", "uid", "gid").exceptAll(t).count() == 0


LISTING = """# a comment
dir /dir 0755 0 0
  nod /dev/console 0600 6 7 c 13 37
nod /dev/blk 0600 8 9 b 42 21
link /foo "/a\\"l \\\\ink" 0777 0 0 /bin/bash
slink "/slink" 0644 1 2 slinktarget
pipe "/pi pe" 0644 3 4
sock /sock 0555 12 13
file "/foo bar/ test \\"/" 0644 5 6 input
file /plain 0644 1 1
dir / 0711 3 3
"""


def lines(spark, body):
    return spark.createDataFrame(list(enumerate(body.split("\n"), 1)), "line_no int, line string")


def test_listings(spark):
    got = {r.path: r for r in rules.parse_listing(lines(spark, LISTING), 42).collect() if not r.error}
    assert got["dir"].mode == D and got["dev/console"].mode == modes.CHARACTER | 0o600 and got["dev/console"].rdev == 13 << 8 | 37
    assert got["slink"].target == "slinktarget" and got["slink"].mode == L and got["pi pe"].mode == modes.FIFO | 0o644
    assert got['foo bar/ test "'].source == "input" and got["plain"].source == "plain" and got[""].mode == modes.DIRECTORY | 0o711
    bad = ["dir a 0755 0", "odd a 0755 0 0", "dir ../a 0755 0 0", "file / 0644 0 0", "dir a 0999 0 0", "dir a 0755 x 0", "dir a 0755 0 4294967296", "slink a 0777 0 0", "nod a 0600 0 0 c 1", "nod a 0600 0 0 x 1 2", "nod a 0600 0 0 c 1 z", "file a 0644 0 0 b c", 'dir "a 0755 0 0', "link a 0777 0 0", "glob a * 0 0"]
    errors = rules.listing_errors(rules.parse_listing(lines(spark, "\n".join(bad))))
    assert errors.count() == len(bad) - 1


def test_listings_of_trees_read_back(spark):
    rows = [("d", D), ('q "uo te', R), ("d/l", L, "where", False), ("d/p", modes.FIFO | 0o600), ("d/s", modes.SOCKET | 0o600)]
    t = entries(spark, *rows, ("", D))
    again = rules.parse_listing(E.describe(t).select(F.lit(1).alias("line_no"), "line"))
    assert {(r.path, r.mode, r.target) for r in again.collect()} == {(r[0], r[1], r[2] if len(r) > 2 else None) for r in rows}


def test_globs_in_listings(spark):
    g = rules.parse_glob('glob /usr * 0 * -type f -type l -name "*.so" -xdev -keeptime -- lib')
    assert (g.path, g.mode, g.uid, g.gid, g.types, g.name, g.one_filesystem, g.keep_time, g.start) == ("usr", None, 0, None, ["f", "l"], "*.so", True, True, "lib")
    scanned = entries(spark, ("a.so", R), ("d", D), ("d/b.so", R), ("d/c.h", R))
    in_tree = entries(spark, ("usr", D))
    every = rules.parse_glob("glob usr 0600 7 8")
    out = {r.path: (r.mode, r.uid) for r in rules.expand_glob(every, scanned, in_tree).collect()}
    assert out == {"usr/a.so": (modes.FILE | 0o600, 7), "usr/d": (modes.DIRECTORY | 0o600, 7), "usr/d/b.so": (modes.FILE | 0o600, 7), "usr/d/c.h": (modes.FILE | 0o600, 7)}
    assert names(rules.expand_glob(rules.parse_glob("glob usr * * * -name *.so"), scanned, in_tree)) == ["usr/a.so"]
    assert names(rules.expand_glob(rules.parse_glob("glob usr * * * -nonrecursive"), scanned, in_tree)) == ["usr/a.so", "usr/d"]
    for wrong in ("glob a 0 0", "glob a 0 0 0 -type x", "glob a 0 0 0 -what"):
        with pytest.raises(ValueError):
            rules.parse_glob(wrong)


SORT = ['# comment', '10 [dont_fragment, nosparse] "a file"', "-5 [glob] dir/*", "3 [glob_no_path] *.c", "-5 unused", "x y", "5", "7 [odd] z", '8 "open', "9 ../up", "4 [glob"]


def test_sort_rules(spark):
    parsed = rules.parse_sort_rules(lines(spark, "\n".join(SORT)))
    assert sorted(r.rule for r in parsed.where("error is not null").collect()) == [6, 7, 8, 9, 10, 11]
    paths = ["a file", "dir/x", "dir/y/z.c", "q.c", "rest", "dir/w.c"]
    files = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, seq long")
    got = [(r.path, r.priority, r.flags) for r in rules.packing_order(files, parsed).orderBy("position").collect()]
    assert got == [("dir/x", -5, []), ("dir/w.c", -5, []), ("rest", 0, []), ("dir/y/z.c", 3, []), ("q.c", 3, []), ("a file", 10, ["dont_fragment", "nosparse"])]
    assert names(rules.unused_rules(files, parsed), "pattern") == ["unused"]


def test_attribute_maps(spark):
    body = "# file: dev/\nuser.a=0x6162\nuser.b=0sZm9v\n\n# file: /rom\nuser.c=\"te\\\"xt\\101\"\nuser.c=again\n# file: none\nuser.d=x"
    parsed = rules.parse_attribute_map(lines(spark, body))
    got = attributes.apply_map(entries(spark, ("dev", D), ("rom", R)), parsed.where("error is null"))
    assert {(r.path, r.key): bytes(r.value) for r in got.collect()} == {("dev", "user.a"): b"ab", ("dev", "user.b"): b"foo", ("rom", "user.c"): b"again"}
    assert rules.parse_attribute_map(lines(spark, "user.a=1")).first().error == "no file so far"


def test_labels_and_defaults(spark):
    t = rules.parse_labels(lines(spark, "# c\n/.* any\n/d/.* -- file\n/d -d dir"))
    got = attributes.labels(entries(spark, ("d", D), ("d/f", R), ("d/l", L, "x", False)), t, "none")
    assert {r.path: r.label for r in got.collect()} == {"d": "dir", "d/f": "file", "d/l": "any"}
    assert rules.parse_defaults("uid=5,mode=0711") == {"uid": 5, "gid": 0, "mode": 0o711, "mtime": 0}
    for wrong in ("x=1", "uid=a", "mode=10000"):
        with pytest.raises(ValueError):
            rules.parse_defaults(wrong)
    assert [rules.source_date({"SOURCE_DATE_EPOCH": v}) for v in ("1337", "", "x", "99999999999")] == [1337, 0, 0, 0]


def test_differences(spark):
    old = entries(spark, ("", D), ("same", R), ("gone", R), ("d", D), ("d/x", R), ("t", D), ("t/below", R), ("l", L, "a", False))
    new = entries(spark, ("", D), ("same", modes.FILE | 0o600), ("d", D), ("d/x", R), ("d/more", R), ("t", R), ("l", L, "b", False)).withColumn("size", F.when(F.col("path") == "d/x", 5).otherwise(F.col("size")))
    assert {(r.path, r.side) for r in diff.only(old, new).collect()} == {("gone", "<"), ("d/more", ">")}
    assert {(r.path, r.difference) for r in diff.attributes(old, new).collect()} == {("same", "permissions"), ("d/x", "content"), ("t", "type"), ("l", "target")}
    assert diff.only(old, old).count() == diff.attributes(old, old, [*diff.DEFAULT, *diff.ASKED]).count() == 0
    a, b = contents(spark, b"x" * 20, b"same", b"ab"), contents(spark, b"x" * 15 + b"y" * 5, b"same", b"abc")
    got = {r.path: r.first_difference for r in diff.contents(a, b, 8).collect()}
    assert got == {"f0": 8, "f2": None}
    with_mode = lambda t: t.withColumn("mode", F.lit(R))
    assert {(r.side, r.path) for r in diff.extract(with_mode(a), with_mode(b)).collect()} == {(s, p) for s in ("old", "new") for p in ("f0", "f2")}


@pytest.mark.parametrize("partitions", [1, 7])
def test_partitions_dont_matter(spark, partitions):
    t = entries(spark, *random_tree(9)).repartition(partitions)
    assert {r.path: r.inode for r in tree.inode_numbers(t).collect()} == numbering(random_tree(9))
    files = contents(spark, *[bytes([i % 5]) * (i % 23) for i in range(60)]).repartition(partitions)
    packed = sorted(map(tuple, blocks.pack_tails(blocks.split(files, 16), 16).collect()))
    again = sorted(map(tuple, blocks.pack_tails(blocks.split(files.repartition(3), 16), 16).collect()))
    assert packed == again


@pytest.mark.parametrize("seed", range(4))
def test_packing_of_ranges_is_that_of_one_order(spark, seed):
    """Tails placed range by range, against one after another; runs of blocks against the rule as it is told."""
    rng = random.Random(seed)
    size = [16, 64, 256, 5][seed]
    rows = [(f"f{i}", i, bytes(rng.choices(b"abc", k=rng.randrange(0, 3 * size)))) for i in range(300)]
    cut = blocks.split(spark.createDataFrame([(p, s, bytearray(c)) for p, s, c in rows], "path string, seq long, content binary").repartition(5), size)
    fragment, used, places, want = -1, size, {}, {}
    for path, _, content in rows:
        tail = content[len(content) // size * size :]
        if tail and tail not in places:
            if used + len(tail) > size:
                fragment, used = fragment + 1, 0
            places[tail] = fragment, used
            used += len(tail)
        if tail:
            want[path] = places[tail]
    assert {r.path: (r.fragment, r.fragment_offset) for r in blocks.pack_tails(cut, size).collect()} == want

    small = [(f"f{i}", i, bytes(rng.choices(b"ab", k=rng.randrange(1, 5))) if i % 3 else f"unique{i}".encode()) for i in range(150)]
    frame = spark.createDataFrame([(p, s, bytearray(c)) for p, s, c in small], "path string, seq long, content binary")
    stored, starts = "", {}
    for path, _, content in small:
        run = content.decode()
        at = (stored + run).find(run)
        starts[path] = at
        stored += run[len(run) - max(0, at + len(run) - len(stored)) :] if at < len(stored) else run
    assert {r.path: r.start for r in blocks.duplicate_runs(blocks.split(frame, 1)).collect()} == starts


def test_hot_keys_are_joined_another_way(spark, monkeypatch):
    from arcframe.operators import order

    rows = spark.createDataFrame([(f"p{i}", i, bytearray(b"same" if i % 2 else b"x%d" % i)) for i in range(60)], "path string, seq long, content binary")
    want = sorted(map(tuple, blocks.duplicate_files(rows).collect()), key=str)
    monkeypatch.setattr(order, "HOT_ROWS", 5)
    assert sorted(map(tuple, blocks.duplicate_files(rows).collect()), key=str) == want
    assert sorted(map(tuple, links.detect(rows.selectExpr("path", "seq", "33188 as mode", "1 as dev", "content as inode")).select("path", "target").collect()))[0] == ("p0", None)


def test_equal_requests_have_a_row_each(spark):
    cut = blocks.offsets(blocks.split(spark.createDataFrame([("a", 0, bytearray(b"0123456789"))], "path string, seq long, content binary"), 4).withColumn("stored", F.col("size")))
    wanted = spark.createDataFrame([("a", 2, 5), ("a", 2, 5), ("a", 9, 5)], "path string, offset long, length long")
    assert sorted(bytes(r.data) for r in blocks.read_ranges(cut, wanted).collect()) == [b"23456", b"23456", b"9"]


def test_too_many_rules_are_refused(spark, monkeypatch):
    monkeypatch.setattr(attributes, "MOST_RULES", 2)
    rules_table = spark.createDataFrame([(i, ".*", None, "x") for i in range(3)], "rule int, pattern string, type int, label string")
    with pytest.raises(ValueError):
        attributes.labels(spark.createDataFrame([("a", 33188)], "path string, mode int"), rules_table)
