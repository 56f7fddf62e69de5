"""Paths, names and globs as column expressions.

A canonical path has no leading, trailing or doubled slash and no ``.`` component; the root is ''.
Paths are ordered by their components, not as whole strings: ``a/b`` comes before ``a-b``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greater than any name: stands for the end of a directory's contents in sort keys.
LAST = "\U0010ffff"


def parts(path: Column) -> Column:
    """Components of a canonical path; none for the root."""
    return F.filter(F.split(path, "/", -1), lambda x: x != "")


def canonicalize(path: Column) -> Column:
    """The canonical form of path, null if a component is ``..``. Backslashes are ordinary characters."""
    found = F.filter(F.split(path, "/", -1), lambda x: (x != "") & (x != "."))
    return F.when(F.exists(found, lambda x: x == ".."), F.lit(None)).otherwise(F.array_join(found, "/"))


def parent(path: Column) -> Column:
    """Path of the directory that holds path; null for the root."""
    above = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(path == "", F.lit(None)).otherwise(above)


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column) -> Column:
    """0 for the root."""
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/", -1))).cast("int")


def ancestors(path: Column) -> Column:
    """Paths of all directories above path except the root, top first."""
    found = parts(path)
    return F.when(F.size(found) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(found) - 1), lambda n: F.array_join(F.slice(found, 1, n), "/")))


def is_below(path: Column, top: str) -> Column:
    """Whether path is top or lies below it."""
    return F.lit(True) if top == "" else (path == top) | path.startswith(top + "/")


def is_above(path: Column, bottom: str) -> Column:
    """Whether path is a directory above bottom, the root included."""
    steps = bottom.split("/") if bottom else []
    return path.isin("", *["/".join(steps[:i]) for i in range(1, len(steps))]) if bottom else F.lit(False)


#: Names that one operating system reserves, in any case and with any extension.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))


def is_sane_name(column: Column, windows: bool = False) -> Column:
    """Whether a name can be created below a directory without leaving it."""
    sane = (column != "") & ~column.isin(".", "..") & ~column.contains("/")
    if windows:
        device = F.upper(F.substring_index(column, ".", 1)).isin(*RESERVED)
        sane &= ~column.rlike(r'[\x01-\x1f<>:"|?*\\]') & ~device
    return sane


_CLASSES = {"alnum": "A-Za-z0-9", "alpha": "A-Za-z", "blank": " \\t", "cntrl": "\\x00-\\x1f\\x7f", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": " \\t\\n\\x0b\\f\\r", "upper": "A-Z", "xdigit": "0-9A-Fa-f"}


def _bracket(pattern: str, start: int, pathname: bool) -> tuple[str, int] | None:
    """The expression for the bracket that opens at start and where it ends; None if it never closes."""
    i = start + 1
    negated = i < len(pattern) and pattern[i] in "!^"
    i += negated
    items, first = [], True
    while i < len(pattern) and (first or pattern[i] != "]"):
        first = False
        if pathname and pattern[i] == "/":
            return None
        if pattern.startswith("[:", i) and (end := pattern.find(":]", i)) > 0 and pattern[i + 2 : end] in _CLASSES:
            items.append(_CLASSES[pattern[i + 2 : end]])
            i = end + 2
            continue

        def single(at: int) -> tuple[str, int]:
            return (pattern[at + 1], at + 2) if pattern[at] == "\\" and at + 1 < len(pattern) else (pattern[at], at + 1)

        low, i = single(i)
        if i + 1 < len(pattern) and pattern[i] == "-" and pattern[i + 1] != "]":
            high, i = single(i + 1)
            if low <= high:
                items.append(f"{_quoted(low)}-{_quoted(high)}")
        else:
            items.append(_quoted(low))
    if i >= len(pattern):
        return None
    slash = "(?!/)" if pathname else ""
    if not items:
        return (f"{slash}(?s:.)" if negated else "(?!)"), i + 1
    return f"{slash}[{'^' * negated}{''.join(items)}]", i + 1


def _quoted(c: str) -> str:
    return "\\" + c if c in "\\[]^-&~" else c


def glob_to_regex(pattern: str, pathname: bool = False) -> str:
    """A regular expression that matches the whole of what the glob matches.

    ``*``, ``?``, brackets with ``!`` or ``^``, ranges and classes, and backslash escapes. With pathname the
    wildcards don't match a slash. A bracket that never closes stands for itself; a leading dot is not special.
    """
    out, i = [], 0
    anything, one = ("[^/]*", "[^/]") if pathname else (".*", ".")
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while pattern[i + 1 : i + 2] == "*":
                i += 1
            out.append(anything)
        elif c == "?":
            out.append(one)
        elif c == "[" and (found := _bracket(pattern, i, pathname)):
            out.append(found[0])
            i = found[1]
            continue
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "\\z"


def glob(column: Column, pattern: str, pathname: bool = False) -> Column:
    return column.rlike(glob_to_regex(pattern, pathname))
