"""Quoted lines, encodings of binary values, attribute names and checksums.

What regular expressions can say is a column expression. The rest is plain Python on one value, wrapped
as Arrow-batched functions at the end of the module.
"""

from __future__ import annotations

import base64
import binascii
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LineError(ValueError):
    """A line that can't be split: an open quote or an unknown escape."""


def split_line(line: str, separators: str = " \t") -> list[str]:
    """Fields of a line. A field that starts with a double quote runs to the next one; \\" and \\\\ stand for themselves there."""
    out, at = [], 0
    plain = re.compile(f"[^{re.escape(separators)}]*")
    gap = re.compile(f"[{re.escape(separators)}]*")
    line = line.partition("\0")[0]
    while (at := gap.match(line, at).end()) < len(line):
        if line[at] != '"':
            m = plain.match(line, at)
            out.append(m[0])
        else:
            m = re.compile(r'"((?:[^"\\]|\\["\\])*)"').match(line, at)
            if m is None:
                wrong = re.compile(r'"(?:[^"\\]|\\["\\])*(.?)', re.S).match(line, at)
                raise LineError("unknown escape" if wrong[1] else "open quote")
            out.append(re.sub(r'\\(["\\])', r"\1", m[1]))
        at = m.end()
    return out


def quote_name(path: Column) -> Column:
    """A path as a field of a line: quoted if it has a blank or a quote."""
    return F.when(path.contains(" ") | path.contains('"'), F.concat(F.lit('"'), F.replace(path, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(path)


def decode_base64(text: str) -> bytes | None:
    """Base64 with ``=`` or ``_`` as padding, or without any at the end; None if it isn't."""
    body = re.fullmatch(r"([A-Za-z0-9+/]*)([=_]{0,2})", text)
    if body is None:
        return None
    digits, padding = body.groups()
    rest = len(digits) % 4
    if rest == 1 or (padding and (rest == 0 or len(padding) > 4 - rest)):
        return None
    return base64.b64decode(digits + "=" * (-len(digits) % 4))


def decode_hex(text: str) -> bytes | None:
    try:
        return binascii.unhexlify(text)
    except (binascii.Error, ValueError):
        return None


def decode_value(text: str) -> bytes | None:
    """An attribute value: 0x and hex digits, 0s and base64, or text, in quotes or not, with escapes by backslash."""
    if text[:2] in ("0x", "0X"):
        digits = text[2:]
        return decode_hex(digits[: len(digits) // 2 * 2])
    if text[:2] in ("0s", "0S"):
        return decode_base64(text[2:])
    if len(text) > 1 and text[0] == text[-1] == '"':
        text = text[1:-1]
    data = text.encode("utf-8", "surrogateescape")

    def escape(m: re.Match) -> bytes:
        return bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else m[1]

    return re.sub(rb'\\([0-7]{1,3}|["\\])', escape, data)


def decode_url(text: bytes) -> bytes:
    """Bytes with %XX turned into the byte; a percent sign without two hex digits stays."""
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text)


def nibbles(value: Column) -> Column:
    """Bytes as text, two hexadecimal digits each, the lower four bits first."""
    return F.regexp_replace(F.hex(value), "(.)(.)", "$2$1")


def xxh32(data: bytes) -> int:
    """The 32-bit block checksum, seed 0. From 16 bytes on, the fourth lane starts at the first prime itself,
    not at its negative: values of longer inputs differ from those of the published hash."""
    # fixed values: the primes
    p1, p2, p3, p4, p5, top = 2654435761, 2246822519, 3266489917, 668265263, 374761393, 0xFFFFFFFF

    def turn(x: int, n: int) -> int:
        return (x << n | x >> (32 - n)) & top

    at = 0
    if len(data) >= 16:
        lanes = [(p1 + p2) & top, p2, 0, p1]
        while at + 16 <= len(data):
            for i in range(4):
                word = int.from_bytes(data[at + 4 * i : at + 4 * i + 4], "little")
                lanes[i] = turn((lanes[i] + word * p2) & top, 13) * p1 & top
            at += 16
        h = sum(turn(lane, n) for lane, n in zip(lanes, (1, 7, 12, 18), strict=True)) & top
    else:
        h = p5
    h = (h + len(data)) & top
    while at + 4 <= len(data):
        h = turn((h + int.from_bytes(data[at : at + 4], "little") * p3) & top, 17) * p4 & top
        at += 4
    for byte in data[at:]:
        h = turn((h + byte * p5) & top, 11) * p1 & top
    h = (h ^ h >> 15) * p2 & top
    h = (h ^ h >> 13) * p3 & top
    return h ^ h >> 16


# --- attribute names ------------------------------------------------------------------------------------

#: Prefixes by their number.
PREFIXES = ("user.", "trusted.", "security.")


def prefix_id(key: Column) -> Column:
    """Number of a key's prefix; null if it has none of the three, or nothing after it."""
    out = F.lit(None).cast("int")
    for i, prefix in enumerate(PREFIXES):
        out = F.when(key.startswith(prefix) & (F.length(key) > len(prefix)), i).otherwise(out)
    return out


def key_suffix(key: Column) -> Column:
    """What follows a known prefix; null without one."""
    return F.when(prefix_id(key).isNotNull(), F.substring(key, F.instr(key, ".") + 1, F.length(key)))


def full_key(prefix: Column, suffix: Column) -> Column:
    """The key of a prefix number and the rest; null for an unknown number."""
    return F.concat(F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), F.when(prefix.between(0, 2), prefix + 1).cast("int")), suffix)


#: Sequences of up to six bytes, and single bytes but for most control characters.
_PRINTABLE = re.compile(
    rb"(?:[\x00\x07-\x0d\x20-\x7e\x80-\xbf\xfe\xff]|[\xc0-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf7][\x80-\xbf]{3}|[\xf8-\xfb][\x80-\xbf]{4}|[\xfc\xfd][\x80-\xbf]{5})*+"
)


def is_printable(value: bytes) -> bool:
    """Whether a value is shown as text: no control characters but 0 and 7 to 13, no broken-off sequence."""
    return _PRINTABLE.fullmatch(value) is not None


# --- as functions of columns ------------------------------------------------------------------------------


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_line_column(lines: pd.Series) -> pd.Series:
    """Fields of each line; null where the line is null or can't be split."""

    def one(line: str | None) -> list[str] | None:
        try:
            return None if line is None else split_line(line)
        except LineError:
            return None

    return lines.map(one)


@F.pandas_udf(T.BinaryType())
def decode_value_column(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else decode_value(v))


@F.pandas_udf(T.BinaryType())
def decode_base64_column(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else decode_base64(v))


@F.pandas_udf(T.LongType())
def xxh32_column(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else xxh32(bytes(v)))


@F.pandas_udf(T.StringType())
def shown_value_column(values: pd.Series) -> pd.Series:
    """Values as text if they are printable, in hex otherwise."""
    return values.map(lambda v: None if v is None else bytes(v).decode("utf-8", "replace") if is_printable(bytes(v)) else "0x" + bytes(v).hex().upper())
