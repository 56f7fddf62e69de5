"""File modes and device numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The type bits of a mode.
TYPE_MASK, PERMISSIONS = 0o170000, 0o7777
SOCKET, LINK, FILE, BLOCK, DIRECTORY, CHARACTER, FIFO = 0o140000, 0o120000, 0o100000, 0o060000, 0o040000, 0o020000, 0o010000
LETTERS = {DIRECTORY: "d", CHARACTER: "c", BLOCK: "b", FILE: "-", LINK: "l", SOCKET: "s", FIFO: "p"}
#: What a selector in a glob line is called.
SELECTORS = {"b": BLOCK, "c": CHARACTER, "d": DIRECTORY, "p": FIFO, "f": FILE, "l": LINK, "s": SOCKET}


def type_of(mode: Column) -> Column:
    return mode.bitwiseAND(TYPE_MASK)


def is_type(mode: Column, *types: int) -> Column:
    return type_of(mode).isin(*types)


def _set(mode: Column, bits: int) -> Column:
    return mode.bitwiseAND(bits) == bits


def _letter(mode: Column, bit: int, letter: str) -> Column:
    return F.when(_set(mode, bit), letter).otherwise("-")


def _execute(mode: Column, bit: int, special: int, both: str, only: str) -> Column:
    return F.when(_set(mode, bit | special), both).when(_set(mode, bit), "x").when(_set(mode, special), only).otherwise("-")


def mode_string(mode: Column) -> Column:
    """``drwxr-xr-x``: type, permissions, set-id and sticky bits; an unknown type is ``?``."""
    kind = F.lit("?")
    for bits, letter in LETTERS.items():
        kind = F.when(type_of(mode) == bits, letter).otherwise(kind)
    return F.concat(
        kind,
        _letter(mode, 0o400, "r"), _letter(mode, 0o200, "w"), _execute(mode, 0o100, 0o4000, "s", "S"),
        _letter(mode, 0o040, "r"), _letter(mode, 0o020, "w"), _execute(mode, 0o010, 0o2000, "s", "S"),
        _letter(mode, 0o004, "r"), _letter(mode, 0o002, "w"), _execute(mode, 0o001, 0o1000, "t", "T"),
    )


def octal(mode: Column) -> Column:
    """Permissions as octal digits with a leading zero."""
    return F.concat(F.lit("0"), F.conv(mode.bitwiseAND(PERMISSIONS).cast("string"), 10, 8))


def make_device(major: Column, minor: Column) -> Column:
    """One number for a device: twelve bits of major, twenty of minor, as images and archives store it."""
    low = F.shiftleft(major.cast("long").bitwiseAND(0xFFF), 8).bitwiseOR(minor.cast("long").bitwiseAND(0xFF))
    return low.bitwiseOR(F.shiftleft(minor.cast("long").bitwiseAND(0xFFF00), 12))


def device_major(device: Column) -> Column:
    return F.shiftright(device.cast("long").bitwiseAND(0xFFF00), 8)


def device_minor(device: Column) -> Column:
    return device.cast("long").bitwiseAND(0xFF).bitwiseOR(F.shiftright(device.cast("long"), 12).bitwiseAND(0xFFF00))
