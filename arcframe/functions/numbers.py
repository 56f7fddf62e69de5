"""Reading and printing numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Printed fractions of sixteenths, and suffixes by power of 1024.
FRACTIONS, SUFFIXES = "0112334456678899", "kMGTPEZY"
U32 = 0xFFFFFFFF
MAX_LONG = 0x7FFFFFFFFFFFFFFF


def print_size(size: Column, round_to_int: bool = True) -> Column:
    """A size with a suffix: divided by 1024 while above it, so that exactly 1024 stays as it is.

    Rounded to a whole number (half up, by sixteenths), or with one digit of fraction.
    """
    out = size.cast("string")
    whole = size.cast("long")
    above = whole > 1024
    for i, suffix in enumerate(SUFFIXES[:6]):  # a long ends within the sixth
        quotient = F.shiftright(whole, 10 * (i + 1))
        sixteenth = F.shiftright(whole, 10 * i).bitwiseAND(1023)
        sixteenth = F.shiftright(sixteenth, 6)
        if round_to_int:
            text = F.concat((quotient + (sixteenth >= 8).cast("long")).cast("string"), F.lit(suffix))
        else:
            digit = F.substring(F.lit(FRACTIONS), (sixteenth + 1).cast("int"), F.lit(1))
            text = F.concat(quotient.cast("string"), F.lit("."), digit, F.lit(suffix))
        before = F.shiftright(whole, 10 * i)
        out = F.when(above & (before > 1024), text).otherwise(out)
        above = above & (before > 1024)
    return out


def parse_size(text: Column) -> Column:
    """Digits with an optional k, m or g (by 1024) as a number; null for anything else or beyond a long."""
    digits = F.regexp_extract(text, r"^([0-9]+)[kKmMgG]?$", 1)
    factor = F.lower(F.regexp_extract(text, r"^[0-9]+([kKmMgG])$", 1))
    times = F.when(factor == "k", 1 << 10).when(factor == "m", 1 << 20).when(factor == "g", 1 << 30).otherwise(1).cast("long")
    value = F.when(digits != "", digits).try_cast("long")
    return F.when(value <= F.lit(MAX_LONG).cast("long") / times, value * times)


def parse_unsigned(text: Column, low: int = 0, high: int = 0) -> Column:
    """Decimal digits as a number; null for anything else, and outside of low to high where low < high."""
    value = F.when(text.rlike("^[0-9]+$"), text).try_cast("long")
    return F.when(value.between(low, high), value) if low < high else value


def parse_octal(text: Column, low: int = 0, high: int = 0) -> Column:
    """Octal digits as a number, as parse_unsigned."""
    value = F.when(text.rlike("^[0-7]{1,21}$"), F.conv(text, 8, 10)).try_cast("long")
    return F.when(value.between(low, high), value) if low < high else value


def parse_signed(text: Column, low: int = 0, high: int = 0) -> Column:
    """Decimal digits with an optional minus sign, as parse_unsigned; the largest long itself counts as too large."""
    value = F.when(text.rlike("^-?[0-9]+$"), text).try_cast("long")
    value = F.when(value.between(-MAX_LONG + 1, MAX_LONG - 1), value)
    return F.when(value.between(low, high), value) if low < high else value


def clamp_time(seconds: Column) -> Column:
    """Seconds as an unsigned 32-bit number, what lies outside at its ends."""
    return F.least(F.greatest(seconds.cast("long"), F.lit(0).cast("long")), F.lit(U32).cast("long"))


def printed_width(number: Column) -> Column:
    """Columns that a number takes in a listing: one less than its digits for 10 and numbers that come down to it."""
    n = number.cast("long")
    width = F.lit(1)
    for i in range(10):
        width = width + (F.floor(n / F.lit(10**i)) > 10).cast("int")
    return width.cast("int")


#: The exceptions that stand for result codes. Other codes from -17 to -1 are an ImageError that carries them.
ERRORS: dict[int, type[Exception]] = {-1: MemoryError, -2: OSError, -7: OverflowError, -8: IndexError, -12: NotADirectoryError, -13: FileNotFoundError, -14: RecursionError, -15: IsADirectoryError, -16: ValueError}


def error_class(code: Column) -> Column:
    """The name of the exception that stands for a result code; null for what is none."""
    out = F.when(code.between(-17, -1), "ImageError")
    for n, kind in ERRORS.items():
        out = F.when(code == n, kind.__name__).otherwise(out)
    return out
