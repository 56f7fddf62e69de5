"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Candidates are found by pattern and validated: check digits, calendar, address ranges. A valid value is
read as a number of a domain, the valid values of its format, and permuted within it by a keyed Feistel
network; the pseudonym is written back in the same format. The same value gives the same pseudonym in
every document, however it is punctuated, and only the key takes it back.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from datetime import date
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
ROUNDS = 10


class Feistel:
    """Keyed permutations of range(size), one for each size and tweak."""

    def __init__(self, key: bytes) -> None:
        self.key = blake2b(key, digest_size=32).digest()

    def _round(self, i: int, half: int, size: int, tweak: str) -> int:
        data = f"{i}:{size}:{tweak}:{half}".encode()
        return int.from_bytes(blake2b(data, key=self.key, digest_size=64).digest(), "big")

    def permute(self, value: int, size: int, tweak: str, valid: Callable[[int], bool] | None = None, back: bool = False) -> int:
        """The place of value in range(size), or among those that are valid: walked until one is met."""
        if size < 2:
            return value
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        sign = -1 if back else 1
        while True:
            left, right = divmod(value, b)
            for i in order:
                if i % 2:
                    right = (right + sign * self._round(i, left, size, tweak)) % b
                else:
                    left = (left + sign * self._round(i, right, size, tweak)) % a
            value = left * b + right
            if value < size and (valid is None or valid(value)):
                return value


# --- numbers in their formats ------------------------------------------------------------------------


def _radix(c: str) -> int:
    return 10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 1


def read(text: str) -> tuple[int, int]:
    """The number that the ASCII digits and letters of text stand for, and how many there are of its format."""
    value, size = 0, 1
    for c in text:
        if (r := _radix(c)) > 1:
            value = value * r + (ord(c) - ord("0" if r == 10 else "a" if c >= "a" else "A"))
            size *= r
    return value, size


def write(value: int, form: str) -> str:
    """form with the number value in place of its digits and letters."""
    out = []
    for c in reversed(form):
        if (r := _radix(c)) > 1:
            value, d = divmod(value, r)
            c = chr(ord("0" if r == 10 else "a" if c >= "a" else "A") + d)
        out.append(c)
    return "".join(reversed(out))


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(number: str) -> int:
    """The check digit that number, without one, gets."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_remainder(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


#: Private IPv4 blocks as address and prefix length, and those that belong to no host.
PRIVATE = ((0x0A000000, 8), (0xAC100000, 12), (0xC0A80000, 16), (0x64400000, 10))
NO_HOST = ((0x00000000, 8), (0x7F000000, 8), (0xA9FE0000, 16), (0xE0000000, 3))


def _inside(address: int, blocks: tuple) -> tuple[int, int] | None:
    return next(((base, bits) for base, bits in blocks if address >> 32 - bits == base >> 32 - bits), None)


def is_public(address: int) -> bool:
    return _inside(address, PRIVATE + NO_HOST) is None


def is_area_phone(number: int) -> bool:
    """Whether ten digits follow the North American plan: area and exchange start with 2 to 9."""
    return number // 10**9 >= 2 and number // 10**6 % 10 >= 2


def is_ssn(number: int) -> bool:
    area = number // 10**6
    return 0 < area < 900 and area != 666 and number // 10**4 % 100 > 0 and number % 10**4 > 0


#: Country calling codes of one and of two digits; all others have three.
CALLING_1 = ("1", "7")
CALLING_2 = ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")


def calling_code(number: str) -> str:
    """The country part of an international number: by the numbering plan, however the number is punctuated."""
    return number[: 1 if number.startswith(CALLING_1) else 2 if number.startswith(CALLING_2) else 3]


FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def _fields(text: str) -> tuple[str, date] | None:
    """The order of a numeric date, ymd, mdy or dmy, and its day; None if there is no such day."""
    parts = re.split("[-./]", text)
    for order in ("ymd",) if len(parts[0]) == 4 else ("mdy", "dmy") if "/" in text else ("dmy", "mdy"):
        y, m, d = (int(parts[order.index(c)]) for c in "ymd")
        try:
            day = date(y, m, d)
        except ValueError:
            continue
        if FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return order, day
    return None


def _dated(day: int, order: str, separator: str) -> str:
    when = date.fromordinal(FIRST_DAY + day)
    return separator.join({"y": f"{when.year:04}", "m": f"{when.month:02}", "d": f"{when.day:02}"}[c] for c in order)


def pseudonym(kind: str, text: str, cipher: Feistel, back: bool = False) -> str | None:
    """The pseudonym of text as a value of kind, None if it isn't a valid one. back: from pseudonym to value."""
    if kind == "email":
        local, at, domain = text.partition("@")
        value, size = read(local)
        return write(cipher.permute(value, size, kind, back=back), local) + at + domain if size > 1 else None
    if kind == "date":
        if (found := _fields(text)) is None:
            return None
        order, day = found
        separator = re.search("[-./]", text)[0]
        # a day after the 12th can't be read as a month, others may be: each stays among its like, whatever the form,
        # so that one permutation serves all forms and what is written back is read in the same order
        plain = lambda n: (date.fromordinal(FIRST_DAY + n).day > 12) == (day.day > 12)
        return _dated(cipher.permute(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, kind, plain, back), order, separator)
    if kind == "iban":
        compact = text.replace(" ", "")
        if iban_remainder(compact) != 1:
            return None
        value, size = read(compact[4:])
        account = write(cipher.permute(value, size, kind + compact[:2], back=back), compact[4:])
        check = 98 - iban_remainder(compact[:2] + "00" + account)
        # 98 - r lies in 2 to 98, the only check digits that the standard issues
        fresh = iter(f"{compact[:2]}{check:02}{account}")
        return "".join(" " if c == " " else next(fresh) for c in text)
    number = digits(text)
    if kind == "card":
        if not 13 <= len(number) <= 19 or luhn(number[:-1]) != int(number[-1]) or len(set(number)) == 1:
            return None
        body = f"{cipher.permute(int(number[:-1]), 10 ** (len(number) - 1), kind, back=back):0{len(number) - 1}}"
        fresh = body + str(luhn(body))
    elif kind == "ip":
        octets = [int(o) for o in text.split(".")]
        address = int.from_bytes(bytes(octets), "big") if max(octets) < 256 else 0
        if _inside(address, NO_HOST):
            return None
        if block := _inside(address, PRIVATE):  # stays in its block
            rest = 1 << 32 - block[1]
            fresh = block[0] + cipher.permute(address % rest, rest, f"{kind}{block[0]}", back=back)
        else:
            fresh = cipher.permute(address, 1 << 32, kind, is_public, back)
        return ".".join(map(str, fresh.to_bytes(4, "big")))
    elif kind == "ssn":
        if not is_ssn(int(number)):
            return None
        fresh = f"{cipher.permute(int(number), 10**9, kind, is_ssn, back):09}"
    elif kind == "phone":
        home = not text.startswith("+") or number.startswith("1") and len(number) == 11
        if home and len(number) in (10, 11):
            value = int(number[-10:])
            same = lambda n: is_area_phone(n) == is_area_phone(value)
            fresh = number[:-10] + f"{cipher.permute(value, 10**10, kind, same, back):010}"
        elif text.startswith("+") and 8 <= len(number) <= 15:
            kept = len(calling_code(number))
            fresh = number[:kept] + f"{cipher.permute(int(number[kept:]), 10 ** (len(number) - kept), kind + number[:kept], back=back):0{len(number) - kept}}"
        else:
            return None
    else:
        raise ValueError(kind)
    each = iter(fresh)
    return "".join(next(each) if "0" <= c <= "9" else c for c in text)


# --- finding -------------------------------------------------------------------------------------------

#: Runs of digits and what numbers are punctuated with; the patterns of single kinds look only inside these.
RUN = re.compile(r"[+(0-9][0-9 ().+/-]*[0-9]")
#: Forms of numbers, in the order in which they are tried at a place.
NUMBERS = {
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?:[0-9]{4}(?P<s1>[-./])[0-9]{2}(?P=s1)[0-9]{2}|[0-9]{2}(?P<s2>[-./])[0-9]{2}(?P=s2)[0-9]{4})(?![0-9]|[-./][0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|-[0-9])|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])",
    "card": r"[0-9]{13,19}(?![0-9])|[0-9]{4}(?P<s3>[ -])[0-9]{4}(?P=s3)[0-9]{4}(?P=s3)[0-9]{1,7}(?![0-9])|[0-9]{4}(?P<s4>[ -])[0-9]{6}(?P=s4)[0-9]{5}(?![0-9])",
}
NUMBER = re.compile(r"(?<![0-9A-Za-z_.])(?:" + "|".join(f"(?P<{k}>{p})" for k, p in NUMBERS.items()) + ")")
NUMBERS = {k: re.compile(p) for k, p in NUMBERS.items()}
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: The longest local part that an address may have (fixed value); what is longer is no address.
LONGEST_LOCAL = 64
DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")


def _word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def matches(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) of everything that looks like a value, in order. Matches overlap: which of them
    hold is known once they are validated. Several kinds at one place have ranks in the order to try."""
    taken = []
    at = text.find("@")
    while at >= 0:
        start = at
        while start and text[start - 1] in LOCAL and at - start <= LONGEST_LOCAL:
            start -= 1
        if at - start > LONGEST_LOCAL:  # no address: not a part of it either
            at = text.find("@", at + 1)
            continue
        while start < at and text[start] in ".-+%":
            start += 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            taken.append((start, 0, m.end(), "email"))
        at = text.find("@", at + 1)
    m = IBAN.search(text)
    while m:
        end = m.end()
        if _word(text, end):  # the last group is the beginning of a word
            end = max(text.rfind(" ", m.start(), end), m.start())
        if end > m.start() and not _word(text, m.start() - 1):
            taken.append((m.start(), 1, end, "iban"))
        m = IBAN.search(text, m.start() + 1)
    for run in RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        m = NUMBER.search(text, run.start(), run.end())
        while m:
            for rank, (kind, form) in enumerate(NUMBERS.items(), 2):
                if (n := form.match(text, m.start(), run.end())) and (not _word(text, n.end()) or (kind == "date" and _time(text, n))):
                    taken.append((n.start(), rank, n.end(), kind))
            m = NUMBER.search(text, m.start() + 1, run.end())
    return sorted(taken)


def _time(text: str, date: re.Match) -> bool:
    """Whether an ISO date goes on with T and the hour."""
    return date[0][4] == "-" and text[date.end()] == "T" and text[date.end() + 1 : date.end() + 2] in set("0123456789")


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of everything that looks like a value, in order, not overlapping; not yet validated."""
    last = 0
    for start, _, end, kind in matches(text):
        if start >= last:
            yield start, end, kind
            last = end


def pseudonymize(text: str, cipher: Feistel, known: Callable[[str, str], str | None] | None = None) -> tuple[str, dict[str, int]]:
    """text with its valid values replaced by pseudonyms, and how many there are of each kind."""
    known = known or (lambda kind, value: pseudonym(kind, value, cipher))
    out, last, counts = [], 0, dict.fromkeys(KINDS, 0)
    for start, _, end, kind in matches(text):
        if start < last:  # inside a value that is replaced
            continue
        fresh = known(kind, text[start:end])
        if fresh is None and kind == "iban" and " " in text[start:end]:
            # the last groups may be words of the text
            value = text[start:end]
            while fresh is None and " " in value:
                value = value.rpartition(" ")[0]
                fresh = known(kind, value)
            end = start + len(value)
        if fresh is not None:
            out += [text[last:start], fresh]
            last = end
            counts[kind] += 1
    return "".join([*out, text[last:]]) if out else text, counts


def pseudonymize_documents(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text with personal values replaced by pseudonyms under key.

    Returns id_col, text, changed and a count for each kind (n_email ...), one row for each input row. A
    null text stays null with counts 0; a text without valid values stays as it is, to the character. Null
    and repeated ids pass through, an empty table gives no rows, other columns are left out. One map, no
    shuffle: equal values get equal pseudonyms because the permutation depends on the key alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        cipher = Feistel(key)
        known = functools.lru_cache(maxsize=50_000)(lambda kind, value: pseudonym(kind, value, cipher))

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            texts, counts = [], {k: [] for k in KINDS}
            for value in batch.column(1):
                text = value.as_py()
                fresh, n = (None, dict.fromkeys(KINDS, 0)) if text is None else pseudonymize(text, cipher, known)
                texts.append(fresh)
                for k in KINDS:
                    counts[k].append(n[k])
            changed = [any(row) for row in zip(*counts.values(), strict=True)]
            yield {"id": batch.column(0), "text": texts, "changed": changed} | {f"n_{k}": counts[k] for k in KINDS}

        return each

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, make, f"id {kind}, text string, changed boolean, " + ", ".join(f"n_{k} int" for k in KINDS)).withColumnRenamed("id", id_col)
