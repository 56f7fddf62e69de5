"""The LZ4 block format, for images that use it. Written for this library from the public format description.

A block is a run of sequences: a token with the lengths of its literals and its match, the literals, and how far
back the match lies. The last five bytes are literals, and no match starts within the last twelve.
"""

from __future__ import annotations

LEAST_MATCH, LAST_LITERALS, LAST_START, FARTHEST = 4, 5, 12, 0xFFFF
#: Earlier places that the thorough search compares at each position.
THOROUGH = 64


class Damaged(ValueError):
    """A block that can't be unpacked."""


def decompress(data: bytes, most: int) -> bytes:
    """The unpacked block, at most so many bytes."""
    out, at, n = bytearray(), 0, len(data)

    def length(start: int) -> int:
        nonlocal at
        if start == 15:
            while True:
                if at >= n:
                    raise Damaged("a length is cut off")
                start += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        return start

    while at < n:
        token = data[at]
        at += 1
        literals = length(token >> 4)
        if at + literals > n or len(out) + literals > most:
            raise Damaged("literals leave the block")
        out += data[at : at + literals]
        at += literals
        if at == n:
            return bytes(out)
        if at + 2 > n:
            raise Damaged("an offset is cut off")
        back = data[at] | data[at + 1] << 8
        at += 2
        size = length(token & 15) + LEAST_MATCH
        if not 0 < back <= len(out) or len(out) + size > most:
            raise Damaged("a match leaves the block")
        start = len(out) - back
        if back >= size:
            out += out[start : start + size]
        else:  # the match runs into itself
            piece = bytes(out[start:])
            out += (piece * (size // back + 1))[:size]
    raise Damaged("a block ends with a match")


def _lengths(n: int) -> bytes:
    """What follows a length of 15 or more in the token."""
    return b"" if n < 15 else b"\xff" * ((n - 15) // 255) + bytes([(n - 15) % 255])


def _sequence(literals: bytes, back: int, size: int) -> bytes:
    more = size - LEAST_MATCH
    return bytes([min(15, len(literals)) << 4 | min(15, more)]) + _lengths(len(literals)) + literals + back.to_bytes(2, "little") + _lengths(more)


def compress(data: bytes, thorough: bool = False) -> bytes:
    """A block for data: the last place of each four bytes is tried, or the longest of several if thorough."""
    out, anchor, at, n = bytearray(), 0, 0, len(data)
    places: dict[bytes, list[int]] = {}
    while at < n - LAST_START:
        key = data[at : at + LEAST_MATCH]
        found = places.setdefault(key, [])
        best, where = 0, 0
        for place in reversed(found[-THOROUGH:] if thorough else found[-1:]):
            if at - place > FARTHEST:
                break
            limit, size = n - LAST_LITERALS - at, LEAST_MATCH
            while size < limit and data[place + size] == data[at + size]:
                size += 1
            if size > best:
                best, where = size, place
        found.append(at)
        if len(found) > 4 * THOROUGH:
            del found[:-THOROUGH]
        if best >= LEAST_MATCH:
            out += _sequence(data[anchor:at], at - where, best)
            at += best
            anchor = at
        else:
            at += 1
    rest = data[anchor:]
    return bytes(out) + bytes([min(15, len(rest)) << 4]) + _lengths(len(rest)) + rest
