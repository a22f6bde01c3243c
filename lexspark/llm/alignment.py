"""Banded alignment of word sequences by bit vectors (Hyyrö 2003): the band moves along the diagonal, one integer wide.

Memory is in proportion to the length: each word keeps the list of its places, and a row's match vector is made from those
within the band. The band is widened in steps, so that texts with few differences cost little.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np

#: Places of a word within the band from which on its match vector is packed by numpy instead of summed bit by bit.
_MANY = 24


def within(a: list, b: list, limit: int) -> bool:
    """Whether the edit distance (insert, delete, replace) of a and b is at most limit. Time: length times band."""
    if len(a) < len(b):
        a, b = b, a
    if limit < 0 or len(a) - len(b) > limit:
        return False
    lead = 0
    while lead < len(b) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < len(b) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    if not b:
        return len(a) <= limit
    limit = min(limit, len(a))
    where: dict = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    band = min(limit, max(len(a) - len(b), 16))
    if _banded(len(a), b, where, band):
        return True
    # what both have bounds what an alignment can match
    if band == limit or len(a) - (Counter(a) & Counter(b)).total() > limit:
        return False
    while band < limit:
        band = min(limit, 4 * band)
        if _banded(len(a), b, where, band):
            return True
    return False


def _matches(places: list[int], first: int, width: int) -> int:
    """Bit i for each place first + i."""
    low = bisect_left(places, first)
    high = bisect_left(places, first + width, low)
    if high - low < _MANY:
        out = 0
        for i in places[low:high]:
            out |= 1 << (i - first)
        return out
    bits = np.zeros(width, dtype=np.uint8)
    bits[np.array(places[low:high]) - first] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _banded(n: int, b: list, where: dict, limit: int) -> bool:
    width = 2 * limit + 1
    mask, top = (1 << width) - 1, 1 << limit
    # row 0 of the band: cells left of the diagonal stand outside the matrix and count down to it
    plus, minus = mask ^ (top - 1), top - 1
    score = 0  # on the diagonal of the band
    extra = n - len(b)
    for j, x in enumerate(b):
        places = where.get(x)
        match = _matches(places, j - limit, width) if places else 0
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & mask
        horizontal_plus = minus | (mask & ~(diagonal | plus))
        horizontal_minus = diagonal & plus
        # the cell of the same diagonal one row on
        score += not diagonal & top
        shifted = diagonal >> 1
        plus = (horizontal_minus | (mask & ~(shifted | horizontal_plus))) & mask
        minus = shifted & horizontal_plus
        # it never falls, and the result is at least it less the difference in length
        if score > limit + extra:
            return False
    # from the main diagonal's last cell (row len(b), column len(b)) to column n
    for i in range(limit + 1, limit + 1 + extra):
        bit = 1 << (i - 1)
        score += bool(plus & bit) - bool(minus & bit)
    return score <= limit
