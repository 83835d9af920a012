"""Repeated substrings of a minimum length from a Burrows-Wheeler transform, in numpy.

Intervals are expanded breadth-first by backward extension, so common prefix
lengths come out by increasing value; expansion stops at the minimum length,
and what is then undecided is repeated at that length or more.
"""

from __future__ import annotations

import numpy as np


#: Symbols that one 64-bit number holds; a byte is 1 to 256 there, and 0 ends a string.
PACKED = 7


def transform(codes: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of all suffixes by their first `depth` symbols or more, Burrows-Wheeler transform).

    codes: strings end to end, a byte as 1 to 256, each string closed by a 0 at
    `ends`; every 0 is a symbol of its own, so no match crosses one. The first
    PACKED symbols are sorted as one number, then the sorted width doubles until
    it reaches depth: backward extension to a length below it needs no more.
    """
    n = len(codes)
    key = np.zeros(n, dtype=np.int64)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)  # symbols before the string's end
    for k in range(PACKED):
        key <<= 9
        if k < n:
            key[: n - k] |= np.where(left[: n - k] >= k, codes[k:], 0)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]) | (left[order[1:]] < PACKED)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.cumsum(fresh) - 1
    width = PACKED
    while width < depth and not fresh.all():
        # Only suffixes that still share their rank with a neighbour are sorted again, within their runs.
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        places = np.flatnonzero(tied)
        own = order[places]
        second = rank[np.minimum(own + width, n - 1)]  # a suffix that is not told apart has `width` symbols more
        again = np.lexsort((second, rank[own]))
        own, second = own[again], second[again]
        first = rank[own]
        order[places] = own
        fresh[places[1:]] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        fresh[places[0]] = True
        rank[order] = np.cumsum(fresh) - 1
        width *= 2
    return order, codes[order - 1]


def undecided_after(bwt: np.ndarray, length: int) -> np.ndarray:
    """For each place i of the suffix order, whether suffixes i - 1 and i share `length` symbols or more.

    The suffixes that open with a 0 come first; each is an interval of its own,
    and none is extended by a 0, since nothing shared reaches over an end.
    """
    n = len(bwt)
    strings = int((bwt == 0).sum())
    back = np.argsort(bwt, kind="stable")
    last_to_first = np.empty(n, dtype=np.int64)
    last_to_first[back] = np.arange(n)
    unset = np.ones(n + 1, dtype=bool)
    unset[0] = unset[n] = False
    low, high = np.array([0]), np.array([n - 1])
    for step in range(length):
        if not len(low):
            break
        single = low == high
        alone = low[single]
        new_low = new_high = last_to_first[alone[bwt[alone] != 0]]
        wide_low, wide_high = low[~single], high[~single]
        if len(wide_low):
            sizes = wide_high - wide_low + 1
            owner = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + wide_low[owner]
            symbol = bwt[place]
            inner = symbol != 0
            owner, symbol, place = owner[inner], symbol[inner], place[inner]
            kind = owner * 512 + symbol
            order = np.argsort(kind, kind="stable")
            kind, to = kind[order], last_to_first[place[order]]
            first = np.ones(len(order), dtype=bool)
            first[1:] = kind[1:] != kind[:-1]
            last = np.append(first[1:], True)[: len(order)]
            new_low, new_high = np.concatenate((new_low, to[first])), np.concatenate((new_high, to[last]))
        if step == 0:
            ends = np.arange(strings)
            new_low, new_high = np.concatenate((new_low, ends)), np.concatenate((new_high, ends))
        fresh = unset[new_high + 1]
        low, high = new_low[fresh], new_high[fresh]
        unset[high + 1] = False
    return unset


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, whether each window of `length` bytes starts anywhere else among the strings."""
    out = [np.zeros(max(0, len(s) - length + 1), dtype=bool) for s in strings]
    if not strings:
        return out
    count = len(strings)
    sizes = np.array([len(s) for s in strings])
    codes = np.zeros(int(sizes.sum()) + count, dtype=np.int16)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    body = np.ones(len(codes), dtype=bool)
    body[begins + sizes] = False
    codes[body] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.int16) + 1
    order, bwt = transform(codes, begins + sizes, length + 1)
    shared = undecided_after(bwt, length)
    starts = order[shared[:-1] | shared[1:]]
    owner = np.searchsorted(begins, starts, side="right") - 1
    for k in np.unique(owner):
        out[k][starts[owner == k] - begins[k]] = True
    return out
