"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, and search between arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class SuffixArray(NamedTuple):
    """The suffixes of some strings, each of which ends where its string ends.

    order: the beginnings of the suffixes in order; common: the length that each shares with the one before
    it in order (0 for the first); left: bytes from each position to its string's end.
    """

    data: np.ndarray
    order: np.ndarray
    common: np.ndarray
    left: np.ndarray
    heads: np.ndarray


def _heads(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """At each position the next eight bytes of its string as one number, each plus one; 0 beyond the end.

    No byte is 255, as in UTF-8."""
    out = data.astype(np.uint64) + np.uint64(1)
    for width in (1, 2, 4):
        after = np.zeros_like(out)
        after[:-width] = out[width:]
        after[left <= width] = 0
        out = (out << np.uint64(8 * width)) | after
    return out


def suffix_array(data: np.ndarray, offsets: np.ndarray) -> SuffixArray:
    """The suffix array of strings that lie end to end (offsets: one more than strings).

    Suffixes are first grouped by eight bytes; then a group is refined by the groups that its members reach
    h and 2h bytes on, and h trebles, until each group is one suffix (Larsson and Sadakane, who double: two steps
    in one number spare a third of the rounds). Suffixes that have ended stand before longer ones, and equal
    suffixes of different strings in the order of the strings.
    """
    n = len(data)
    position = np.arange(n)
    left = np.repeat(offsets[1:], np.diff(offsets)) - position
    heads = _heads(data, left)
    order = np.argsort(heads)
    same = np.zeros(n, dtype=bool)
    same[1:] = heads[order][1:] == heads[order][:-1]
    group = np.empty(n, dtype=np.int64)  # of each suffix: the place of its group's first member
    group[order] = np.maximum.accumulate(np.where(same, 0, position))
    h = 8
    steps = (1, 2) if 4 * n**3 < 1 << 62 else (1,)  # as many as fit in one number
    while True:
        # Only members of groups of two or more are sorted again.
        open_ = same.copy()
        open_[:-1] |= same[1:]
        places = np.flatnonzero(open_)
        if not len(places):
            break
        members = order[places]
        g = group[members]
        onward = np.zeros(len(members), dtype=np.int64)
        for step in steps:
            ended = left[members] <= step * h  # below all, by place
            onward = onward * (2 * n) + np.where(ended, members, group[np.minimum(members + step * h, n - 1)] + n)
        sub = np.argsort(g * (2 * n) ** len(steps) + onward)
        members, onward = members[sub], onward[sub]
        order[places] = members
        twin = np.zeros(len(members), dtype=bool)
        twin[1:] = (g[1:] == g[:-1]) & (onward[1:] == onward[:-1])
        same[places] = twin
        group[members] = np.maximum.accumulate(np.where(twin, 0, places))
        h *= 1 + len(steps)
    return SuffixArray(data, order, _kasai(order, left, heads), left, heads)


def _kasai(order: np.ndarray, left: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours, by Kasai's rule: from one position to the next the length falls by at most one.

    Where the bytes before a suffix and before its predecessor in order are the same and both continue, the
    length is exactly one less than that of the position before. Only the other lengths are compared, eight
    bytes at a time and all at once; the rest follow by counting down.
    """
    n = len(order)
    common = np.zeros(n, dtype=np.int64)
    if n < 2:
        return common
    before = np.full(n, -1, dtype=np.int64)  # of each position: its predecessor in order
    before[order[1:]] = order[:-1]
    byte = heads >> np.uint64(56)
    follows = np.zeros(n, dtype=bool)
    i = np.arange(1, n)
    p = before[1:]
    inside = (left[i - 1] == left[i] + 1) & (p > 0)
    inside &= np.where(inside, left[np.maximum(p, 1) - 1] == left[p] + 1, False)
    inside &= np.where(inside, byte[np.maximum(p, 1) - 1] == byte[i - 1], False)
    inside &= before[i - 1] == p - 1
    follows[1:] = inside
    start = np.flatnonzero(~follows)
    start = start[before[start] >= 0]
    length = np.zeros(n, dtype=np.int64)
    length[start] = _extend(heads, left, start, heads, left, before[start])
    origin = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    reached = length[origin] - (np.arange(n) - origin)
    common[1:] = np.maximum(reached[order[1:]], 0)
    return common


def _extend(heads_a, left_a, a, heads_b, left_b, b, limit: int | None = None) -> np.ndarray:
    """The length that the suffixes at a and b have in common, at most limit."""
    most = np.minimum(left_a[a], left_b[b])
    if limit is not None:
        most = np.minimum(most, limit)
    out, rest = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.uint64)
    live = np.flatnonzero(most > 0)
    while len(live):
        x = heads_a[a[live] + out[live]] ^ heads_b[b[live] + out[live]]
        rest[live] = x
        live = live[x == 0]
        out[live] += 8
        live = live[out[live] < most[live]]
    # Leading equal bytes of the first eight that differ: those above the highest bit that differs.
    for j in range(8):
        out += (rest != 0) & (rest >> np.uint64(56 - 8 * j) == 0)
    return np.minimum(out, most)


def repeated_within(array: SuffixArray, size: int) -> np.ndarray:
    """Of each position, whether its first size bytes begin elsewhere in the same array too."""
    long_ = array.common >= size
    out = np.zeros(len(array.order), dtype=bool)
    out[array.order[long_]] = True
    out[array.order[np.flatnonzero(long_) - 1]] = True
    return out


def repeated_across(one: SuffixArray, other: SuffixArray, positions: np.ndarray, size: int) -> np.ndarray:
    """For each of some positions of one, whether its first size bytes begin in other: a binary search in other's order."""
    low, high = np.zeros(len(positions), dtype=np.int64), np.full(len(positions), len(other.order), dtype=np.int64)
    found = np.zeros(len(positions), dtype=bool)
    live = np.arange(len(positions))
    while len(live := live[low[live] < high[live]]):
        middle = (low[live] + high[live]) // 2
        a, b = positions[live], other.order[middle]
        shared = _extend(one.heads, one.left, a, other.heads, other.left, b, size)
        hit = shared >= size
        found[live[hit]] = True
        ended = shared >= other.left[b]
        mine = one.heads[np.minimum(a + shared, len(one.heads) - 1)] >> np.uint64(56)
        theirs = other.heads[np.minimum(b + shared, len(other.heads) - 1)] >> np.uint64(56)
        after = ended | (theirs < mine)  # the suffix in the middle stands before mine
        low[live] = np.where(after, middle + 1, low[live])
        high[live] = np.where(after, high[live], middle)
        live = live[~hit]
    return found
