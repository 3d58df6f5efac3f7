"""Suffix arrays of many short byte strings in numpy: Larsson-Sadakane refinement, Kasai common prefixes, search and merging.

Strings lie one after another; each ends with an end mark of its own, all
marks being smaller than any byte and ordered as the strings are.  So all
suffixes differ, and no common prefix reaches past a string's end.
"""

from __future__ import annotations

import numpy as np

FIRST = 7  # bytes that the first sort looks at


class Strings:
    """data: the bytes; string i is data[offsets[i]:offsets[i + 1]], none being empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        sizes = np.diff(offsets)
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.left = (offsets[1:][self.owner] - np.arange(len(data))).astype(np.int32)

    @classmethod
    def of(cls, parts: list[bytes]) -> Strings:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return cls(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))


def suffix_array(s: Strings) -> np.ndarray:
    """Starts of all suffixes in order.

    Suffixes are sorted by their first bytes; then, round by round, only the
    groups not yet told apart are sorted by the rank of the suffix that
    starts behind what is known to be equal, which doubles the known length.
    """
    n = len(s.data)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([s.data, np.zeros(FIRST, np.uint8)])
    key = np.minimum(s.left, FIRST).astype(np.uint64)
    for j in range(FIRST):
        key |= np.where(s.left > j, padded[j : j + n], 0).astype(np.uint64) << np.uint64(8 * (FIRST - j))
    order = np.argsort(key).astype(np.int64)
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1], [True]])
    del key, ranked
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new[:-1], np.arange(n), 0))
    known, strings = FIRST, len(s.offsets) - 1
    where = np.flatnonzero(~(new[:-1] & new[1:]))
    while len(where):
        who = order[where]
        rest = s.left[who]
        behind = rank[np.minimum(who + known, n - 1)] + strings
        second = np.where(rest <= known, s.owner[who], behind)
        first = rank[who]
        by = np.lexsort((second, first)) if n + strings >= 1 << 31 else np.argsort((first << 32) | second)
        who, first, second = who[by], first[by], second[by]
        order[where] = who
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        new[where] |= fresh
        rank[who] = np.maximum.accumulate(np.where(fresh, where, 0))
        where = where[~(new[where] & new[where + 1])]
        known *= 2
    return order


def common_prefixes(s: Strings, order: np.ndarray) -> np.ndarray:
    """For each place in the suffix array the length of the common prefix with the one before; 0 for the first.

    Kasai: going through the text, a suffix shares at least one byte less
    with its neighbour than the suffix one byte before shared with its own.
    If both are preceded by the same byte it is exactly one less, so only the
    others are compared, eight bytes at a time, and the rest is counted down.
    """
    n = len(order)
    if not n:
        return np.zeros(0, np.int32)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    inner = (s.left + 1 == np.concatenate([[0], s.left[:-1]])) & (before > 0)
    other = np.maximum(before, 1) if n > 1 else np.zeros(n, np.int64)
    inner &= s.left[other] + 1 == s.left[other - 1]
    inner &= s.data[at - 1] == s.data[other - 1]
    here = np.flatnonzero(~inner)
    value = np.zeros(len(here), np.int64)
    live = np.flatnonzero(before[here] >= 0)
    a, b = here[live], before[here[live]]
    most = np.minimum(s.left[a], s.left[b]).astype(np.int64)
    done = np.zeros(len(live), np.int64)
    padded = np.concatenate([s.data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1))
    todo = np.arange(len(live))
    while len(todo):
        x = eight[a[todo] + done[todo]] != eight[b[todo] + done[todo]]
        step = np.where(x.any(1), x.argmax(1), 8)
        done[todo] += step
        todo = todo[(step == 8) & (done[todo] < most[todo])]
    value[live] = np.minimum(done, most)
    start = np.zeros(n, np.int64)
    start[here] = np.arange(len(here))
    start = np.maximum.accumulate(start)
    by_text = value[start] - (at - here[start])
    out = by_text[order].astype(np.int32)
    out[0] = 0
    return out


def repeated(s: Strings, order: np.ndarray, lcp: np.ndarray, width: int, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(whether the `width` bytes at each place of data are found at another place too, one place of each different such string).

    copies: how often each string is there, if not once.
    """
    long = s.left[order] >= width
    group = np.cumsum(~long | (lcp < width))
    size = np.bincount(group, weights=long if copies is None else long * copies[s.owner[order]])
    flags = np.zeros(len(order), bool)
    flags[order] = long & (size[group] > 1)
    first = long & np.concatenate([[True], group[1:] != group[:-1]])
    return flags, order[first]


def search(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each key is in sorted_keys, by binary search."""
    return np.searchsorted(sorted_keys, keys, "right") - np.searchsorted(sorted_keys, keys, "left")
