"""Vectorised hashing of the words of many texts at once.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8
form of a text.  Hashes are 64 bits wide, the same in every process and on
every machine.  Texts are hashed in pieces cut at white space, so the scratch
arrays stay near ``PIECE`` bytes however long a text is.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 4096), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def prefix_sums(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """s with s[i] = sum of values[j] * base**j for j < i; one longer than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def windows(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of values[start:stop] from prefix_sums(values); equal contents hash alike wherever they stand."""
    inverse = powers(_INVERSE, len(sums))
    return mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def _piece(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _WS[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, stop = edge[::2], edge[1::2]
    return start, windows(prefix_sums(buf.astype(np.uint64)), start, stop)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets): the words of text i are hashes[offsets[i]:offsets[i + 1]]."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    joined = b" ".join(texts) + b" "
    buf = np.frombuffer(joined, np.uint8)
    if lower:
        buf = _LOWER[buf]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    starts, hashes, at = [], [], 0
    while at < len(buf):
        to = at + PIECE
        while to < len(buf):
            found = np.flatnonzero(_WS[buf[to : to + 4096]])
            if len(found):
                to += int(found[0])
                break
            to += 4096
        to = min(to, len(buf))
        s, h = _piece(buf[at:to])
        starts.append(s + at)
        hashes.append(h)
        at = to
    return np.concatenate(hashes), np.concatenate([[0], np.searchsorted(np.concatenate(starts), ends)])


def sequence_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of every run of `width` words inside one text, the word at which each starts)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = total * U(_BASE) + words[j : j + n]
    inside = np.ones(n, bool)
    for edge in offsets[1:-1]:
        inside[max(0, edge - width + 1) : edge] = False
    at = np.flatnonzero(inside)
    return mix(total[at] ^ U(width)), at
