"""Hashes of substrings, and anchors that depend on nothing but the bytes around them.

Every window of ``length`` bytes is assigned an anchor: the place in it where the hash of ``gram`` bytes
is least (the first of equal ones). Equal windows have their anchors at equal places, with equal
hashes, so a window whose anchor's hash occurs nowhere else occurs nowhere else.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Places hashed at once.
BLOCK = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Polynomial hashes (mod 2**64, then mixed) of any substrings of up to BLOCK bytes and a little more."""

    _made: dict[int, Hasher] = {}

    @classmethod
    def of(cls, spare: int) -> Hasher:
        if spare not in cls._made:
            cls._made[spare] = cls(spare)
        return cls._made[spare]

    def __init__(self, spare: int):
        self.power, self.inverse = _powers(_BASE, BLOCK + spare), _powers(_INVERSE, BLOCK + spare)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((sums[stop] - sums[start]) * self.inverse[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first, last) of each anchor of a byte array: windows first..last (by their starts) are its own. At least ``length`` bytes."""
    width, n = length - gram + 1, len(data) - length + 1
    hasher, parts = Hasher.of(length + gram), []
    for start in range(0, n, BLOCK):
        stop = min(n, start + BLOCK)
        sums = hasher.sums(data[start : stop + length - 1])
        m = len(sums) - gram
        hashes = mixed((sums[gram:] - sums[:m]) * hasher.inverse[:m])
        order = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(m, dtype=np.uint64)
        place = (_least(order, width) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], len(place)) - 1
        parts.append((place[first] + start, hashes[place[first]], first + start, last + start))
    place, hashes, first, last = (np.concatenate(x) for x in zip(*parts))
    same = np.append(False, place[1:] == place[:-1])  # an anchor whose windows lie in two blocks
    keep = ~same
    return place[keep], hashes[keep], first[keep], last[np.append(np.flatnonzero(keep)[1:], len(place)) - 1]
