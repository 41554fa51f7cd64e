"""Non-decreasing integers in near-minimal space, with random access.

Each value is cut into ``low`` bits, stored side by side, and a high part, stored in unary in a bit
vector: about 2 + log2(universe / n) bits a value. Value i is read by select(i), the place of the
i-th set bit, which starts from the nearest sampled set bit before it. A run of values is read by the
two selects at its ends and the bits between them. Sampled places are kept as narrow as the bit vector needs.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QqBQQB")


def _narrowest(most: int) -> np.dtype:
    """The narrowest unsigned type that holds most."""
    return np.dtype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


class EliasFano:
    """Encoded values; ``values[i]`` reads one, ``values.run(i, j)`` those from i up to j."""

    def __init__(self, n: int, base: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low, self.lows, self.highs, self.samples = n, base, low, lows, highs, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if n and (np.diff(values) < 0).any():
            raise ValueError("values must not decrease")
        base = int(values[0]) if n else 0
        rest = (values - base).astype(np.uint64)
        top = int(rest[-1]) if n else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((rest[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        places = (rest >> np.uint64(low)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        return cls(n, base, low, np.packbits(bits.ravel(), bitorder="little"), np.packbits(unary, bitorder="little"), places[::SAMPLE].astype(_narrowest(len(unary))))

    def select(self, i: int) -> int:
        """The place of set bit i in the unary part."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = divmod(place, 8)
        word = int(self.highs[byte]) >> skip << skip
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.highs[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.low
        part = int.from_bytes(self.lows[first // 8 : (first + self.low + 7) // 8].tobytes(), "little") >> first % 8
        return self.base + ((self.select(i) - i) << self.low | part & (1 << self.low) - 1)

    def run(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1, from the bits between select(i) and select(j - 1)."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.int64)
        first, last = self.select(i), self.select(j - 1)
        ones = np.unpackbits(self.highs[first // 8 : last // 8 + 1], bitorder="little")
        places = np.flatnonzero(ones[first % 8 : last - first // 8 * 8 + 1]) + first
        start, stop = i * self.low, j * self.low
        bits = np.unpackbits(self.lows[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 : start % 8 + stop - start].reshape(j - i, self.low).astype(np.int64)
        return self.base + ((places - np.arange(i, j)) << self.low) + bits @ (np.int64(1) << np.arange(self.low, dtype=np.int64))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.base, self.low, len(self.lows), len(self.highs), self.samples.dtype.itemsize) + self.lows.tobytes() + self.highs.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, base, low, a, b, width = _HEAD.unpack_from(data)
        start = _HEAD.size
        return cls(n, base, low, np.frombuffer(data, np.uint8, a, start), np.frombuffer(data, np.uint8, b, start + a), np.frombuffer(data, f"<u{width}", -(-n // SAMPLE), start + a + b))
