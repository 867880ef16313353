"""Directly addressable codes: numbers in chunks of a byte, each of which can be read by itself.

Level 0 holds the lowest byte of every number. A bitmap says which numbers go on, and level 1 holds the next
byte of these alone, in the same order, and so on. The number at place i goes on at place rank(i) of the next level,
the count of ones before i in the bitmap. A rank directory has that count at every ``BLOCK`` bits, so a rank reads one entry
of it and at most eight words of the bitmap, and a number one byte of each of its levels. Nothing else is decoded.

Little-endian layout of ``pack``::

    4 bytes   "DAC1"
    uint32    number of levels
    uint64    numbers on each level
    by level  the bytes, filled up to a multiple of 8
              but for the last: the bitmap in uint64 words, filled up to whole blocks,
              and the rank directory, a uint64 for every block
"""

from __future__ import annotations

import numpy as np

MAGIC = b"DAC1"
#: Bits of the bitmap for each entry of the rank directory.
BLOCK = 512
WORDS = BLOCK // 64


def pack(numbers: np.ndarray) -> bytes:
    """The codes of an array of unsigned 32-bit integers, which may be empty."""
    rest, levels, bitmaps = np.asarray(numbers, dtype=np.uint32), [], []
    while True:
        levels.append(rest.astype(np.uint8))
        more = rest > 0xFF
        if not more.any():
            break
        bits = np.zeros(-(-len(rest) // BLOCK) * BLOCK, dtype=bool)
        bits[: len(rest)] = more
        bitmaps.append(np.packbits(bits, bitorder="little").view("<u8"))
        rest = rest[more] >> np.uint32(8)
    out = [MAGIC, np.uint32(len(levels)).tobytes(), np.array([len(x) for x in levels], dtype="<u8").tobytes()]
    for n, level in enumerate(levels):
        out += [level.tobytes(), bytes(-len(level) % 8)]
        if n < len(bitmaps):
            ones = np.bitwise_count(bitmaps[n]).reshape(-1, WORDS).sum(axis=1, dtype="<u8")
            out += [bitmaps[n].tobytes(), (np.cumsum(ones, dtype="<u8") - ones).tobytes()]
    return b"".join(out)


class Codes:
    """Packed numbers. Opening them only finds the places of their parts."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("these bytes do not begin as directly addressable codes do")
        count = int(np.frombuffer(data, "<u4", 1, 4)[0])
        sizes = np.frombuffer(data, "<u8", count, 8).tolist()
        at, self.levels, self.bitmaps, self.ranks = 8 + 8 * count, [], [], []
        for n, size in enumerate(sizes):
            self.levels.append(np.frombuffer(data, np.uint8, size, at))
            at += size + -size % 8
            if n < count - 1:
                blocks = -(-size // BLOCK)
                self.bitmaps.append(np.frombuffer(data, "<u8", blocks * WORDS, at).reshape(-1, WORDS))
                at += blocks * WORDS * 8
                self.ranks.append(np.frombuffer(data, "<u8", blocks, at))
                at += blocks * 8

    def __len__(self) -> int:
        return len(self.levels[0])

    def _rank(self, level: int, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = places // BLOCK
        # Bits to count of each word of the block.
        bits = np.clip((places % BLOCK)[:, None] - 64 * np.arange(WORDS), 0, 64).astype(np.uint64)
        full = bits == 64
        mask = (np.uint64(1) << np.where(full, np.uint64(0), bits)) - np.uint64(1)
        mask[full] = np.uint64(0xFFFFFFFFFFFFFFFF)
        ones = np.bitwise_count(self.bitmaps[level][block] & mask).sum(axis=1, dtype=np.int64)
        return self.ranks[level][block].astype(np.int64) + ones

    def _goes_on(self, level: int, places: np.ndarray) -> np.ndarray:
        words = self.bitmaps[level].reshape(-1)[places // 64]
        return (words >> (places % 64).astype(np.uint64) & np.uint64(1)).astype(bool)

    def at(self, places) -> np.ndarray:
        """The numbers at any places, in their order."""
        places = np.asarray(places, dtype=np.int64)
        if len(places) and not 0 <= places.min() <= places.max() < len(self):
            raise IndexError(f"places go from 0 to {len(self) - 1}")
        out, own = np.zeros(len(places), dtype=np.uint32), np.arange(len(places))
        for n, level in enumerate(self.levels):
            out[own] |= level[places].astype(np.uint32) << np.uint32(8 * n)
            if n == len(self.bitmaps):
                break
            more = self._goes_on(n, places)
            own, places = own[more], self._rank(n, places[more])
        return out

    def between(self, start: int, stop: int) -> np.ndarray:
        """The numbers from ``start`` to ``stop``, exclusive: a range of every level, found by two ranks."""
        if not 0 <= start <= stop <= len(self):
            raise IndexError(f"ranges lie from 0 to {len(self)}")
        out, own = np.zeros(stop - start, dtype=np.uint32), np.arange(stop - start)
        for n, level in enumerate(self.levels):
            out[own] |= level[start:stop].astype(np.uint32) << np.uint32(8 * n)
            if n == len(self.bitmaps) or start == stop:
                break
            first, last = start // 64, -(-stop // 64)
            words = self.bitmaps[n].reshape(-1)[first:last]
            more = np.unpackbits(words.view(np.uint8), bitorder="little")[start - 64 * first : stop - 64 * first].astype(bool)
            own = own[more]
            start = int(self._rank(n, np.array([start]))[0])
            stop = start + len(own)
        return out
