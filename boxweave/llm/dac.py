"""Directly addressable codes: lists of ids with random access to any of them.

Ids are split into chunks of ``CHUNK`` bits. Level 0 holds the lowest chunk of every id, level k
the k-th chunk of those ids that reach that far, in order. A bitmap beside each level but the last
says which ids continue, and a directory of counts before each block of the bitmap gives the rank
of a position, which is the place of the id's next chunk. So the i-th id takes one read per level,
and nothing around it is decoded.

Layout, all little-endian: ``magic``, number of levels (u32), number of ids (u64); per level the
number of chunks (u64), the chunks, and, unless it is the last level, the bitmap padded to whole
blocks and the directory (u64 per block).
"""

from __future__ import annotations

import numpy as np

CHUNK = 8
BLOCK = 512
MAGIC = b"DAC1"


def encode(ids: np.ndarray) -> bytes:
    """The coded form of unsigned 32-bit ids."""
    rest, levels = np.ascontiguousarray(ids, "<u4"), []
    while True:
        low, high = (rest & (2**CHUNK - 1)).astype(np.uint8), rest >> CHUNK
        on = high > 0
        out = [len(rest).to_bytes(8, "little"), low.tobytes()]
        levels.append(out)
        if not on.any():
            break
        blocks = -(-len(rest) // BLOCK)
        bits = np.zeros(blocks * BLOCK, bool)
        bits[: len(rest)] = on
        before = np.cumsum(bits.reshape(blocks, BLOCK).sum(axis=1)) - bits.reshape(blocks, BLOCK).sum(axis=1)
        out += [np.packbits(bits, bitorder="little").tobytes(), before.astype("<u8").tobytes()]
        rest = high[on]
    head = MAGIC + len(levels).to_bytes(4, "little") + len(ids).to_bytes(8, "little")
    return head + b"".join(b for level in levels for b in level)


class Codes:
    """Reader of one coded list; views the bytes, copies nothing."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a list of directly addressable codes")
        n_levels, self.n = int.from_bytes(data[4:8], "little"), int.from_bytes(data[8:16], "little")
        self.levels, at = [], 16
        for k in range(n_levels):
            n = int.from_bytes(data[at : at + 8], "little")
            at += 8
            chunks, at = np.frombuffer(data, np.uint8, n, at), at + n
            bits = ranks = None
            if k < n_levels - 1:
                blocks = -(-n // BLOCK)
                bits, at = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at), at + blocks * BLOCK // 8
                ranks, at = np.frombuffer(data, "<u8", blocks, at), at + 8 * blocks
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The i-th id, by one chunk and one rank per level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK * k)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block, first = i // BLOCK, i // BLOCK * BLOCK // 8
            upto = np.bitwise_count(bits[first : i >> 3]).sum(dtype=np.int64) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i = int(ranks[block]) + int(upto)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` as unsigned 32-bit integers; only their chunks are read."""
        out, where, at = np.zeros(stop - start, "<u4"), None, (start, stop)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            part = chunks[at[0] : at[1]].astype("<u4") << np.uint32(CHUNK * k)
            if where is None:
                out |= part
                where = np.arange(stop - start)
            else:
                out[where] |= part
            if bits is None:
                break
            on = np.unpackbits(bits[at[0] >> 3 : (at[1] + 7) >> 3], bitorder="little")[at[0] & 7 :][: at[1] - at[0]].astype(bool)
            where = where[on]
            if not len(where):
                break
            first = self._rank(k, at[0])
            at = (first, first + len(where))
        return out

    def _rank(self, level: int, i: int) -> int:
        """Continuing ids before position ``i`` of a level."""
        _, bits, ranks = self.levels[level]
        if i // BLOCK >= len(ranks):
            return len(self.levels[level + 1][0])
        first = i // BLOCK * BLOCK // 8
        upto = int(np.bitwise_count(bits[first : i >> 3]).sum(dtype=np.int64))
        return int(ranks[i // BLOCK]) + upto + (int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)
