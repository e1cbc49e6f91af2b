"""Baseline JPEG frames: entropy coding of many frames side by side.

Frames written here hold one grey sample per 8x8 block: a block is flat, its DC coefficient is the
sample less 128 at a quantiser of 8, so decoding gives each sample back exactly, and any
viewer shows the frame. A row of blocks is one restart interval. Frames read here may have any
baseline coefficients and any number of components; what comes back are the DC values of the first
component, the 8x8 means of the picture.

Restart intervals do not depend on each other, so numpy decodes those of many frames in step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDE = 64
#: Largest rows of blocks in a frame that is written.
HIGH = 64
# Markers of the format.
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, RST0 = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xD0
#: Code lengths of the DC categories 0 to 8 of written frames, and the only AC symbol, end of block.
DC_LENGTHS = (4, 4, 4, 3, 3, 3, 3, 3, 4)
QUANTISER = 8


def codes(lengths: list[int]) -> list[int]:
    """Canonical code of each symbol; symbols come in the order of their lengths."""
    out, code, last = [], 0, lengths[0] if lengths else 0
    for n in lengths:
        code <<= n - last
        out.append(code)
        code, last = code + 1, n
    return out


def _table(kind: int, symbols: dict[int, int]) -> bytes:
    """A Huffman table segment from symbol lengths."""
    order = sorted(symbols, key=lambda s: (symbols[s], s))
    counts = bytes(sum(symbols[s] == n for s in order) for n in range(1, 17))
    return _segment(DHT, bytes([kind]) + counts + bytes(order))


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _difference_bits() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference from -255 to 255, and the end of block after it: bits and which of them count."""
    order = sorted(range(9), key=lambda s: (DC_LENGTHS[s], s))
    code = dict(zip(order, codes([DC_LENGTHS[s] for s in order])))
    bits, used = np.zeros((511, 13), bool), np.zeros((511, 13), bool)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        extra = d if d > 0 else d + (1 << size) - 1
        text = f"{code[size]:0{DC_LENGTHS[size]}b}" + (f"{extra:0{size}b}" if size else "") + "0"
        bits[d + 255, : len(text)] = [c == "1" for c in text]
        used[d + 255, : len(text)] = True
    return bits, used


BITS, USED = _difference_bits()
HEAD = bytes([0xFF, SOI]) + _segment(DQT, bytes([0, *[QUANTISER] * 64]))
TAIL = _table(0x00, dict(enumerate(DC_LENGTHS))) + _table(0x10, {0: 1}) + _segment(DRI, WIDE.to_bytes(2, "big")) + _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0]))


def encode(samples: np.ndarray, heights: list[int]) -> list[bytes]:
    """Frames of ``WIDE`` blocks a row from rows of samples, ``heights`` rows each."""
    value = samples.reshape(-1, WIDE).astype(np.int16)
    step = np.diff(value, axis=1, prepend=np.int16(128)) + 255
    rows = len(value)
    bits, used = BITS[step].reshape(rows, -1), USED[step].reshape(rows, -1)
    size = used.sum(axis=1)
    fill = -size % 8
    bits = np.concatenate([bits, np.ones((rows, 7), bool)], axis=1)
    used = np.concatenate([used, np.arange(7) < fill[:, None]], axis=1)
    data = np.packbits(bits[used])
    ends = np.cumsum((size + fill) // 8)
    last = np.zeros(rows, bool)
    last[np.cumsum(heights) - 1] = True
    stuffed = data == 0xFF
    marked = np.zeros(len(data), np.int64)
    marked[ends[~last] - 1] = 2
    room = 1 + stuffed + marked
    place = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint8)
    out[place] = data
    at = place[ends - 1] + 1 + stuffed[ends - 1]
    number = np.arange(rows) - np.repeat(np.cumsum(heights) - heights, heights)
    out[at[~last]] = 0xFF
    out[at[~last] + 1] = RST0 + number[~last] % 8
    stops = at[last].tolist()
    raw = out.tobytes()
    frames = []
    for start, stop, high in zip([0, *stops], stops, heights):
        frame = bytes([8]) + (8 * high).to_bytes(2, "big") + (8 * WIDE).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
        frames.append(HEAD + _segment(SOF0, frame) + TAIL + raw[start:stop] + bytes([0xFF, EOI]))
    return frames


@dataclass
class Frame:
    """What the headers of a frame say, and its entropy-coded data."""

    width: int
    height: int
    quantiser: int
    plan: tuple[tuple[int, int, int], ...]  # per block of a unit: component, DC table, AC table
    tables: tuple[tuple[int, bytes], ...]
    interval: int
    units: int
    data: bytes


def parse(frame: bytes) -> Frame:
    """Headers of a baseline frame; raises ValueError for another process or missing tables."""
    if frame[:2] != bytes([0xFF, SOI]):
        raise ValueError("no JPEG frame")
    at, tables, quantisers, interval, parts = 2, {}, {}, 0, None
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        if frame[at] != 0xFF:
            raise ValueError("no marker where one is due")
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if marker == DQT:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quantisers[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                body = body[1 + 64 * wide :]
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = bytes(body[1 : 17 + n])
                body = body[17 + n :]
        elif marker == DRI:
            interval = int.from_bytes(body[:2], "big")
        elif marker == SOF0:
            high, wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
            raise ValueError("not the baseline process")
        elif marker == SOS:
            if parts is None:
                raise ValueError("no frame header")
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            plan = []
            for k, (name, across, down, _) in enumerate(parts):
                blocks = across * down if len(parts) > 1 else 1
                plan += [(k, chosen[name] >> 4, 0x10 | chosen[name] & 15)] * blocks
            if any(t not in tables for _, dc, ac in plan for t in (dc, ac)):
                raise ValueError("a Huffman table is missing")
            across, down = (max(p[1] for p in parts), max(p[2] for p in parts)) if len(parts) > 1 else (1, 1)
            units = -(-wide // (8 * across)) * -(-high // (8 * down))
            end = frame.rfind(bytes([0xFF, EOI]))
            return Frame(wide, high, quantisers[parts[0][3]], tuple(plan), tuple(sorted(tables.items())), interval or units, units, frame[at : end if end >= at else len(frame)])
    raise ValueError("no scan")


def _lookup(table: bytes) -> np.ndarray:
    """For the next 16 bits: ``length << 8 | symbol``; 0 where no code fits."""
    lengths = [n for n in range(1, 17) for _ in range(table[n - 1])]
    out = np.zeros(1 << 16, np.int64)
    for code, n, symbol in zip(codes(lengths), lengths, table[16:]):
        out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
    return out


def decode(frames: list[Frame]) -> list[np.ndarray]:
    """DC values of the first component of each frame, as samples from 0 to 255."""
    out: list[np.ndarray | None] = [None] * len(frames)
    kinds: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        kinds.setdefault((f.plan, f.tables), []).append(i)
    for own in kinds.values():
        for i, dc in zip(own, _decode_alike([frames[i] for i in own])):
            out[i] = np.clip((dc * frames[i].quantiser + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return out


def _decode_alike(frames: list[Frame]) -> list[np.ndarray]:
    """Of frames with the same tables; one lane for each restart interval."""
    plan, tables = frames[0].plan, {k: _lookup(t) for k, t in frames[0].tables}
    raw = np.frombuffer(b"".join(f.data + b"\xff\xd9" for f in frames), np.uint8)
    after = np.r_[raw[1:], 0]
    mark = (raw == 0xFF) & (after != 0)
    stuffing = np.r_[False, (raw[:-1] == 0xFF) & (raw[1:] == 0)]
    dropped = stuffing | mark | np.r_[False, mark[:-1]]
    kept = np.cumsum(~dropped)
    ends = kept[np.flatnonzero(mark)]
    data = np.concatenate([raw[~dropped], np.zeros(16, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(data) - 8, np.uint64)
    for k in range(8):
        word |= data[k : len(data) - 8 + k] << np.uint64(56 - 8 * k)
    blocks = np.concatenate([np.minimum(f.interval, f.units - np.arange(0, f.units, f.interval)) for f in frames]) * len(plan)
    lanes = [-(-f.units // f.interval) for f in frames]
    if len(ends) != len(blocks):
        raise ValueError("restart markers and intervals do not agree")
    at = np.r_[0, ends[:-1]].astype(np.int64) * 8
    limit = 8 * (len(word) - 1)
    parts = max(p[0] for p in plan) + 1
    level = np.zeros((parts, len(at)), np.int64)
    first = [k for k, p in enumerate(plan) if p[0] == 0]
    kept_dc = np.zeros((len(at), int(blocks.max()) // len(plan) * len(first)), np.int16)
    every, column = np.arange(len(at)), 0

    def symbol(lane: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next symbol of each lane and, where it has them, the value of the bits after it."""
        here = at[lane]
        view = word[here >> 3] << (here & 7).astype(np.uint64)
        found = table[(view >> np.uint64(48)).astype(np.int64)]
        if not found.all():
            raise ValueError("no code fits")
        size, length = found & 15, found >> 8 & 31
        bits = ((view << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(bits >> np.maximum(size - 1, 0) == 1, bits, bits - (1 << size) + 1)
        at[lane] = np.minimum(here + length + size, limit)
        return found & 255, np.where(size > 0, value, 0)

    for j in range(int(blocks.max())):
        part, dc, ac = plan[j % len(plan)]
        lane = every if blocks.min() > j else every[blocks > j]
        _, value = symbol(lane, tables[dc])
        level[part, lane] += value
        if part == 0:
            kept_dc[lane, column] = level[0, lane]
            column += 1
        place = np.ones(len(lane), np.int64)
        while len(lane):
            found, _ = symbol(lane, tables[ac])
            run = found >> 4
            place = place + np.where(found == 0, 64, run + 1)
            more = place < 64
            lane, place = lane[more], place[more]
    have = blocks // len(plan) * len(first)
    flat = kept_dc[np.arange(kept_dc.shape[1]) < have[:, None]]
    sizes = np.add.reduceat(have, np.r_[0, np.cumsum(lanes)[:-1]])
    return np.split(flat, np.cumsum(sizes)[:-1])
