"""AVI containers of motion JPEG: written, and read through their index."""

from __future__ import annotations

import struct

# Names of the format's chunks and the flags that mark a key frame and an index.
VIDEO, KEY_FRAME, HAS_INDEX = b"00dc", 0x10, 0x10


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def write(frames: list[bytes], width: int, height: int, frame_us: int = 40_000) -> bytes:
    """One video stream of JPEG frames with an index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", frame_us, 0, 0, HAS_INDEX, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, frame_us, 1_000_000, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width & 0xFFFF, height & 0xFFFF)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", largest, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    body, index, at = [], [], 4
    for f in frames:
        body.append(_chunk(VIDEO, f))
        index.append(struct.pack("<4sIII", VIDEO, KEY_FRAME, at, len(f)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + head + _list(b"movi", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


def read(data: bytes) -> tuple[list[bytes], int]:
    """Frames of the first video stream, in the order of the index, and microseconds per frame.

    Offsets of an index count from the list of frames or from the start of the file; without an index
    the list itself is walked. Raises ValueError for anything but an AVI file.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    frame_us, movi, index = 40_000, None, None
    for name, at, size in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[at : at + 4] == b"hdrl":
            for inner, start, _ in _chunks(data, at + 4, at + size):
                if inner == b"avih":
                    frame_us = int.from_bytes(data[start : start + 4], "little") or frame_us
        elif name == b"LIST" and data[at : at + 4] == b"movi":
            movi = (at, size)
        elif name == b"idx1":
            index = (at, size)
    if movi is None:
        raise ValueError("no frames")
    video = lambda name: name[2:] in (b"dc", b"db")
    if index is None:
        return [data[at : at + size] for name, at, size in _chunks(data, movi[0] + 4, movi[0] + movi[1]) if video(name)], frame_us
    entries = [struct.unpack_from("<4sIII", data, index[0] + 16 * i) for i in range(index[1] // 16)]
    entries = [e for e in entries if video(e[0])]
    base = movi[0] if not entries or data[movi[0] + entries[0][2] : movi[0] + entries[0][2] + 4] == entries[0][0] else 0
    return [data[base + at + 8 : base + at + 8 + size] for _, _, at, size in entries], frame_us
