"""Media columns: AVI motion JPEG in a binary column, cut into timed clips at shot changes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxweave.llm import avi, jpeg
from boxweave.llm.common import map_batches, picked

UNIT = 64
#: Bytes of payload coded, or frames decoded, at a time.
BLOCK, FRAMES = 1 << 20, 256
BINS, MEMORY, FACTOR, FLOOR = 32, 8, 3.0, 0.1


def payload_of(text: str | None) -> bytes:
    """A text as UTF-8 with zeros up to a positive multiple of ``UNIT``."""
    data = (text or "").encode("utf-8")
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\0")


def stored_media(payloads: list[bytes]) -> list[bytes]:
    """An AVI file of each payload: a byte is a sample, a frame up to ``HIGH`` rows of ``WIDE`` samples."""
    heights = [[min(jpeg.HIGH, n - r) for r in range(0, n, jpeg.HIGH)] for n in (len(p) // jpeg.WIDE for p in payloads)]
    rows, frames, held, size = [h for own in heights for h in own], [], [], 0
    data, at = np.frombuffer(b"".join(payloads), np.uint8), 0
    for h in rows:
        held.append(h)
        size += h * jpeg.WIDE
        if size >= BLOCK:
            frames += jpeg.encode(data[at : at + size], held)
            at, held, size = at + size, [], 0
    if held:
        frames += jpeg.encode(data[at : at + size], held)
    out, at = [], 0
    for own in heights:
        out.append(avi.write(frames[at : at + len(own)], 8 * jpeg.WIDE, 8 * max(own)))
        at += len(own)
    return out


def shots(histograms: np.ndarray, memory: int = MEMORY, factor: float = FACTOR, floor: float = FLOOR) -> list[int]:
    """First frames of the shots.

    A shot begins where the difference to the frame before (half the sum of absolute differences
    of the shares) is over ``floor`` and over the mean of the last ``memory`` differences within the
    shot by ``factor`` times their deviation; the memory is emptied at each shot.
    """
    begins, recent = [0], []
    for t in range(1, len(histograms)):
        d = float(np.abs(histograms[t] - histograms[t - 1]).sum() / 2)
        bar = max(floor, np.mean(recent) + factor * np.std(recent)) if recent else 2 * floor
        if d > bar:
            begins.append(t)
            recent = []
        else:
            recent = [*recent, d][-memory:]
    return begins


def histogram(samples: np.ndarray) -> np.ndarray:
    return np.bincount(samples >> 3, minlength=BINS) / max(1, len(samples))


def decoded(media: bytes | None) -> tuple[list[np.ndarray], int]:
    """Samples of every frame of an AVI file and microseconds per frame; ValueError when it can't be read."""
    frames, frame_us = avi.read(media or b"")
    out = []
    for at in range(0, len(frames), FRAMES):
        out += jpeg.decode([jpeg.parse(f) for f in frames[at : at + FRAMES]])
    return out, frame_us


def clips(media: DataFrame, id: str = "doc_id", column: str = "media") -> DataFrame:
    """Timed clips: ``(doc_id, clip, first_frame, frames, start_s, end_s, mean, error)``.

    One row for each shot of each file, ``mean`` being the mean sample. A null or broken file has one row
    without clip whose ``error`` says why; a file without frames has none. Repeated rows are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i, value in enumerate(batch.column(1)):
                try:
                    frames, us = decoded(value.as_py())
                except (ValueError, IndexError, KeyError) as problem:
                    row.append(i)
                    out.append((None, None, None, None, None, None, str(problem) or "broken"))
                    continue
                begins = shots(np.array([histogram(f) for f in frames])) if frames else []
                for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(frames)])):
                    row.append(i)
                    out.append((k, a, b - a, a * us / 1e6, b * us / 1e6, float(np.concatenate(frames[a:b]).mean()), None))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.string()])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns], ["doc_id", "clip", "first_frame", "frames", "start_s", "end_s", "mean", "error"])

    rows = picked(media, id=id, media=column)
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, clip long, first_frame long, frames long, start_s double, end_s double, mean double, error string")


def text_media(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: every whole text as an AVI file. Null and empty texts are one row of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                payloads, sizes, begin, held = [], [], at, 0
                while at < batch.num_rows and held < BLOCK:
                    value = batch.column(1)[at].as_py()
                    payloads.append(payload_of(value))
                    sizes.append(len((value or "").encode("utf-8")))
                    at, held = at + 1, held + len(payloads[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, at - begin), pa.array(sizes, pa.int64()), pa.array(stored_media(payloads), pa.binary())], ["id", "n_bytes", "media"])

    rows = picked(docs, id=id, text=text)
    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", "doc_id")


def media_digests(media: DataFrame) -> DataFrame:
    """What the stored files of ``text_media`` hold: payload read back, digests, and the shots as ``feature``.

    ``feature`` lists the frames, then each clip as ``first-last:mean``. Frames of many files are decoded
    together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [v.as_py() for v in batch.column(2)]
            at = 0
            while at < len(files):
                parsed, owner, begin = [], [], at
                while at < len(files) and len(parsed) < FRAMES:
                    own = [jpeg.parse(f) for f in avi.read(files[at])[0]]
                    parsed += own
                    owner.append(len(own))
                    at += 1
                frames = [f for k in range(0, len(parsed), FRAMES) for f in jpeg.decode(parsed[k : k + FRAMES])]
                out, k = [], 0
                for media_bytes, n in zip(files[begin:at], owner):
                    own, k = frames[k : k + n], k + n
                    payload = np.concatenate(own).tobytes()
                    begins = shots(np.array([histogram(f) for f in own]))
                    parts = [f"{a}-{b - 1}:{np.concatenate(own[a:b]).mean():.3f}" for a, b in zip(begins, [*begins[1:], n])]
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media_bytes), hashlib.sha256(media_bytes).hexdigest(), f"{n} frames;" + ";".join(parts)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(begin, at - begin) for c in (0, 1)), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_batches(media.select("doc_id", "n_bytes", "media"), run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
