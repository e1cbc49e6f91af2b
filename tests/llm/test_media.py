import hashlib
import random
import zlib

import numpy as np
import pytest

from boxweave.llm import avi, jpeg
from boxweave.llm.media import clips, media_digests, payload_of, shots, stored_media, text_media
from conftest_llm import odd_texts, prose


def slow_decode(frame):
    """DC values of a frame, one bit at a time."""
    f = jpeg.parse(frame)
    books = {}
    for kind, table in f.tables:
        lengths = [n for n in range(1, 17) for _ in range(table[n - 1])]
        books[kind] = {f"{c:0{n}b}": s for c, n, s in zip(jpeg.codes(lengths), lengths, table[16:])}
    parts, part, i = [], bytearray(), 0
    while i < len(f.data):
        if f.data[i] == 0xFF and f.data[i + 1] != 0:
            parts.append(bytes(part))
            part, i = bytearray(), i + 2
            continue
        part.append(f.data[i])
        i += 2 if f.data[i] == 0xFF else 1
    parts.append(bytes(part))
    out = []
    for n, own in enumerate(parts):
        bits, at, level = "".join(f"{b:08b}" for b in own), 0, {}

        def symbol(book):
            nonlocal at
            end = at + 1
            while bits[at:end] not in book:
                end += 1
            s, at = book[bits[at:end]], end
            size = s & 15
            raw, at = bits[at : at + size], at + size
            return s, 0 if not size else int(raw, 2) if raw[0] == "1" else int(raw, 2) - 2**size + 1

        for _ in range(min(f.interval, f.units - n * f.interval)):
            for part_no, dc, ac in f.plan:
                level[part_no] = level.get(part_no, 0) + symbol(books[dc])[1]
                if part_no == 0:
                    out.append(min(255, max(0, (level[0] * f.quantiser + 4) // 8 + 128)))
                k = 1
                while k < 64:
                    s, _ = symbol(books[ac])
                    k = 64 if s == 0 else k + (s >> 4) + 1
    return out


def test_frames_give_back_every_sample():
    rng = np.random.default_rng(0)
    for rows in (1, 3, 64):
        for samples in (rng.integers(0, 256, rows * 64), np.zeros(rows * 64), np.full(rows * 64, 255), np.tile([0, 255], rows * 32)):
            samples = samples.astype(np.uint8)
            frames = jpeg.encode(samples, [rows])
            assert jpeg.decode([jpeg.parse(frames[0])])[0].tolist() == samples.tolist() == slow_decode(frames[0])


def colour_frame(seed):
    """A frame of three components, 4:2:0, with AC coefficients and restarts, and its luma DC values."""
    rng = random.Random(seed)
    dc_code, ac_code = {0: "00", 3: "01", 6: "10"}, {0x00: "0", 0x01: "10", 0x23: "110", 0xF0: "1110"}
    body, want = b"", []
    units, interval = 6, 4
    bits = {0: 0, 3: 3, 6: 6}
    for begin in range(0, units, interval):
        text, level = "", [0, 0, 0]
        for _ in range(min(interval, units - begin)):
            for part in (0, 0, 0, 0, 1, 2):
                size = rng.choice([0, 3, 6])
                raw = f"{rng.getrandbits(bits[size]):0{size}b}" if size else ""
                text += dc_code[size] + raw
                level[part] += (int(raw, 2) if raw[0] == "1" else int(raw, 2) - 2**size + 1) if size else 0
                if part == 0:
                    want.append(min(255, max(0, (level[0] * 16 + 4) // 8 + 128)))
                for s in rng.choices([0x01, 0x23, 0xF0], k=rng.randrange(3)):
                    text += ac_code[s] + f"{rng.getrandbits(4):04b}"[: s & 15]
                text += ac_code[0]
        text += "1" * (-len(text) % 8)
        body += bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")
        if begin + interval < units:
            body += bytes([0xFF, 0xD0 + begin // interval % 8])
    segment, table = jpeg._segment, jpeg._table
    return (
        b"\xff\xd8" + segment(jpeg.DQT, bytes([0] + [16] * 64)) + segment(jpeg.SOF0, bytes([8, 0, 32, 0, 48, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        + table(0x00, {0: 2, 3: 2, 6: 2}) + table(0x10, {0x00: 1, 0x01: 2, 0x23: 3, 0xF0: 4}) + segment(jpeg.DRI, interval.to_bytes(2, "big"))
        + segment(jpeg.SOS, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + body + b"\xff\xd9"
    ), want


def test_colour_frames_with_detail():
    made = [colour_frame(s) for s in range(12)]
    for got, (frame, want) in zip(jpeg.decode([jpeg.parse(f) for f, _ in made]), made):
        assert got.tolist() == want == slow_decode(frame)


def test_containers_are_read_by_their_index_or_without():
    frames = [bytes([i]) * (i + 1) for i in range(5)]
    data = avi.write(frames, 8, 8, 20_000)
    assert avi.read(data) == (frames, 20_000)
    cut = data.index(b"idx1")
    assert avi.read(data[:cut])[0] == frames
    assert avi.read(avi.write([], 8, 8))[0] == []
    for broken in (b"", b"RIFF", b"RIFF\0\0\0\0WAVE", data[:40]):
        with pytest.raises(ValueError):
            avi.read(broken)


def test_shots_at_steps_but_not_in_drift():
    a, b = np.eye(4)[0], np.eye(4)[1]
    assert shots(np.array([a] * 5 + [b] * 5 + [a] * 3)) == [0, 5, 10]
    drift = np.array([a * (1 - t) + b * t for t in np.linspace(0, 1, 12)])
    assert shots(drift) == [0] and shots(drift[:1]) == [0]


def test_texts_come_back_from_their_media(odd, none):
    rows = media_digests(text_media(odd)).collect()
    want = []
    for i, t in odd_texts():
        p = payload_of(t)
        want.append((str(i), len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    assert media_digests(text_media(none)).count() == 0


def test_clips_of_a_media_column(spark):
    dark, bright = bytes([20]) * 4096, bytes([220]) * 4096
    file = stored_media([dark * 3 + bright * 2])[0]
    rows = [(1, file), (2, None), (3, b"junk"), (4, file[: len(file) // 2]), (5, avi.write([], 8, 8)), (6, avi.write([b"\xff\xd8junk"], 8, 8))]
    got = {}
    for r in clips(spark.createDataFrame(rows, "doc_id long, media binary")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [(r.clip, r.first_frame, r.frames, r.start_s, r.end_s, r.mean) for r in sorted(got[1], key=lambda r: r.clip)] == [(0, 0, 3, 0.0, 0.12, 20.0), (1, 3, 2, 0.12, 0.2, 220.0)]
    assert all(got[k][0].error and got[k][0].clip is None for k in (2, 3, 6)) and 5 not in got


def test_long_payloads_keep_their_order():
    payloads = [payload_of(prose(i, 3000)) for i in range(5)]
    for file, payload in zip(stored_media(payloads), payloads):
        assert b"".join(f.tobytes() for f in jpeg.decode([jpeg.parse(x) for x in avi.read(file)[0]])) == payload
