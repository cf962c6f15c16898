import hashlib
import random
import struct
import zlib

import pytest

from strongroom.llm import mpeg as M

TEXTS = ["", "a", "é" * 288, "x" * 576, "y" * 577, "ÿû" * 3000, "TAG" + "z" * 125, "ID3\x04\x00\x00\x00\x00\x01\x00", "Xing" * 400]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text):
    content = text.encode()
    data = M.pack(content)
    s = M.read(data)
    assert M.unpack(data) == content and M.payload(data) == M.padded(content)
    assert len(M.padded(content)) % 576 == 0 and len(M.padded(content)) >= 576
    assert (s.frames, s.crc_checked, s.crc_failed, s.skipped) == (n := len(M.padded(content)) // 576, n, 0, 0)
    assert s.table == "Xing" and s.table_frames == n and s.table_bytes == (n + 1) * 672 and len(s.toc) == 100
    assert s.samples == 1152 * n and M.seconds(s) == pytest.approx(0.024 * n) and s.tags["TLEN"] == str(24 * n)
    assert all(data[o : o + 2] == b"\xff\xfa" for o in s.offsets)


def test_header_lengths():
    # 128 kbit/s at 44.1 kHz, the commonest frame: 417 bytes, 418 with padding
    assert M.header(bytes((0xFF, 0xFB, 0x90, 0x00))).length == 417 and M.header(bytes((0xFF, 0xFB, 0x92, 0x00))).length == 418
    assert M.header(bytes((0xFF, 0xF3, 0x80, 0xC0))).samples == 576 and M.header(bytes((0xFF, 0xF3, 0x80, 0xC0))).rate == 22050
    assert M.header(bytes((0xFF, 0xFF, 0x10, 0x00))).layer == 1
    for bad in (b"", b"\xff\xfb", bytes((0xFF, 0xFB, 0xF0, 0)), bytes((0xFF, 0xFB, 0x0C, 0)), bytes((0xFF, 0xEB, 0x90, 0)), bytes((0xFF, 0xF9, 0x90, 0)), bytes((0xFF, 0xFB, 0x90, 2))):
        assert M.header(bad) is None


def test_resynchronises_over_damage():
    data = M.pack(b"payload " * 1000)
    whole = M.read(data)
    cut = whole.offsets[5]
    junk = bytes(random.Random(1).randrange(256) for _ in range(333))
    s = M.read(data[:cut] + junk + data[cut:])
    assert s.frames == whole.frames and s.skipped == 333 and s.offsets == [o + 333 * (o >= cut) for o in whole.offsets]
    s = M.read(data[: cut + 100] + data[cut + 200 :])  # a frame that lost bytes takes the next one's head
    assert whole.frames - 2 <= s.frames <= whole.frames and s.frames + 1 >= whole.frames - 1


def test_checksum_finds_changes():
    data = bytearray(M.pack(b"q" * 2000))
    s = M.read(bytes(data))
    data[s.offsets[1] + 10] ^= 1
    assert M.read(bytes(data)).crc_failed == 1


def test_other_tables_and_tags():
    frame = bytes((0xFF, 0xFB, 0x90, 0x00)).ljust(417, b"\0")
    vbri = bytearray(frame)
    vbri[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 2000, 4, 2, 1, 2, 2)
    vbri[62:66] = struct.pack(">HH", 834, 834)
    tag = b"TAG" + b"Title".ljust(30, b"\0") + b"Who".ljust(30, b"\0") + bytes(65)
    s = M.read(bytes(vbri) + frame * 4 + tag.ljust(128, b"\0"))
    assert (s.table, s.table_frames, s.table_bytes, s.toc, s.frames) == ("VBRI", 4, 2000, [834, 834], 4)
    assert s.tags == {"title": "Title", "artist": "Who"} and s.samples == 4 * 1152
    v3 = b"ID3\x03\x00\x00\x00\x00\x00\x0fTIT2" + (5).to_bytes(4, "big") + b"\0\0" + b"\0song"
    assert M.read(v3 + frame).tags == {"TIT2": "song"}
    assert M.read(None).frames == M.read(b"\xff" * 5000).frames == M.read(b"text").frames == 0


def test_query_columns(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, "a"), (None, "b"), (70, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, media string")
    got = M.stored_and_read(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        content = dict(rows)[r.doc_id] or ""
        p = M.padded(content.encode())
        media = M.pack(content.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(content.encode()), len(p), hashlib.sha256(p).hexdigest())
        assert r.tail_crc32 == zlib.crc32(p[-32:]) and r.media_bytes == len(media) and r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert len(r.seek_offsets) == len(p) // 576 and f"frames={len(p) // 576} " in r.feature
    assert M.stored_and_read(docs.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [1, 3])
@pytest.mark.parametrize("length", [524, 560, 576])
def test_text_that_looks_like_a_tag_stays(blocks, length):
    content = (b"u" * 576 * (blocks - 1) + b"v" * 521 + b"TAG").ljust(576 * (blocks - 1) + length, b"w")
    data = M.pack(content)
    assert data[-128:-125] == b"TAG"
    s = M.read(data)
    assert M.unpack(data) == content and M.payload(data) == M.padded(content)
    assert (s.frames, s.skipped, s.samples) == (blocks, 0, 1152 * blocks) and "title" not in s.tags
    s = M.read(data + b"TAG" + b"Title".ljust(125, b"\0"))
    assert (s.frames, s.skipped, s.tags["title"]) == (blocks, 0, "Title")
