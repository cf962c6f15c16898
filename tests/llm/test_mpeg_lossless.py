"""Payloads that look like what a reader looks for, and checksums, against a small reader of its own."""

import random

import pytest

from strongroom.llm import mpeg as M

LOOKALIKES = [b"TAG", b"ID3\x04\x00\x00\x00\x00\x0f\x7f", b"Xing\x00\x00\x00\x0f", b"Info\x00\x00\x00\x07", b"VBRI\x00\x01", b"\xff\xfa\xc4\xc0", b"\xff\xfb\x90\x00", b"\xff\xfd\x80\x04"]


def plain_payload(data):
    """The stored bytes, by counting only: a tag, a frame for the table, then frames of 672 bytes."""
    at = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]) + 672
    assert (len(data) - at) % 672 == 0
    return b"".join(data[k + 23 : k + 599] for k in range(at, len(data), 672))


def same(content):
    data = M.pack(content)
    s = M.read(data)
    assert M.payload(data, s) == M.padded(content) == plain_payload(data), content
    assert M.unpack(data) == content and s.skipped == 0 and s.crc_failed == 0 and s.frames == len(M.padded(content)) // 576


@pytest.mark.parametrize("mark", LOOKALIKES)
def test_lookalikes_at_every_offset(mark):
    for at in range(576):
        same((b"x" * at + mark).ljust(576, b"y"))
        same(b"u" * 1152 + b"x" * at + mark)


def test_random_bytes_of_every_length():
    r = random.Random(5)
    for n in range(3 * 576 + 1):
        same(r.randbytes(n))
    for _ in range(300):
        same(b"".join(r.choice([*LOOKALIKES, b"\xff", b"\0", r.randbytes(9)]) for _ in range(r.randint(0, 300))))


def bits_crc(bits):
    crc = 0xFFFF
    for b in bits:
        top = crc >> 15
        crc = crc << 1 & 0xFFFF
        if top != b:
            crc ^= 0x8005
    return crc


def to_bits(data):
    return [b >> k & 1 for b in data for k in range(7, -1, -1)]


#: Subbands and their widths of allocation by hand: kbit/s of both channels, Hz, MPEG-1?
LAYER_2 = [
    (192, 48000, True, [4] * 11 + [3] * 12 + [2] * 4), (384, 44100, True, [4] * 11 + [3] * 12 + [2] * 7), (160, 32000, True, [4] * 11 + [3] * 12 + [2] * 4),
    (64, 44100, True, [4] * 2 + [3] * 6), (96, 32000, True, [4] * 2 + [3] * 10), (64, 22050, False, [4] * 4 + [3] * 7 + [2] * 19),
]


def frame_of(layer, kbits, rate, one, mode, extension):
    version, layers = (3 if one else 2), {1: 3, 2: 2, 3: 1}
    index = M.BITRATES[one, layer].index(kbits)
    return bytes((0xFF, 0xE0 | version << 3 | layers[layer] << 1, index << 4 | M.RATES.index(rate if one else rate * 2) << 2, mode << 6 | extension << 4))


@pytest.mark.parametrize("mode", [0, 1, 2])
@pytest.mark.parametrize("kbits,rate,one,widths", LAYER_2)
def test_layer_2_checksums(kbits, rate, one, widths, mode):
    r = random.Random(kbits + mode)
    for extension in range(4):
        head = frame_of(2, kbits, rate, one, mode, extension)
        h = M.header(head)
        body = bytearray(r.randbytes(h.length - 6))
        bits, at, scales = to_bits(body), 0, 0
        for band, width in enumerate(widths):
            both = mode != 1 or band < 4 * extension + 4
            for _ in range(2 if both else 1):
                if any(bits[at : at + width]):
                    scales += 1 if both else 2
                at += width
        want = bits_crc(to_bits(head[2:]) + bits[: at + 2 * scales])
        frame = head + want.to_bytes(2, "big") + bytes(body)
        s = M.read(frame * 3)
        assert (s.frames, s.crc_checked, s.crc_failed) == (3, 3, 0)
        assert M.read(head + (want ^ 1).to_bytes(2, "big") + bytes(body) + frame).crc_failed == 1


@pytest.mark.parametrize("mode,extension,allocations", [(0, 0, 64), (3, 0, 32), (1, 0, 36), (1, 2, 44), (2, 1, 64)])
def test_layer_1_checksums(mode, extension, allocations):
    head = frame_of(1, 192, 44100, True, mode, extension)
    body = random.Random(mode).randbytes(M.header(head).length - 6)
    want = bits_crc(to_bits(head[2:]) + to_bits(body)[: 4 * allocations])
    assert M.read((head + want.to_bytes(2, "big") + body) * 2).crc_failed == 0
    assert M.read((head + (want ^ 256).to_bytes(2, "big") + body) * 2).crc_failed == 2


def test_on_spark(spark):
    texts = ["x" * 521 + "TAG" + "y" * 52, "x" * 576 * 3 + "x" * 521 + "TAG" + "y" * 52, "Xing" * 144, "VBRI" * 200, "TAG" * 4000, "é" * 40_000]
    docs = spark.createDataFrame([(i, t, "m", "s") for i, t in enumerate(texts)], "doc_id long, text string, media string, stream string")
    for r in M.stored_and_read(docs).collect():
        assert r.payload_bytes == -(-len(texts[r.doc_id].encode()) // 576) * 576
