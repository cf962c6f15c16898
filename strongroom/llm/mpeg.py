"""MPEG audio as a column: read streams frame by frame, and store bytes in one without loss.

``read`` finds frames by their headers.  Where a header is not valid it searches on byte by byte for one that
another valid header follows (or the end), and counts what it skipped.  It parses ID3v2 and ID3v1 tags and Xing, Info
and VBRI tables, verifies the CRC-16 of frames that have one (over the side information of Layer III, the bit allocation of Layer I,
allocation and scale factor selection of Layer II), and keeps the exact duration as samples and sample rate, and each
frame's offset for seeking.  The last 128 bytes are an ID3v1 tag only where no frame in step with the others covers them.

``pack`` makes a stream of MPEG-1 Layer III frames, 48 kHz, one channel, 224 kbit/s: silent side information with
a checksum, then 576 payload bytes where a player finds ancillary data.  A tag holds the unpadded length and a Xing
table the seek points.  ``unpack`` gets the payload back from the frames that ``read`` finds.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongroom.llm._common import whole_text

# Fixed values of the format (ISO/IEC 11172-3 and 13818-3): kbit/s by index, for (MPEG-1?, layer).
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Hz by index for MPEG-1; MPEG-2 has half, MPEG-2.5 a quarter.
RATES = (44100, 48000, 32000)

#: Layer II's widths of a subband's allocation as (width, subbands) runs: tables B.2a to B.2d, and the one of MPEG-2.
ALLOCATION = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "2": ((4, 4), (3, 7), (2, 19))}

BLOCK = 576
PAD = 0xFF
_SIDE = 17
_FRAME = 672
_HEADER = bytes((0xFF, 0xFA, 0xC4, 0xC0))  # MPEG-1, Layer III, protected; 224 kbit/s, 48 kHz, unpadded; one channel
_TABLE_HEADER = bytes((0xFF, 0xFB, 0xC4, 0xC0))  # the same, unprotected


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    bitrate: int
    rate: int
    channels: int
    protected: bool
    length: int
    samples: int
    bound: int

    @property
    def side(self) -> int:
        """Bytes of side information of a Layer III frame."""
        return (32 if self.channels == 2 else 17) if self.version == 1 else (17 if self.channels == 2 else 9)


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """What four bytes say, if they are a frame header; free-format frames don't count."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {3: 1.0, 2: 2.0, 0: 2.5}.get(four[1] >> 3 & 3)
    layer = {3: 1, 2: 2, 1: 3}.get(four[1] >> 1 & 3)
    index, rate_index, padding = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version is None or layer is None or index in (0, 15) or rate_index == 3 or four[3] & 3 == 2:
        return None
    kbits = BITRATES[version == 1, layer][index]
    rate = RATES[rate_index] // {1.0: 1, 2.0: 2, 2.5: 4}[version]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    length = (12 * kbits * 1000 // rate + padding) * 4 if layer == 1 else samples // 8 * kbits * 1000 // rate + padding
    bound = 4 * (four[3] >> 4 & 3) + 4 if four[3] >> 6 == 1 else 32  # from here joint stereo has one allocation for both channels
    return Header(version, layer, kbits, rate, 1 if four[3] >> 6 == 3 else 2, not four[1] & 1, length, samples, bound)


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005, from 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _allocation(h: Header) -> tuple[tuple[int, int], ...]:
    each = h.bitrate // h.channels
    if h.version != 1:
        return ALLOCATION["2"]
    if each < 56:
        return ALLOCATION["d" if h.rate == 32000 else "c"]
    return ALLOCATION["a" if h.rate == 48000 or each <= 80 else "b"]


def checked_bits(frame: bytes, h: Header) -> int:
    """How many bits after the checksum it covers."""
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (h.bound * h.channels + 32 - h.bound)
    bits, at, chosen, band = int.from_bytes(frame[6:70].ljust(64, b"\0"), "big"), 0, 0, 0
    for width, bands in _allocation(h):
        for _ in range(bands):
            for _ in range(h.channels if band < h.bound else 1):
                if bits >> 512 - at - width & (1 << width) - 1:
                    chosen += 1 if band < h.bound else h.channels
                at += width
            band += 1
    return at + 2 * chosen


def checksum(frame: bytes, h: Header) -> int:
    """The CRC-16 that the frame should have: of the header's last two bytes and the bits that it covers."""
    n = checked_bits(frame, h)
    crc = crc16(frame[2:4] + frame[6 : 6 + n // 8])
    for k in range(n % 8):
        bit = frame[6 + n // 8] >> 7 - k & 1 if len(frame) > 6 + n // 8 else 0
        crc = (crc << 1 ^ 0x8005 if (crc >> 15) ^ bit else crc << 1) & 0xFFFF
    return crc


@dataclass
class Stream:
    """What a stream holds.  samples and seconds are of audio frames; the frame of a seek table has none."""

    frames: int = 0
    samples: int = 0
    rate: int = 0
    version: float = 0.0
    layer: int = 0
    channels: int = 0
    bitrate_low: int = 0
    bitrate_high: int = 0
    crc_checked: int = 0
    crc_failed: int = 0
    skipped: int = 0
    table: str = ""
    table_frames: int = -1
    table_bytes: int = -1
    toc: list[int] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)


def _text(data: bytes) -> str:
    if not data:
        return ""
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[0], "latin-1")
    return data[1:].decode(code, "replace").rstrip("\0")


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Text frames of the tag at the start; where it ends."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    end = min(len(data), 10 + _syncsafe(data[6:10]) + (10 if data[5] & 0x10 else 0))
    at, major = 10, data[3]
    if data[5] & 0x40 and at + 4 <= end:
        at += _syncsafe(data[at : at + 4]) if major == 4 else 4 + int.from_bytes(data[at : at + 4], "big")
    name, head = (3, 6) if major == 2 else (4, 10)
    while at + head <= end and data[at]:
        key = data[at : at + name].decode("latin-1")
        raw = data[at + name : at + name + (3 if major == 2 else 4)]
        size = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        body = data[at + head : min(end, at + head + size)]
        if key[0] == "T":
            value = _text(body)
            if key in ("TXXX", "TXX"):
                key, _, value = value.partition("\0")
            tags.setdefault(key, value)
        at += head + size
    return end


def _table(data: bytes, at: int, h: Header, s: Stream) -> bool:
    """Reads a Xing, Info or VBRI table in the frame; whether there is one."""
    frame = data[at : at + h.length]
    for place in {4 + h.side, 6 + h.side}:
        if (kind := frame[place : place + 4]) in (b"Xing", b"Info") and len(frame) >= place + 8:
            flags, p = int.from_bytes(frame[place + 4 : place + 8], "big"), place + 8
            if flags & 1:
                s.table_frames, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
            if flags & 2:
                s.table_bytes, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
            if flags & 4:
                s.toc = list(frame[p : p + 100])
            s.table = kind.decode()
            return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        s.table_bytes, s.table_frames, n, scale, width = struct.unpack(">IIHHH", frame[46:60])
        s.toc = [scale * int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") for k in range(n)]
        s.table = "VBRI"
        return True
    return False


def read(data: bytes | None) -> Stream:
    """All of a stream; null or empty bytes give a stream without frames."""
    data, s = data or b"", Stream()
    at = _id3v2(data, s.tags)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128  # an ID3v1 tag, unless a frame in step with the others ends just where the data does
    first = True
    synced = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        fits = h is not None and (at + h.length <= end or at + h.length == len(data) and (synced or not s.skipped))
        if fits and not synced and s.layer and (h.layer, h.version) != (s.layer, s.version):
            fits = False
        if fits and not synced and at + h.length + 4 <= end and header(data[at + h.length : at + h.length + 4]) is None:
            fits = False
        if not fits:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            s.skipped += nxt - at
            at, synced = nxt, False
            continue
        synced = True
        if first:
            first = False
            s.version, s.layer, s.rate, s.channels = h.version, h.layer, h.rate, h.channels
            if h.layer == 3 and _table(data, at, h, s):
                at += h.length
                continue
        if h.protected:
            s.crc_checked += 1
            s.crc_failed += checksum(data[at : at + h.length], h) != int.from_bytes(data[at + 4 : at + 6], "big")
        s.frames += 1
        s.samples += h.samples
        s.bitrate_low = min(s.bitrate_low or h.bitrate, h.bitrate)
        s.bitrate_high = max(s.bitrate_high, h.bitrate)
        s.offsets.append(at)
        s.lengths.append(h.length)
        at += h.length
    s.skipped += max(0, end - at)
    if at <= end < len(data):
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                s.tags.setdefault(key, value)
    return s


# --- bytes in a stream


def padded(content: bytes) -> bytes:
    """The content and bytes 255 up to a positive multiple of 576."""
    return content + bytes([PAD]) * (-len(content) % BLOCK or (0 if content else BLOCK))


def _tag(frames: list[tuple[bytes, str]]) -> bytes:
    body = b""
    for key, value in frames:
        text = b"\x03" + value.encode()
        body += key + bytes((len(text) >> 21 & 127, len(text) >> 14 & 127, len(text) >> 7 & 127, len(text) & 127)) + b"\0\0" + text
    n = len(body)
    return b"ID3\x04\x00\x00" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + body


def pack(content: bytes) -> bytes:
    """The content as a stream."""
    blocks = np.frombuffer(padded(content), np.uint8).reshape(-1, BLOCK)
    n = len(blocks)
    head = _HEADER + crc16(_HEADER[2:] + bytes(_SIDE)).to_bytes(2, "big") + bytes(_SIDE)
    frames = np.zeros((n, _FRAME), np.uint8)
    frames[:, : len(head)] = np.frombuffer(head, np.uint8)
    frames[:, len(head) : len(head) + BLOCK] = blocks
    total = (n + 1) * _FRAME
    toc = bytes(min(255, (1 + k * n // 100) * _FRAME * 256 // total) for k in range(100))
    table = _TABLE_HEADER + bytes(_SIDE) + b"Xing" + struct.pack(">III", 7, n, total) + toc
    tag = _tag([(b"TLEN", str(n * 24)), (b"TXXX", f"bytes\0{len(content)}")])
    return tag + table.ljust(_FRAME, b"\0") + frames.tobytes()


def payload(data: bytes, s: Stream | None = None) -> bytes:
    """The padded content, from the frames that ``read`` finds."""
    s = s or read(data)
    skip = 6 + _SIDE
    return b"".join(data[o + skip : o + skip + BLOCK] for o in s.offsets)


def unpack(data: bytes) -> bytes:
    s = read(data)
    return payload(data, s)[: int(s.tags["bytes"])]


def seconds(s: Stream) -> float:
    return s.samples / s.rate if s.rate else 0.0


def feature(s: Stream) -> str:
    """A stream's figures in words; seek is the CRC-32 of all offsets as 64-bit little-endian numbers."""
    seek = zlib.crc32(np.array(s.offsets, "<i8").tobytes())
    return f"mpeg{s.version:g} layer{s.layer} rate={s.rate} channels={s.channels} kbps={s.bitrate_low}-{s.bitrate_high} frames={s.frames} samples={s.samples} crc={s.crc_checked - s.crc_failed}/{s.crc_checked} skipped={s.skipped} table={s.table}:{s.table_frames}:{s.table_bytes} seek={seek:08x}"


_STREAM = T.StructType(
    [
        T.StructField("frames", T.LongType()), T.StructField("samples", T.LongType()), T.StructField("rate", T.IntegerType()), T.StructField("seconds", T.DoubleType()),
        T.StructField("crc_checked", T.LongType()), T.StructField("crc_failed", T.LongType()), T.StructField("skipped", T.LongType()), T.StructField("table", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())), T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("feature", T.StringType()), T.StructField("payload", T.BinaryType()),
    ]
)


@F.pandas_udf(T.BinaryType())
def pack_column(texts: pd.Series) -> pd.Series:
    return pd.Series([pack(t.encode("utf-8", "surrogatepass")) for t in texts], index=texts.index, dtype=object)


@F.pandas_udf(_STREAM)
def read_column(media: pd.Series) -> pd.DataFrame:
    rows = []
    for data in media:
        data = bytes(data or b"")
        s = read(data)
        own = payload(data, s) if "bytes" in s.tags else None
        rows.append((s.frames, s.samples, s.rate, seconds(s), s.crc_checked, s.crc_failed, s.skipped, s.table, s.tags, np.array(s.offsets, np.int64), feature(s), own))
    return pd.DataFrame(rows, columns=_STREAM.names)


def describe(media: DataFrame, column: str = "media") -> DataFrame:
    """media with a struct ``stream``: frames, exact duration (samples, rate), checksums, tags, table and frame offsets.

    Null or empty bytes and bytes without any frame give zero frames.  Each row stands alone, so repeated rows agree.
    """
    return media.withColumn("stream", read_column(F.col(column)))


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` of docs(doc_id, text); a null text counts as empty."""
    rows = docs.select("doc_id", whole_text("text").alias("text"))
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), pack_column("text").alias("media"))


def stored_and_read(docs: DataFrame) -> DataFrame:
    """What comes back of each text: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``, then durations and seek offsets.

    A null or empty text is one block of padding; texts of any length and content come back whole.  Repeated rows have equal results,
    an empty table gives an empty one, and columns of docs other than doc_id and text are ignored, whatever their names.
    """
    found = describe(store(docs))
    p = F.col("stream.payload")
    return found.select(
        "doc_id", "n_bytes", F.octet_length(p).cast("long").alias("payload_bytes"), F.sha2(p, 256).alias("payload_sha256"),
        F.crc32(F.substring(p, -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "stream.feature",
        F.col("stream.samples").alias("samples"), F.col("stream.seconds").alias("seconds"), F.col("stream.offsets").alias("seek_offsets"),
    )
