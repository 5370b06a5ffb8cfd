"""Media columns: AVI with motion JPEG, written and read without loss.

A payload byte is one 8-bit grey sample: a flat 8x8 block whose DC coefficient
is the sample less 128 (all quantisers are 8).  The Huffman tables are chosen
so that a block always takes 16 bits: the DC code of category c has 9 - c bits
before its c value bits, the end-of-block code 7 bits.  The stream is ordinary
baseline JPEG (:func:`decode_baseline` reads it, or any other, bit by bit), but
frames with these tables also decode as whole arrays.

Frames have 64 samples a row and up to 16 rows, 25 a second.  Reading goes
RIFF chunks -> ``idx1`` -> frames -> samples.  A shot ends where the histogram
difference of two frames exceeds the mean of the last differences by a multiple
of their deviation; shots become timed clip rows.

Edge cases.  Null text: empty.  Empty text: 64 bytes 0, one frame of one row.
Texts of any length are taken whole.  Each row stands alone, so repeated rows,
empty tables and extra columns need no care.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNIT = 64
ROWS = 16
FPS = 25
BINS = 32
#: Differences that the adaptive threshold looks back on, deviations above their mean, and the least difference.
LOOK_BACK, DEVIATIONS, LEAST = 8, 2.5, 0.15

_ZIGZAG_EIGHTS = bytes([8] * 64)
_DC_COUNTS, _DC_SYMBOLS = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
_AC_COUNTS, _AC_SYMBOLS = bytes([0] * 6 + [1] + [0] * 9), b"\x00"
_TABLES = b"".join(b"\xff\xc4" + struct.pack(">HB", 19 + len(s), kind) + c + s for kind, c, s in ((0x00, _DC_COUNTS, _DC_SYMBOLS), (0x10, _AC_COUNTS, _AC_SYMBOLS)))


def _words() -> tuple[np.ndarray, np.ndarray]:
    """16-bit word of each difference -255..255, and difference of each 9-bit prefix (4096: none)."""
    to, back = np.zeros(511, ">u2"), np.full(512, 4096, np.int32)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        prefix = (1 << (9 - c)) - 2
        bits = (prefix << c) | (d if d >= 0 else d + (1 << c) - 1)
        to[d + 255] = bits << 7
        back[bits] = d
    return to, back


_TO, _BACK = _words()


def _jpeg(rows: int, scan: bytes) -> bytes:
    size = struct.pack(">HBHHB3B", 11, 8, rows * 8, UNIT * 8, 1, 1, 0x11, 0)
    return b"\xff\xd8\xff\xdb\x00\x43\x00" + _ZIGZAG_EIGHTS + b"\xff\xc0" + size + _TABLES + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + scan + b"\xff\xd9"


def pad(data: bytes) -> bytes:
    """Zeros up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\x00" * (len(data) & 1)


def encode_avi(payload: bytes) -> bytes:
    """The payload (a positive multiple of 64 bytes) as an AVI file."""
    rows = min(ROWS, len(payload) // UNIT)
    per = rows * UNIT
    count = -(-len(payload) // per)
    samples = np.frombuffer(payload.ljust(count * per, b"\x00"), np.uint8).reshape(count, per).astype(np.int16)
    steps = np.empty_like(samples)
    steps[:, 0] = samples[:, 0] - 128
    np.subtract(samples[:, 1:], samples[:, :-1], out=steps[:, 1:])
    words = _TO[steps + 255]
    frames = [_jpeg(rows, w.tobytes().replace(b"\xff", b"\xff\x00")) for w in words]
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c := _chunk(b"00dc", f))
        at += len(c)
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, count, 0, 1, largest, UNIT * 8, rows * 8, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, count, largest, 10_000, 0, 0, 0, UNIT * 8, rows * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, UNIT * 8, rows * 8, 1, 24, b"MJPG", UNIT * 8 * rows * 8 * 3, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload)))
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks, those in lists too, lists before what they hold."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        start, stop = at + 8, min(at + 8 + size, end)
        if name in (b"RIFF", b"LIST"):
            yield data[start : start + 4], start, stop
            if data[start : start + 4] != b"movi":
                yield from _walk(data, start + 4, stop)
        else:
            yield name, start, stop
        at = stop + (size & 1)


def _segments(jpeg: bytes) -> tuple[dict[int, list[bytes]], bytes]:
    """Marker segments up to the scan, and the entropy-coded bytes."""
    found: dict[int, list[bytes]] = {}
    at = 2
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        found.setdefault(marker, []).append(jpeg[at + 4 : at + 2 + size])
        at += 2 + size
        if marker == 0xDA:
            return found, jpeg[at : jpeg.rindex(b"\xff\xd9")]


def _huffman(segments: list[bytes]) -> dict[int, dict[tuple[int, int], int]]:
    tables: dict[int, dict[tuple[int, int], int]] = {}
    for s in segments:
        at = 0
        while at < len(s):
            kind, counts = s[at], s[at + 1 : at + 17]
            at, code, table = at + 17, 0, {}
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    table[length, code] = s[at]
                    code, at = code + 1, at + 1
                code <<= 1
            tables[kind] = table
    return tables


def decode_baseline(jpeg: bytes) -> np.ndarray:
    """Coefficients (blocks x 64, zigzag order, dequantised) of a grey baseline JPEG, bit by bit."""
    found, scan = _segments(jpeg)
    quant = np.frombuffer(found[0xDB][0][1:65], np.uint8).astype(np.int64)
    height, width = struct.unpack_from(">HH", found[0xC0][0], 1)
    tables = _huffman(found[0xC4])
    bits = np.unpackbits(np.frombuffer(scan.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
    at = 0

    def symbol(kind: int) -> int:
        nonlocal at
        code = length = 0
        while (length, code) not in tables[kind]:
            code, length, at = code << 1 | bits[at], length + 1, at + 1
        return tables[kind][length, code]

    def value(size: int) -> int:
        nonlocal at
        v = int("".join(map(str, bits[at : at + size])) or "0", 2)
        at += size
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    blocks = np.zeros((-(-height // 8) * -(-width // 8), 64), np.int64)
    dc = 0
    for block in blocks:
        dc += value(symbol(0x00))
        block[0], k = dc, 1
        while k < 64 and (s := symbol(0x10)):
            k += s >> 4
            block[k] = value(s & 15)
            k += 1
    return blocks * quant


def decode_frame(jpeg: bytes) -> np.ndarray:
    """Samples of one intra frame, a byte for each block."""
    if jpeg[: _SIZE_AT] == _HEAD[: _SIZE_AT] and jpeg[_SIZE_AT + 4 : len(_HEAD)] == _HEAD[_SIZE_AT + 4 :]:
        words = np.frombuffer(jpeg[len(_HEAD) : -2].replace(b"\xff\x00", b"\xff"), ">u2")
        steps = _BACK[words >> 7]
        if not (words & 127).any() and not (steps == 4096).any():
            return (np.cumsum(steps) + 128).astype(np.uint8)
    return (decode_baseline(jpeg)[:, 0] // 8 + 128).astype(np.uint8)


_HEAD = _jpeg(1, b"")[:-2]
#: Where height and width stand.
_SIZE_AT = _HEAD.index(b"\xff\xc0") + 5


def decode_avi(media: bytes) -> tuple[bytes, np.ndarray]:
    """Payload and frames (frames x samples), found by the index."""
    length, movi, index = None, 0, b""
    for name, start, end in _walk(media, 0, len(media)):
        if name == b"strd":
            length = struct.unpack_from("<Q", media, start)[0]
        elif name == b"movi":
            movi = start
        elif name == b"idx1":
            index = media[start:end]
    frames = [decode_frame(media[movi + at + 8 : movi + at + 8 + size]) for name, _, at, size in struct.iter_unpack("<4sIII", index) if name == b"00dc"]
    samples = np.stack(frames)
    return samples.tobytes()[:length], samples


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame of each shot."""
    n, per = frames.shape
    bins = np.bincount((np.arange(n)[:, None] * BINS + (frames >> 3)).ravel(), minlength=n * BINS).reshape(n, BINS)
    steps = np.abs(np.diff(bins, axis=0)).sum(1) / (2 * per)
    cuts = [0]
    for k in range(len(steps)):
        last = steps[max(cuts[-1], k - LOOK_BACK) : k]
        most = last.mean() + DEVIATIONS * last.std() if len(last) else 0.0
        if steps[k] > max(most, LEAST):
            cuts.append(k + 1)
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], n])]


def clip_list(frames: np.ndarray) -> list[dict]:
    """Timed clips: number, start and end in seconds, frames, mean sample."""
    return [{"clip": k, "start_s": a / FPS, "end_s": (b + 1) / FPS, "frames": b + 1 - a, "mean_sample": round(float(frames[a : b + 1].mean()), 3)} for k, (a, b) in enumerate(shots(frames))]


def feature(clips: list[dict]) -> str:
    return f"{sum(c['frames'] for c in clips)} frames;" + ",".join(f"{c['start_s']:g}-{c['end_s']:g}:{c['mean_sample']:g}" for c in clips)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text stored as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array([encode_avi(pad(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, clip, start_s, end_s, frames, mean_sample: the timed clips of stored AVI files."""
    slim = media.select(media[id_col].alias("doc_id"), media[media_col].alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"doc_id": i} | c for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if m for c in clip_list(decode_avi(m)[1])]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([pa.field("doc_id", b.schema.field(0).type), ("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("mean_sample", pa.float64())]))

    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, clip int, start_s double, end_s double, frames int, mean_sample double")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, reads the stored bytes back and describes both; one row per document."""

    def one(text: str | None) -> tuple:
        raw = (text or "").encode()
        media = encode_avi(pad(raw))
        payload, frames = decode_avi(media)
        return len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), sha256(media).hexdigest(), feature(clip_list(frames))

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*[one(t) for t in b.column(1).to_pylist()])) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, k) for v, k in zip(found, kinds)]], ["doc_id", *names])

    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
