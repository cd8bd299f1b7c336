"""Media columns: Ogg.

A payload is stored as an Ogg physical stream of two multiplexed logical streams, one for either half of its frames
(even and odd frames of 192 samples of 8 bits), with a header packet each, packets of several frames that may span pages, and
granule positions that count samples. read() works on any Ogg bytes: it finds pages, verifies their checksums,
reassembles packets from the lacing values, keeps the logical streams apart and derives timestamps from granule positions.

Nulls: a null text is the empty payload. A damaged page (bad checksum, cut off, wrong version) is counted and skipped, and
the packets that it touched are dropped; nothing raises. Equal payloads give equal bytes: serial numbers come from the payload.
Repeated rows give repeated rows, in any order of ties. Very long texts are stored whole, one text at a time. Empty table: empty result. Other
columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, pieces, table, texts

FRAME, RATE = 192, 48_000  # samples (bytes) in a frame; samples a second
PACKET = 20  # frames in a packet
PAGE = 255  # lacing values in a page at most, fixed by the format
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = b"SAMPLES8"


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 0x04C11DB7, most significant bit first, no inversions), by zlib's over bits in reverse."""
    r = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{r:032b}"[::-1], 2)


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, kind, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, int, bytes]]:
    """Pages of one logical stream, as (granule, page number, bytes): the header alone on the first, the others as they fill."""
    out, number = [], 0
    head, granule = packets[0]
    out.append((0, 0, _page(2 | (4 if len(packets) == 1 else 0), granule, serial, 0, bytes([len(head)]), head)))
    lacing, body, ends, opened = bytearray(), bytearray(), -1, False
    rest = packets[1:]

    def flush(last: bool) -> None:
        nonlocal number, lacing, body, ends, opened
        number += 1
        cut = bool(lacing) and lacing[-1] == 255
        out.append((max(ends, 0), number, _page((1 if opened else 0) | (4 if last else 0), ends, serial, number, bytes(lacing), bytes(body))))
        lacing, body, ends, opened = bytearray(), bytearray(), -1, cut

    for k, (data, granule) in enumerate(rest):
        at = 0
        while True:
            part = data[at : at + 255]
            lacing.append(len(part))
            body += part
            at += 255
            done = len(part) < 255
            if done:
                ends = granule
            last = done and k == len(rest) - 1
            if len(lacing) == PAGE or last:
                flush(last)
            if done:
                break
    return out


def write(payload: bytes) -> bytes:
    """payload: a positive multiple of FRAME bytes."""
    frames = len(payload) // FRAME
    base = zlib.crc32(payload)
    samples = np.frombuffer(payload, np.uint8).reshape(frames, FRAME)
    pages = []
    for stream in (0, 1):
        own = samples[stream::2].tobytes()
        packets = [(_HEAD + struct.pack("<IHBB", RATE, FRAME, 8, stream), 0)]
        step = PACKET * FRAME
        for at in range(0, len(own), step):
            last = min(at + step, len(own)) // FRAME  # own frames so far; the sample at which the last of them ends in the whole
            packets.append((own[at : at + step], ((last - 1) * 2 + stream + 1) * FRAME))
        for granule, number, page in _pages((base + stream) & 0xFFFFFFFF, packets):
            pages.append((number > 0, granule, stream, number, page))
    return b"".join(p[-1] for p in sorted(pages, key=lambda p: p[:4]))


def read(data: bytes) -> dict:
    """Logical streams by serial number: packets with the sample count at their page's end, plus what was found wrong."""
    streams: dict[int, dict] = {}
    at, pages, bad = 0, 0, 0
    while (at := data.find(b"OggS", at)) >= 0:
        if len(data) - at < 27 or data[at + 4] != 0 or len(data) - at < 27 + data[at + 26]:
            bad, at = bad + 1, at + 4
            continue
        _, _, kind, granule, serial, number, crc = struct.unpack_from("<4sBBqIII", data, at)
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        begin = at + 27 + n
        end = begin + sum(lacing)
        if end > len(data) or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            bad, at = bad + 1, at + 4
            continue
        pages += 1
        s = streams.setdefault(serial, {"packets": [], "granules": [], "open": None, "next": number, "gaps": 0, "ended": False})
        if number != s["next"]:
            s["gaps"], s["open"] = s["gaps"] + 1, None
        elif not kind & 1 and s["open"] is not None:
            s["open"] = None
        skip = bool(kind & 1) and s["open"] is None
        s["next"], s["ended"] = number + 1, s["ended"] or bool(kind & 4)
        part, pos = s["open"] or [], begin
        for x in lacing:
            part.append(data[pos : pos + x])
            pos += x
            if x < 255:
                if not skip:
                    s["packets"].append(b"".join(part))
                    s["granules"].append(granule)
                part, skip = [], False
        s["open"] = part if lacing and lacing[-1] == 255 and not skip else None
        at = end
    return {"streams": streams, "pages": pages, "bad": bad}


def times(stream: dict) -> list[float]:
    """Seconds at which each packet of samples ends: the last one of a page at the page's granule position, those before it earlier by what
    follows them (a stream has every other frame, so its bytes count twice)."""
    out: list[float] = []
    at = 0
    for k in range(len(stream["packets"]) - 1, 0, -1):
        same = k + 1 < len(stream["packets"]) and stream["granules"][k] == stream["granules"][k + 1]
        at = at - 2 * len(stream["packets"][k + 1]) if same else stream["granules"][k]
        out.append(at / RATE)
    return out[::-1]


def payload(found: dict) -> bytes:
    """The samples, put together again from both logical streams; empty if either is not whole."""
    halves = {}
    for s in found["streams"].values():
        if s["packets"] and s["packets"][0][:8] == _HEAD and s["ended"] and not s["gaps"]:
            halves[s["packets"][0][15]] = b"".join(s["packets"][1:])
    if set(halves) != {0, 1}:
        return b""
    a, b = (np.frombuffer(halves[i], np.uint8).reshape(-1, FRAME) for i in (0, 1))
    whole = np.empty((len(a) + len(b), FRAME), np.uint8)
    whole[0::2], whole[1::2] = a, b
    return whole.tobytes()


def feature(found: dict, samples: bytes) -> str:
    """Pages, packets of either stream, the ends of the first and last packet by granule positions, mean and deviation of the samples, and how many fall in each of 16 bands of values."""
    counts = "/".join(str(len(s["packets"])) for s in found["streams"].values())
    stamps = [t for s in found["streams"].values() for t in times(s)]
    seconds, first = max(stamps, default=0.0), min(stamps, default=0.0)
    x = np.frombuffer(samples, np.uint8)
    if not len(x):
        return f"pages={found['pages']};packets={counts};seconds={seconds:.6f}"
    counts256 = np.bincount(x, minlength=256).astype(np.int64)
    values = np.arange(256)
    mean = float((counts256 * values).sum()) / len(x)
    deviation = float((counts256 * (values - mean) ** 2).sum() / len(x)) ** 0.5
    bands = ",".join(str(int(v)) for v in counts256.reshape(16, 16).sum(axis=1))
    return f"pages={found['pages']};bad={found['bad']};packets={counts};first={first:.6f};seconds={seconds:.6f};mean={mean:.4f};sd={deviation:.4f};bands={bands}"


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """A row for each row of docs: sizes, digests and features of its text as an Ogg stream, read back from the stored bytes."""

    def one(c):
        rows = []
        for _, part in pieces(c["text"]):
            for text in part:
                raw = text.encode("utf-8", "surrogatepass")
                media = write(raw + b" " * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)))
                found = read(media)
                back = payload(found)
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(found, back))
                rows.append((*row, media) if keep_media else row)
        return {"doc_id": c["doc_id"]} | {k: [r[i] for r in rows] for i, k in enumerate(names)}

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * keep_media
    return map_batches(texts(docs), one, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media)


def op6_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
