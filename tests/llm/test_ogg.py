import hashlib
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sonalyt.llm import ogg


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
    return crc & 0xFFFFFFFF


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 60))
def test_round_trip_and_checksum(data, times):
    raw = (data * times) or b" "
    raw += b" " * (-len(raw) % ogg.FRAME)
    media = ogg.write(raw)
    found = ogg.read(media)
    assert ogg.payload(found) == raw and not found["bad"] and len(found["streams"]) == 2
    assert all(s["ended"] and not s["gaps"] for s in found["streams"].values())
    n = len(raw) // ogg.FRAME
    assert max(g for s in found["streams"].values() for g in s["granules"]) == n * ogg.FRAME
    assert ogg.checksum(data) == slow_checksum(data)


def test_long_payload_spans_pages():
    raw = bytes(range(256)) * 3000
    found = ogg.read(ogg.write(raw))
    assert ogg.payload(found) == raw and found["pages"] > 6


def test_damage_is_found():
    media = bytearray(ogg.write(b"abc " * 4800))
    media[len(media) // 2] ^= 1
    found = ogg.read(bytes(media))
    assert found["bad"] >= 1 and ogg.payload(found) == b""
    assert ogg.read(b"") == {"streams": {}, "pages": 0, "bad": 0} and ogg.payload(ogg.read(b"OggS")) == b""
    assert ogg.payload(ogg.read(ogg.write(b"abc " * 4800)[:-5])) == b""
    assert ogg.payload(ogg.read(b"junk OggS junk" + ogg.write(b"abc " * 48))) == b"abc " * 48


def test_header_fields():
    media = ogg.write(b" " * ogg.FRAME)
    assert media[:4] == b"OggS" and media[5] == 2 and struct.unpack_from("<I", media, 18)[0] == 0


def test_columns(docs, rows):
    got = {str(r.doc_id): r for r in ogg.media_columns(docs, keep_media=True).collect()}
    for doc, text, *_ in rows:
        if doc is None:
            continue
        raw = (text or "").encode()
        padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[str(doc)]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and ogg.payload(ogg.read(bytes(r.media))) == padded


def test_empty(nothing):
    assert ogg.media_columns(nothing).count() == 0


def test_packets_have_times_of_their_own():
    for frames in (1, 2, 3, 40, 41, 77, 4000):
        found = ogg.read(ogg.write(bytes(frames * ogg.FRAME)))
        ends = {}
        for s in found["streams"].values():
            stream, step = s["packets"][0][15], ogg.PACKET * ogg.FRAME
            own = (frames + 1 - stream) // 2
            ends[stream] = [((min(k + ogg.PACKET, own) - 1) * 2 + stream + 1) * ogg.FRAME / ogg.RATE for k in range(0, own, ogg.PACKET)]
            assert np.allclose(ogg.times(s), ends[stream]) and all(len(p) <= step for p in s["packets"])
