import hashlib
import zlib

import pytest

from txloom.llm import ogg


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum_is_the_formats():
    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 255, 1919, 1920, 65_000, 200_000])
def test_payload_survives(n):
    data = bytes(i * 7 % 251 for i in range(n))
    payload, length, _ = ogg.read_media(ogg.encode(data))
    assert length == n and payload == data + b" " * (len(payload) - n)
    assert len(payload) == max(192, -(-n // 192) * 192)


def test_packets_span_pages_and_streams_are_separated():
    packets = [b"head", b"a" * 70_000, b"", b"b" * 255, b"c" * 510, b"d"]
    one = ogg.logical_pages(packets, [0, 8000, 8000, 16000, 24000, 24001], 1)
    two = ogg.logical_pages([b"other", b"x" * 100_000], [0, 5], 2)
    mixed = [one[0], two[0]]
    for k in range(1, max(len(one), len(two))):
        mixed += one[k : k + 1] + two[k : k + 1]
    streams = ogg.decode(b"".join(mixed))
    assert streams[1].packets == packets and streams[2].packets == [b"other", b"x" * 100_000]
    assert ogg.timestamps(streams[1], 8000)[-1] == 24001 / 8000 and len(one) > 2


@pytest.mark.parametrize("damage", [lambda m: m[:-1], lambda m: m[:20], lambda m: b"x" + m, lambda m: m[:60] + bytes([m[60] ^ 1]) + m[61:], lambda m: m + m, lambda m: m[: m.rindex(b"OggS")]])
def test_damage_is_found(damage):
    with pytest.raises(ogg.OggError):
        ogg.read_media(damage(ogg.encode(b"hello" * 40_000)))


def test_round_trip_matches_brute_force(messy, nothing):
    rows = messy.collect()
    got = ogg.round_trip(messy).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in rows:
        data = (r.text or "").encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192))
        by_text[hashlib.sha256(payload).hexdigest()] = (len(payload), zlib.crc32(payload[-16:]))
    for r in got:
        assert (r.payload_bytes, r.tail_crc32) == by_text[r.payload_sha256]
    assert len({(r.payload_sha256, r.n_bytes, r.media_sha256, r.feature) for r in got}) == len({r.text or "" for r in rows})
    assert ogg.round_trip(nothing).count() == 0
