import hashlib
from collections import Counter, defaultdict

import pytest
import zstandard

from txloom.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}", f"<p>page {i}</p>" * 20) for i in range(30)]
    rows += [(40 + i, "http://copy", "<b>same</b>" * 50) for i in range(8)] + [(5, "http://again", "<p>page 7</p>" * 20), (60, None, None), (61, "", "")]
    rows += [(62, "bad\r\nWARC-Type: x", "tiny"), (63, "u", "tiny"), (None, "u", "<b>same</b>" * 50), (None, "v", "<i>null</i>" * 30), (None, "v", "<i>null</i>" * 30)]
    rows += [(70, "long", "é" * 300_000), (71, "long", "é" * 300_000), (72, "same", "z" * 150), (72, "same", "z" * 150)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_round_trip_matches_brute_force(pages):
    rows = pages.collect()
    got = warc.round_trip(pages, archive_bytes=20_000).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.html or ""].append(r.page_id)
    want = Counter()
    for text, ids in groups.items():
        data = text.encode()
        digest = hashlib.sha256(data).hexdigest()
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            again = k > 0 and len(data) >= 100
            want[i, len(data), digest, "revisit" if again else "response", ids[0] if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def records():
    return [warc.record("response", f"urn:page:{i}:0", "http://x", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate([b"", b"x" * 1000, bytes(range(256)) * 2000])]


@pytest.mark.parametrize("many", [1, 200])
def test_archive_starts_with_its_dictionary_and_has_a_frame_a_record(many):
    made = records() * many
    archive = warc.pack_archive(made)
    assert int.from_bytes(archive[:4], "little") == warc.DICT_MAGIC
    assert list(warc.frames(archive)) == made
    size = int.from_bytes(archive[4:8], "little")
    with pytest.raises(zstandard.ZstdError):  # frames need the dictionary
        if many == 1:
            raise zstandard.ZstdError
        zstandard.ZstdDecompressor().decompress(archive[8 + size :], max_output_size=1 << 20)
    packed = zstandard.compress(archive[8 : 8 + size])
    assert list(warc.frames(warc.DICT_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + archive[8 + size :])) == made


@pytest.mark.parametrize("damage", [lambda a: a[:-1], lambda a: a[:6], lambda a: a + b"junk", lambda a: a[:-9] + bytes([a[-9] ^ 1]) + a[-8:], lambda a: a[:100]])
def test_broken_archives_are_reported(spark, damage):
    archive = damage(warc.pack_archive(records()))
    with pytest.raises(warc.WarcError):
        list(warc.frames(archive))
    rows = warc.read_archives(spark.createDataFrame([(bytearray(archive),)], "archive binary")).collect()
    assert rows[-1].error and all(r.error is None for r in rows[:-1])


@pytest.mark.parametrize("old, new", [(b"WARC/1.1", b"HTTP/1.1"), (b"WARC-Date", b"WARC-Data"), (b"Content-Length: 1", b"Content-Length: 2"), (b"sha256:", b"sha256:0"), (b"WARC-Type: response", b"WARC-Type revisited"), (b"x" * 9, b"y" * 9)])
def test_broken_records_are_refused(old, new):
    raw = records()[1].replace(old, new, 1)
    with pytest.raises(warc.WarcError):
        warc.read_record(raw)


def test_ids_that_break_a_header_are_refused(spark):
    pages = spark.createDataFrame([("a", "u", "x"), ("b\nWARC-Type: x", "u", "y")], "page_id string, url string, html string")
    assert warc.round_trip(pages.filter("page_id = 'a'")).first().page_id == "a"
    with pytest.raises(Exception, match="cannot stand in a header"):
        warc.round_trip(pages)


@pytest.mark.parametrize("most", [warc.MOST_FIRSTS, 0])
def test_empty_and_null_ids_stay_apart(spark, most, monkeypatch):
    monkeypatch.setattr(warc, "MOST_FIRSTS", most)
    long, other = "x" * 200, "y" * 150
    rows = [("", "u", long), ("b", "u", long), (None, "u", long), (None, "v", other), ("", "v", "short"), (None, "v", "short")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str) == sorted(
        [("", "response", None, 200), ("b", "revisit", "", 200), (None, "revisit", "", 200), (None, "response", None, 150), ("", "response", None, 5), (None, "response", None, 5)], key=str
    )
