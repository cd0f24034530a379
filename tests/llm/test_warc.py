"""WARC in Zstandard: exact round trips, and what damaged archives say."""

import hashlib

import pytest
import zstandard
from pyspark.sql import Row

from redressa.llm import warc
from redressa.session import fresh_path


def archive(records, dictionary=b""):
    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    frames = [zstandard.ZstdCompressor(dict_data=trained).compress(r) for r in records]
    return (warc.dictionary_frame(dictionary) if dictionary else b"") + warc.SEPARATOR.encode().join(frames)


def test_archive_bytes_round_trip():
    payloads = [b"", b"x" * 200_000, "é\r\n\r\nWARC/1.1".encode(), b"\x00\xff"]
    data = archive([warc.make_record(k, f"http://h/{k}", p) for k, p in enumerate(payloads)], b"abc" * 500)
    rows = list(warc.read_archive(data))
    assert [r["payload"] for r in rows] == payloads and not any(r["error"] for r in rows)
    assert [r["page_id"] for r in rows] == [0, 1, 2, 3]
    assert list(warc.read_archive(b"")) == []


@pytest.mark.parametrize(
    ("change", "says"),
    [
        (lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1", 1), "version"),
        (lambda r: r.replace(b"Content-Length: 5", b"Content-Length: 6"), "content length"),
        (lambda r: r.replace(b"Content-Length: 5", b"Content-Length: x"), "content length"),
        (lambda r: r.replace(b"WARC-Date", b"Other"), "warc-date"),
        (lambda r: r.replace(b"hello", b"jello"), "digest"),
        (lambda r: r + b"more", "content length"),
        (lambda r: r.replace(b"WARC-Type: response", b"no colon here"), "header line"),
    ],
)
def test_bad_records_are_named_and_others_read(change, says):
    good = warc.make_record(1, "http://h", b"hello")
    rows = list(warc.read_archive(archive([change(good), good])))
    assert says in rows[0]["error"] and rows[1]["error"] is None


def test_damaged_frames_end_the_archive_with_an_error():
    good = archive([warc.make_record(1, "u", b"x" * 5000)] * 2, b"dictionary" * 100)
    for bad in (good[:-3], good[:20], good + b"junk frame", warc.DICTIONARY_MAGIC + b"\xff\xff\x00\x00abc"):
        rows = list(warc.read_archive(bad))
        assert rows[-1]["error"] and all(r["error"] is None for r in rows[:-1])
    plain = archive([warc.make_record(1, "u", b"y")])
    assert [r["error"] for r in warc.read_archive(plain)] == [None]


def plain(rows):
    digest = {k: hashlib.sha1((h or "").encode()).hexdigest() for k, (_, _, h) in enumerate(rows)}
    out = []
    for k, (page, _, html) in enumerate(rows):
        size = len((html or "").encode())
        same = [r[0] for j, r in enumerate(rows) if digest[j] == digest[k] and r[0] is not None]
        first = max(same) if size >= 1000 and same and page is not None else page
        revisit = first != page
        out.append((page, size, digest[k], "revisit" if revisit else "response", first if revisit else None))
    return out


def test_pages_round_trip(spark):
    big, bytes_999, at_1000 = "é" * 700, "a" * 999, "b" * 1000
    rows = [(k, f"http://h/{k}\r\nx", big) for k in range(300)]
    rows += [(400, None, None), (401, "u", ""), (402, "u", bytes_999), (403, "u", bytes_999), (404, "u", at_1000), (405, "u", at_1000)]
    rows += [(None, "u", big), (500, "u", "<p>" + "long " * 100_000), (406, "u", "same"), (406, "u", "same")]
    pages = spark.createDataFrame([Row(page_id=a, url=b, html=c, payload_bytes=1) for a, b, c in rows], "page_id long, url string, html string, payload_bytes int")
    got = warc.archive_round_trip(spark, pages.repartition(3)).collect()
    assert not any(r.error for r in got)
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(found, key=str) == sorted(plain(rows), key=str)
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_payloads_are_read_back_whole(spark):
    rows = [(k, "u", f"page {k} " * (k + 1)) for k in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_archives(pages, fresh_path(spark, "warc"))
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, path).collect()}
    assert got == {k: h for k, _, h in rows}
