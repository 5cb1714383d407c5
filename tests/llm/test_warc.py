"""WARC: round trips, chunks, revisits."""

import gzip
import hashlib
from urllib.parse import urlparse

import pytest
from plaintide.llm import warc
from pyspark.sql import functions as F

ROWS = [
    (1, "http://a/x y\n", "p" * 1000, "c"), (2, "http://b", "p" * 1000, "c"), (3, None, "p" * 999, "c"), (4, "u", "p" * 999, "c"),
    (5, "ü", None, "c"), (6, "v", "", "c"), (7, "w", "ü\r\n\r\nWARC/1.1\r\n" * 30_000, "c"), (None, "n", "p" * 1000, "c"),
    (2, "http://b", "p" * 1000, "c"), (None, "n", "q" * 2000, "c"), (None, "n", "q" * 2000, "c"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id bigint, url string, html string, digest string")


def test_edge_cases(spark, pages):
    rows = warc.page_records(warc.archive_and_read(pages)).collect()
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    expected = []
    for page, _, html, _ in ROWS:
        data = (html or "").encode()
        revisit = html == "p" * 1000 and page != 2
        expected.append((page or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert got == sorted(expected, key=str)
    assert warc.page_records(warc.archive_and_read(pages.limit(0))).count() == 0


def test_chunks_join_to_the_payload(spark, pages):
    """Small chunks and small archives: payloads are equal byte for byte, digests grow with the chunks."""
    manifest = warc.write_archives(warc.records(pages.where("page_id > 2")), archive_bytes=200)
    assert manifest.count() >= 4
    chunks = warc.read_chunks(manifest, chunk=701)
    bodies = {}
    for r in sorted(chunks.where("record_type = 'response'").collect(), key=lambda r: (r.record_id, r.chunk)):
        body = bodies[r.record_id] = (bodies.get(r.record_id, b"") if r.chunk else b"") + bytes(r.data)
        assert r.payload_bytes == len(body) and r.sha1 == hashlib.sha1(body).hexdigest()
        assert r.last == (len(body) == r.header_bytes)
    assert bodies["<urn:page:7>"].decode() == ROWS[6][2]


def test_archives_are_plain_warc(spark, pages):
    manifest = warc.write_archives(warc.records(pages.where("page_id = 1")))
    data = gzip.open(urlparse(manifest.first().archive).path).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert b"WARC-Target-URI: http://a/x%20y%0A\r\n" in data and data.endswith(b"p\r\n\r\n")


def test_a_damaged_archive_is_refused(spark, pages):
    manifest = warc.write_archives(warc.records(pages.where("page_id = 7")))
    path = urlparse(manifest.first().archive).path
    data = gzip.open(path).read().replace("ü".encode(), b"xx", 1)
    open(path, "wb").write(gzip.compress(data))
    with pytest.raises(Exception, match="another digest"):
        warc.read_chunks(manifest).select(F.max("sha1")).collect()
