"""WARC archives as a chunked record table.

Writing: every task streams its rows to gzip archives of its own, one member per record,
payloads in slices. An archive gets a fresh name and counts only once its row stands in
the manifest, a written table, so an attempt that is lost or repeated leaves at most a file
that nobody reads.

Reading: a task streams an archive and emits rows of (record, chunk number, bytes) with
the number of payload bytes and the SHA-1 so far. The last chunk of a record thus carries
its length and digest; neither side of the reader holds more than a chunk of a payload.
The digest of the last chunk is checked against the header.

Deduplication: of records with equal payloads of at least ``floor`` bytes the one with the
largest id is the response, the others are revisit records without payload, which name it.

Defined cases: null html is an empty payload; a null url leaves out the target; control
characters and spaces in a url are percent-encoded; a row without id refers to the largest
id of its payload, or is a response if there is none; rows that repeat the largest id are
all responses; an empty table gives an empty manifest and no records. Columns other than
id, url and html are left aside.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import sys
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.common import same, shuffle_tasks
from plaintide.session import settle, shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no install

FLOOR = 1000
CHUNK = 1 << 20
ARCHIVE_BYTES = 1 << 30
LEVEL = 1
_ID = "<urn:page:{}>"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
MANIFEST = "archive string, records bigint, bytes bigint"
CHUNKS = (
    "record_id string, record_type string, target_uri string, refers_to string, header_digest string, "
    "header_bytes bigint, chunk int, data binary, payload_bytes bigint, sha1 string, last boolean"
)


# --- deciding ----------------------------------------------------------------------------------


def records(pages: DataFrame, floor: int = FLOOR) -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to of every page."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    shared = rows.where(F.length("payload") >= floor).groupBy(F.col("digest").alias("_d"))
    keepers = shared.agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_n")).where("_n > 1 AND _keeper IS NOT NULL")
    # Written first: its measured size decides whether the payloads have to be shuffled at all.
    rows = rows.join(settle(keepers.drop("_n"), "warc-keepers"), F.col("digest") == F.col("_d"), "left")
    revisit = F.col("_keeper").isNotNull() & ~same(F.col("page_id"), F.col("_keeper"))
    return rows.select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_keeper")).alias("refers_to"),
    )


# --- writing -------------------------------------------------------------------------------------


def _header(fields: list[tuple[str, object]]) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode("utf-8", "surrogatepass")


def _clean(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


class _Archive:
    """One archive that is being written: a gzip member per record."""

    def __init__(self, folder: str):
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        self.out = system.open_output_stream(f"{path}/{self.uri.rsplit('/', 1)[1]}", compression=None)
        self.records = self.bytes = 0
        self.add([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", _DATE),
                  ("Content-Type", "application/warc-fields"), ("Content-Length", 0)], [])
        self.records = 0

    def add(self, fields: list[tuple[str, object]], block: list) -> None:
        member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        pieces = [_header(fields)]
        for part in block:
            pieces += [part[at : at + CHUNK] for at in range(0, len(part), CHUNK)]
        for piece in [*pieces, b"\r\n\r\n"]:
            self._put(member.compress(piece))
        self._put(member.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.bytes += len(data)


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None

        def closed() -> pa.RecordBatch:
            archive.out.close()
            return pa.RecordBatch.from_pydict({"archive": [archive.uri], "records": [archive.records], "bytes": [archive.bytes]})

        for batch in batches:
            ids, urls, digests, kinds, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "record_type", "refers_to"))
            payloads = batch.column("payload")
            for i, (page, url, digest, kind, refer) in enumerate(zip(ids, urls, digests, kinds, refers)):
                archive = archive or _Archive(folder)
                payload = memoryview(payloads[i].as_buffer())
                block = [_HTTP] if kind == "revisit" else [_HTTP, payload]
                archive.add(
                    [
                        ("WARC-Type", kind), ("WARC-Record-ID", _ID.format("" if page is None else page)), ("WARC-Date", _DATE),
                        ("WARC-Target-URI", _clean(url)), ("WARC-Refers-To", None if refer is None else _ID.format(refer)),
                        ("WARC-Profile", _PROFILE if kind == "revisit" else None),
                        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
                        ("X-Payload-Length", len(payload)), ("Content-Type", "application/http;msgtype=response"),
                        ("Content-Length", sum(map(len, block))),
                    ],
                    block,
                )
                if archive.bytes >= archive_bytes:
                    yield closed()
                    archive = None
        if archive:
            yield closed()

    return run


def write_archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records and return the manifest, one row per archive."""
    folder = shared_folder(rows.sparkSession, "warc")
    return settle(rows.mapInArrow(_writer(folder, archive_bytes), MANIFEST), "warc-manifest")


# --- reading -------------------------------------------------------------------------------------


def _chunks_of(stream, chunk: int) -> Iterator[tuple]:
    """Rows of the chunk table, from the decompressed stream of an archive."""
    while line := stream.readline():
        if line.rstrip(b"\r\n") != b"WARC/1.1":
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[name.strip().lower()] = value.strip()
        left = int(fields["content-length"])
        if fields["warc-type"] not in ("response", "revisit"):
            stream.read(left + 4)
            continue
        while left:  # the block begins with the header of the answer
            line = stream.readline(left)
            left -= len(line)
            if line in (b"\r\n", b"\n"):
                break
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        head = (fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, int(fields["x-payload-length"]))
        sha, done, number = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(chunk, left))
            if len(data) < min(chunk, left):
                raise ValueError(f"archive ends inside record {head[0]}")
            left -= len(data)
            done += len(data)
            sha.update(data)
            yield (*head, number, data, done, sha.hexdigest(), left == 0)
            number += 1
            if not left:
                break
        if head[1] == "response" and sha.hexdigest() != digest:
            raise ValueError(f"payload of {head[0]} has another digest")
        stream.read(4)


def _reader(chunk: int, with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in CHUNKS.split(", ")]
        types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
        schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in CHUNKS.split(", ")])

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names=names)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(archive)
                held, size = [], 0
                with system.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in _chunks_of(stream, chunk):
                        held.append(row if with_data else (*row[:7], None, *row[8:]))
                        size += len(row[7]) if with_data else 256
                        if size >= 4 * CHUNK:
                            yield emit(held)
                            held, size = [], 0
                if held:
                    yield emit(held)

    return run


def read_chunks(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``manifest``.

    ``with_data=False`` leaves the bytes out for users of lengths and digests alone; they are
    streamed and hashed all the same.
    """
    # A stated number of tasks: the manifest is tiny, what it names is not.
    archives = manifest.select("archive").repartition(shuffle_tasks(manifest.sparkSession), "archive")
    return archives.mapInArrow(_reader(chunk, with_data), CHUNKS)


def page_records(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    def page(column: str):
        return F.nullif(F.regexp_extract(column, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("bigint")

    full = F.col("record_type") == "response"
    return chunks.where("last").select(
        page("record_id").alias("page_id"),
        F.when(full, F.col("payload_bytes")).otherwise(F.col("header_bytes")).alias("payload_bytes"),
        F.when(full, F.col("sha1")).otherwise(F.col("header_digest")).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"),
    )


def archive_and_read(pages: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Write every page to archives and read them back: the chunk table without its bytes."""
    return read_chunks(write_archives(records(pages, floor)), with_data=False)
