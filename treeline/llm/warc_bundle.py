"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole WARC records,
and at its end a skippable frame with a seek table: compressed and plain size of every
frame, their number and a magic number. A reader needs the last bytes to find any frame,
and decompresses that frame alone. The index maps a record identifier to bundle, frame,
offset inside the frame and length. Without the footer the file is still plain Zstandard.

Bundles are written by the tasks straight to the shared folder, one file at a time under a
name of its own attempt, closed and then moved into place; the index carries the names, so
a task that is run again leaves an unused file and nothing else.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the smallest
identifier is a response; others are revisits that name it.

Defined cases: a null payload is empty; a null url is written as "urn:none", an empty one stays
empty, line ends in a url are written as %0D and %0A; extra columns are ignored; empty and long
payloads are whole records (a frame holds one record at least); a null page_id is written as
"null" and is never referred to; rows that repeat a page_id with an equal payload are responses alike; the empty table makes no bundle.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.shared import new_path, settle, text_slices

MIN_REVISIT = 100
#: Plain bytes after which a frame, and a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
LEVEL = 3
#: Plain bytes of records that one reading task gets.
READ_BYTES = 32 << 20

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

_DATE = "1970-01-01T00:00:00Z"  # records carry no fetch time, and output must not depend on the clock


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with a minimal HTTP header; a revisit has the header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    uri = ("urn:none" if url is None else url).replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {uri}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{record_id(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode("utf-8", "surrogatepass")
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {"": version} | dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class BundleWriter:
    """Writes frames and the footer to an open file."""

    def __init__(self, sink) -> None:  # noqa: ANN001
        self.sink, self.frames, self.plain, self.total = sink, [], [], 0
        self._held = 0
        self._zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset inside the frame, length)."""
        if self._held and self._held + len(record) > FRAME_BYTES:
            self._flush()
        at = (len(self.frames), self._held, len(record))
        self.plain.append(record)
        self._held += len(record)
        self.total += len(record)
        return at

    def _flush(self) -> None:
        data = b"".join(self.plain)
        packed = self._zstd.compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data)))
        self.plain, self._held = [], 0

    def close(self) -> None:
        if self.plain:
            self._flush()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.sink.close()


class BundleReader:
    """Random access to the frames of a bundle."""

    def __init__(self, source) -> None:  # noqa: ANN001 - seekable, with read() and size
        self.source = source
        end = source.seek(0, 2) if not hasattr(source, "size") else source.size()
        source.seek(end - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        source.seek(end - 9 - entry * count)
        table = source.read(entry * count)
        self.frames, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, entry * k)
            self.frames.append((at, packed, plain))
            at += packed
        self._zstd = zstandard.ZstdDecompressor()
        self._kept: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._kept[0] != k:
            at, packed, plain = self.frames[k]
            self.source.seek(at)
            self._kept = (k, self._zstd.decompress(self.source.read(packed), max_output_size=plain))
        return self._kept[1]

    def record(self, k: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        return parse_record(self.frame(k)[offset : offset + length])


def _files(folder: str):  # noqa: ANN202 - (filesystem, path) of a URI or plain path
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://")) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _with_kinds(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to for every row."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    # Small payloads take part in nothing: their key is spread, so that they do not meet in one task of the join.
    small = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    hashed = slim.withColumn("digest", F.when(F.octet_length("payload") >= MIN_REVISIT, F.sha2("payload", 256)).otherwise(small))
    # Only digests that occur twice or more: rows of one digest are combined before the shuffle.
    shared = hashed.select("page_id", "digest").filter("digest not like '-%'").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return hashed.join(settle(shared, "digests"), "digest", "left").select("page_id", "url", "payload", refers_to.alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages; returns the index: page_id, bundle, frame, offset, length (written to the shared folder)."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        writer, name, part = None, "", ""
        index: list[tuple] = []

        def done() -> pa.RecordBatch:
            writer.close()
            files.move(part, f"{root}/{name}")
            return pa.RecordBatch.from_pylist([dict(zip(("page_id", "bundle", "frame", "offset", "length"), x, strict=True)) for x in index], _INDEX)

        for batch in text_slices(batches, "payload"):
            for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if writer is None:
                    own = uuid.uuid4().hex
                    name, part = f"{own}.warc.zst", f"{root}/_{own}.part"
                    files.create_dir(root, recursive=True)
                    writer, index = BundleWriter(files.open_output_stream(part)), []
                index.append((page_id, name, *writer.add(warc_record(page_id, url, payload, refers_to))))
                if writer.total >= BUNDLE_BYTES:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    index = _with_kinds(pages).mapInArrow(write, _INDEX_DDL)
    out = settle(index, "warc-index")
    out._folder = folder
    return out


_INDEX_DDL = "page_id long, bundle string, frame int, offset long, length long"
_INDEX = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
_READ_DDL = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_bundles(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Read the indexed records through the seek tables; a bundle's frames are spread over tasks, each opened once a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        for batch in batches:
            wanted = sorted(zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length")), strict=True))
            for bundle, places in groupby(wanted, key=lambda x: x[0]):
                with files.open_input_file(f"{root}/{bundle}") as source:
                    reader, rows, held = BundleReader(source), [], 0
                    for place in places:
                        rows.append(_row(reader, *place, payloads))
                        held += rows[-1][3] if payloads else 1024
                        if held >= FRAME_BYTES:
                            yield _read_batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _read_batch(rows)

    # The index is small against what it points to, so tasks are counted by the bytes to be read, not left to be merged.
    held = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-held // READ_BYTES))
    return index.repartition(tasks, "bundle", "frame").mapInArrow(read, _READ_DDL)


def find_records(index: DataFrame, folder: str, page_ids: list[int]) -> DataFrame:
    """The records of some identifiers, payloads included: only the frames that hold them are read."""
    return read_bundles(index.filter(F.col("page_id").isin(*page_ids)), folder)


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def _row(reader: BundleReader, bundle: str, frame: int, offset: int, length: int, payloads: bool) -> tuple:
    fields, payload = reader.record(frame, offset, length)
    kind = fields["WARC-Type"]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["WARC-Payload-Length"])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record in {bundle}: {fields['WARC-Record-ID']}")
    number = lambda k: None if k not in fields or fields[k].endswith(":null>") else int(fields[k].rpartition(":")[2].rstrip(">"))
    return number("WARC-Record-ID"), fields["WARC-Target-URI"], payload if payloads else None, size, digest, kind, number("WARC-Refers-To")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as bundles, read them back, and report one row a record."""
    index = write_bundles(pages)
    return read_bundles(index, index._folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
