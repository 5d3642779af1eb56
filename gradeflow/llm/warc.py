"""WARC archives of web pages: a writer that stores each payload once, and a reader that splits archives by byte ranges.

Every record is a gzip member of its own. A reading task gets a byte range of an archive, looks for the gzip magic from
there on, and takes a candidate member for real if decoding it yields a WARC header. It owns the records that start inside
its range, reads the last of them past the range's end, and goes from one member to the next by the end of its stream, so
only a range's first member is searched for. Of records with equal payloads one is stored as a response and the others
as revisits, which hold the HTTP header alone; response and revisit both carry digest and length of the whole payload.

A writing task names its archives by random ids, and the list of archives is a table that Spark commits, so what failed or
repeated tasks leave behind is never read. Archives are opened with Arrow's file systems by the URI of the shared folder.

Defined cases: a null payload is empty; a null URL has no target URI in its record; a row with a null id is a revisit if an
equal payload has an id, else a response; rows that share the largest id of a payload are all responses; white space and
control characters of URLs are percent-encoded in the record; other columns of the input are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.llm._shared import scratch_path, stored

SPLIT = 4 << 20
ARCHIVE_BYTES = 128 << 20
LEVEL = 4
BLOCK = 1 << 18
BATCH_BYTES = 4 << 20
SALTS = 16
MAGIC = b"\x1f\x8b\x08"
GZIP = 31  # zlib's window bits for a gzip member
#: Enough of a member to see whether it begins a record.
PROBE = 256
RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
RECORD_DDL = "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {n}')}>" if n is not None else f"<urn:uuid:{uuid.uuid4()}>"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    block = http + payload if refers_to is None else http
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{a}: {b}\r\n" for a, b in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The row of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda name: int(fields[name]) if name in fields else None
    row = {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID")}
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if row["record_type"] == "response":
        if digest(payload) != said:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have the digest of its header")
        return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": said}
    length = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    return row | {"payload": None, "payload_bytes": length, "payload_digest": said}


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all rows as records into a folder; gives the table (path, bytes) of the archives."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    equal = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    # one payload can be that of a third of all pages: its rows are dealt over SALTS keys, and what they refer to goes along with each
    salted = equal.where("n > 1").select("sha", "kept", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"], "left")
    rows = rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, system = None, None, None
        done = lambda: pa.RecordBatch.from_pylist([{"path": path, "bytes": out.tell()}])
        for batch in batches:
            for page_id, link, text, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    system, place = opened(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(place, compression=None)
                squeeze = zlib.compressobj(LEVEL, wbits=GZIP)
                out.write(squeeze.compress(record(page_id, link, text.encode(), refers_to, date)) + squeeze.flush())
                if out.tell() >= archive_bytes:
                    found = done()
                    out.close()
                    out = None
                    yield found
        if out is not None:
            found = done()
            out.close()
            yield found

    return stored(rows.mapInArrow(write, "path string, bytes bigint"), "archives")


def members(source, begin: int, end: int) -> Iterator[bytes]:
    """The decoded records of an archive that start in [begin, end)."""
    source.seek(begin)
    held, at, known = b"", begin, begin == 0  # held begins at offset at; known: a member begins there

    def more() -> bool:
        nonlocal held
        data = source.read(BLOCK)
        held += data
        return bool(data)

    while at < end:
        if not known:
            place = held.find(MAGIC)
            if place < 0:
                at, held = at + max(0, len(held) - 2), held[-2:]
                if not more():
                    return
                continue
            at, held = at + place, held[place:]
            if at >= end:
                return
            while len(held) < BLOCK and more():
                pass
            try:
                known = zlib.decompressobj(GZIP).decompress(held, PROBE).startswith(b"WARC/1.")
            except zlib.error:
                known = False
            if not known:
                at, held = at + 1, held[1:]
                continue
        if not held and not more():
            return
        decode, parts, size = zlib.decompressobj(GZIP), [], 0
        while True:
            try:
                parts.append(decode.decompress(held))
            except zlib.error:
                if size or parts:
                    raise
                break
            size += len(held) - len(decode.unused_data)
            held = decode.unused_data
            if decode.eof:
                break
            if not more():
                raise EOFError("the archive ends inside a record")
        if not decode.eof:  # no member here after all: search on
            known, at, held = False, at + 1, held[1:]
            continue
        at += size
        yield b"".join(parts)


def read_archives(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of all records. archives: (path, bytes)."""
    ranges = archives.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split).cast("bigint"))).alias("start"))
    n = archives.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split)), F.lit(1))).first()[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = opened(path)
                with system.open_input_file(place) as source:
                    for data in members(source, start, start + split):
                        held.append(parsed(data))
                        size += len(data)
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, RECORD)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, RECORD)

    return ranges.repartition(int(max(1, min(n, 20_000))), "path", "start").mapInArrow(read, RECORD_DDL)


def warc_digest(pages: DataFrame, split: int = SPLIT) -> DataFrame:
    """Writes the pages into archives in the shared folder, reads those back, and gives a row for each record."""
    spark: SparkSession = pages.sparkSession
    archives = write_archives(pages, scratch_path(spark, "warc"))
    return read_archives(archives, split).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
