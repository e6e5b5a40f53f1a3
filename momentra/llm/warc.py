"""WARC archives, index first.

Writing gives an index row a record (archive, offset, length, URL, digest). Reading sorts the selected rows by archive
and offset, merges neighbouring byte ranges and fetches each merged range at once. Archives are gzip members, one a
record, in the shared folder; a retried task writes a file of a new name, and only files that the index names count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentra.llm.common import cut, fresh_dir, shuffle_parts

#: A new archive begins beyond so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Ranges with a gap of so many bytes or less are read together, up to READ_BYTES at once.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Repeated payloads that are broadcast at most; more are joined.
BROADCAST_PAYLOADS = 200_000
INDEX = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ]
)
RECORD = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("payload", pa.binary()),
    ]
)
DDL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {DDL[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows by way of Arrow, not pandas: ids keep all 64 bits beside nulls."""
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def base32_digest(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def payload_digest(payload: bytes) -> str:
    return base32_digest(hashlib.sha1(payload).hexdigest())


def _record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload; a revisit, which has none, tells the payload's size in its HTTP head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    response = payload is not None
    block = http + payload if response else http
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if not response:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A gzip member -> the WARC fields, the HTTP head and the payload."""
    raw = zlib.decompress(member, 31)
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, payload = rest[: int(fields["Content-Length"])].split(b"\r\n\r\n", 1)
    return fields, http, payload


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, html, sha, bytes, record_type, refers_to); html is null for a revisit.

    Of equal payloads of min_bytes or more the largest page_id is the response, the others revisit it; smaller ones are
    all responses. Null html is the empty payload. A page_id that repeats is one page: all its rows of that payload
    are responses. A null page_id is below all others; where all are null, all are responses.

    Only digests are grouped, and only those that repeat are joined with the pages: broadcast up to
    BROADCAST_PAYLOADS, else by a join that adaptive execution can split where very many pages share a payload.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("html"), F.sha1(body.cast("binary")).alias("sha"),
        F.octet_length(body).cast("long").alias("bytes")
    )
    groups = p.groupBy("sha", "bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = cut(groups.where((F.col("n") > 1) & (F.col("bytes") >= min_bytes)).select("sha", "bytes", "first", F.lit(True).alias("shared")))
    again = F.broadcast(again) if again.count() <= BROADCAST_PAYLOADS else again
    revisit = F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    x = p.join(again, ["sha", "bytes"], "left").withColumn("revisit", revisit)
    return x.select(
        "page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "sha", "bytes",
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("revisit"), F.col("first")).alias("refers_to")
    )


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Records as plan_records gives them -> the index of the archives written to folder.

    Evaluating the result writes; store it (write_index) before it is used more than once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, at, rows = None, "", 0, []
        for b in batches:
            for r in b.to_pylist():
                digest = base32_digest(r["sha"])
                payload = None if r["html"] is None else r["html"].encode("utf-8", "surrogatepass")
                data = _member(_record(r["page_id"], r["url"], payload, r["bytes"], digest, r["refers_to"]))
                if out is None:
                    path, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                out.write(data)
                rows.append((r["page_id"], r["url"], path, at, len(data), digest, r["record_type"], r["refers_to"]))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    yield _batch(rows, INDEX)
                    out, rows = None, []
        if out is not None:
            out.close()
            yield _batch(rows, INDEX)

    return records.mapInArrow(run, ddl(INDEX))


def write_index(index: DataFrame, folder: str) -> DataFrame:
    index.write.parquet(f"{folder}/index")
    return index.sparkSession.read.schema(ddl(INDEX)).parquet(f"{folder}/index")


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """Selected index rows -> (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload).

    payload is null for a revisit; its length is in the kept HTTP head. A response whose bytes do not match the stored
    digest raises an error.
    """
    spans = index.select("archive", "offset", "length").repartitionByRange(shuffle_parts(index.sparkSession), "archive", "offset").sortWithinPartitions("archive", "offset")

    def number(field: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", field or "")
        return int(m[1]) if m else None

    def fetch(store: fs.FileSystem, path: str, part: list[tuple[int, int]]) -> pa.RecordBatch:
        begin, end = part[0][0], max(o + n for o, n in part)
        with store.open_input_file(path) as f:
            data = f.read_at(end - begin, begin)
        rows = []
        for o, n in part:
            fields, http, payload = parse_record(data[o - begin : o - begin + n])
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            response = fields["WARC-Type"] == "response"
            if response and payload_digest(payload) != digest:
                raise ValueError(f"{path} at {o}: the payload does not match its digest")
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            rows.append(
                (
                    number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], number(fields.get("WARC-Refers-To")), size,
                    digest, payload if response else None
                )
            )
        return _batch(rows, RECORD)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        path, part, end = "", [], 0
        for b in batches:
            for archive, offset, length in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if part and (archive != path or offset - end > GAP_BYTES or offset + length - part[0][0] > READ_BYTES):
                    yield fetch(store, path, part)
                    part = []
                path = archive
                part.append((offset, length))
                end = offset + length
        if part:
            yield fetch(store, path, part)

    return spans.mapInArrow(run, ddl(RECORD))


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) -> every record read back from archives written for it; see plan_records, read_warc."""
    folder = fresh_dir(pages.sparkSession, "warc")
    return read_warc(write_index(write_warc(plan_records(pages, min_bytes), folder), folder), folder)
