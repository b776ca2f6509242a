"""WARC files: one gzip member per record, read sequentially.

The writer turns a table of pages into compressed WARC files in the shared folder. The reader
goes through a file in chunks with incremental zlib decompression, frames each record by its
Content-Length, and verifies its block digest; one task reads one file at a time and holds one
record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockml.session import default_parallelism, shared_path

ROW = "page_id long, url string, html string, sha1 string, n_bytes long, status string"
CHUNK = 1 << 20
MAGIC = b"\x1f\x8b\x08"


def record(page_id: int | None, url: str | None, html: str | None, date: str) -> bytes:
    """One compressed record. Extension fields carry what the standard ones can't: nulls, and a
    URL with line ends or outer spaces."""
    block = b"" if html is None else html.encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:sha1:{digest}"
    lines = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        plain = " ".join(url.splitlines()).strip()
        lines.append(f"WARC-Target-URI: {plain}")
        if plain != url:
            lines.append(f"X-Target-URI: {json.dumps(url)}")
    if html is None:
        lines.append("X-Null-Block: 1")
    lines += [f"WARC-Block-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> list[str]:
    """WARC files in the shared folder, one a partition of ``pages`` (page_id, url, html); their
    URIs. A retried task writes another file, and only the files of tasks that ended count."""
    folder = shared_path(pages.sparkSession, "warc")

    def run(batches):
        uri = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        fs, path = FileSystem.from_uri(uri)
        out = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            for row in zip(*(c.to_pylist() for c in b.columns)):
                out.write(record(*row, date))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri]})

    return [r.uri for r in pages.select("page_id", "url", "html").mapInArrow(run, "uri string").collect()]


def members(stream) -> Iterator[bytes | None]:
    """The content of each gzip member. None once for each stretch that can't be read; reading goes on at
    the next gzip header after it."""
    unpack, held, begun, lost = zlib.decompressobj(31), [], False, False
    chunk = b""
    while more := stream.read(CHUNK):
        chunk += more
        while chunk:
            if lost and not begun:
                at = chunk.find(MAGIC)
                if at < 0:
                    chunk = chunk[1 - len(MAGIC) :]  # may be a header's start
                    break
                chunk = chunk[at:]
            try:
                held.append(unpack.decompress(chunk))
            except zlib.error:
                if not lost:
                    yield None
                chunk = chunk if begun else chunk[1:]
                unpack, held, begun, lost = zlib.decompressobj(31), [], False, True
                continue
            begun = True
            chunk = b""
            if unpack.eof:
                yield b"".join(held)
                chunk, unpack, held, begun, lost = unpack.unused_data, zlib.decompressobj(31), [], False, False
    if begun and not lost:
        yield None


def verify(block: bytes, given: str | None) -> str:
    """The status of a block with a labelled digest: any algorithm of hashlib with a fixed length, the
    label in any case, the value in hexadecimal, base32 or base64, with or without padding."""
    if given is None:
        return "no_digest"
    label, _, value = (x.strip() for x in given.partition(":"))
    label, value = label.lower(), value.rstrip("=")
    for name in dict.fromkeys((label, label.replace("-", ""), label.replace("-", "_"))):
        try:
            digest = hashlib.new(name, block, usedforsecurity=False).digest()
        except (ValueError, TypeError):  # not known here, or of no fixed length
            continue
        b32, b64 = (encode(digest).decode().rstrip("=") for encode in (base64.b32encode, base64.b64encode))
        return "ok" if value.lower() == digest.hex() or value.upper() == b32 or value == b64 else "bad_digest"
    return "unknown_digest"


def parse(member: bytes) -> dict | None:
    """A row for one record; None for records that are no resource or response."""
    head, found, rest = member.partition(b"\r\n\r\n")
    try:
        lines = head.decode().split("\r\n")
        if not found or not lines[0].startswith("WARC/"):
            return {"status": "bad_header"}
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if fields.get("warc-type") not in ("resource", "response"):
            return None
        size = fields.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            return {"status": "bad_header"}
        name = fields.get("warc-record-id", "").strip("<>")
        page_id = int(name[9:]) if name.startswith("urn:page:") else None
        url = json.loads(fields["x-target-uri"]) if "x-target-uri" in fields else fields.get("warc-target-uri")
    except ValueError:  # of the decoding, the number or the JSON
        return {"status": "bad_header"}
    if not isinstance(url, str | None) or page_id is not None and not -(1 << 63) <= page_id < 1 << 63:
        return {"status": "bad_header"}
    block = rest[: int(size)]
    row = {"page_id": page_id, "url": url and url.encode("utf-8", "replace").decode(), "n_bytes": len(block)}
    if len(block) < int(size) or rest[int(size) :] != b"\r\n\r\n":
        return row | {"status": "bad_length"}
    row["status"] = verify(block, fields.get("warc-block-digest"))
    if row["status"] != "bad_digest" and "x-null-block" not in fields:
        row["html"] = block.decode("utf-8", "replace")
        row["sha1"] = hashlib.sha1(block).hexdigest()
    return row


def read_warc(spark: SparkSession, uris: list[str]) -> DataFrame:
    """A row per resource or response record of the files: page_id, url, html, sha1 (of the
    block), n_bytes, status.

    Status is ok, no_digest, unknown_digest (an algorithm that isn't known here), bad_digest,
    bad_length (framing disagrees with Content-Length), bad_header (not UTF-8, no WARC line, no length,
    or a page number or URL extension that can't be read), or corrupt (a stretch that breaks off or isn't
    gzip; reading goes on at the next gzip header). Only ok, no_digest and unknown_digest rows have
    html. Records named otherwise than by a page number have a null page_id. Nulls come back as nulls,
    empty blocks as "". Repeated records give repeated rows; no files give an empty table.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("sha1", pa.string()), ("n_bytes", pa.int64()), ("status", pa.string())])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for uri in b["uri"].to_pylist():
                fs, path = FileSystem.from_uri(uri)
                with fs.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        row = {"status": "corrupt"} if member is None else parse(member)
                        if row is None:
                            continue
                        held.append(row)
                        size += row.get("n_bytes", 0)
                        if size > 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.createDataFrame([(u,) for u in uris], "uri string")
    tasks = max(1, min(len(uris), 4 * default_parallelism(spark)))
    return files.repartition(tasks).mapInArrow(run, ROW)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` through WARC files: what ``read_warc`` finds in what ``write_warc`` wrote.
    Columns other than page_id, url and html are left out, so none can clash with ``sha1``, ``n_bytes``
    and ``status``. Repeated rows come back as often; an empty table gives an empty one."""
    return read_warc(pages.sparkSession, write_warc(pages.withColumn("page_id", F.col("page_id").cast("long"))))
