"""WARC archives with an index first.

Writing: each task writes archives of its own to the shared folder, every record a gzip member of its own, and gives
an index row for each record: file, offset, length, URL, digest.  Only the index rows of tasks that end count, so
what a lost task leaves behind is never read.  Records with equal payloads are revisits of one response.

Reading: the index rows of the wanted records are grouped by file and region, sorted by offset, and joined into few
byte-range reads; nothing else of an archive is read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialise, new_dir

INDEX = "page_id long, url string, digest string, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters of a URL that may stand in a header as they are.
_PLAIN = "".join(chr(c) for c in range(33, 127))


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit if refers_to is given: its block is the HTTP header alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_PLAIN)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """One record, as written by record(). Raises ValueError where lengths or a payload's digest don't fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4:
        raise ValueError("a record's block has another length than its header says")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    total = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda x: int(x) if (x := x[len("<urn:page:") : -1]) else None
    full = fields["WARC-Type"] == "response"
    if full and (len(payload) != total or sha1_base32(payload) != digest):
        raise ValueError("a payload doesn't fit its digest or length")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To"]) if not full else None, "payload_bytes": total, "payload_digest": digest, "payload": payload if full else None}


def write_archives(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, file_bytes: int = 256 << 20) -> DataFrame:
    """Writes a record for each row and gives the index (INDEX), a written table.

    A null payload counts as empty.  Of payloads that are equal, and least_bytes long or longer, the row with the
    largest id is the response and the others revisit it; rows that share that largest id are responses all, and so
    are rows of a group without any id.  A null id is written as an empty one, a null URL is left out, and characters
    that a header can't hold are percent-encoded.  An empty table gives an empty index; other columns are dropped.
    """
    spark = pages.sparkSession
    p = pages.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("payload"))
    p = p.withColumn("sha", F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload")))
    same = p.filter("sha is not null").groupBy("sha").agg(F.max("id").alias("top"), F.count("*").alias("n")).filter("n > 1 and top is not null").select("sha", "top")
    p = p.join(materialise(same, "same"), "sha", "left").select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("top")), F.col("top")).alias("refers"))
    target = new_dir(spark, "warc")

    def write(stream):
        fs, path = filesystem(target)
        fs.create_dir(path, recursive=True)
        name, out, at = "", None, 0
        try:
            for batch in stream:
                rows = []
                for i, u, text, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                        info = gzip.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode(), mtime=0)
                        out.write(info)
                        at = len(info)
                    raw = text.encode()
                    digest = sha1_base32(raw)
                    member = gzip.compress(record(i, u, raw, digest, refers), 6, mtime=0)
                    out.write(member)
                    rows.append((i, u, digest, f"{target}/{name}", at, len(member)))
                    at += len(member)
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2]), pa.array(c[3]), pa.array(c[4], pa.int64()), pa.array(c[5], pa.int64())], names=["page_id", "url", "digest", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return materialise(p.mapInArrow(write, INDEX), "index")


def joined_ranges(spans: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int]]:
    """Few (start, end) reads that cover the sorted (offset, length) spans: those at most `gap` apart are joined, up to `most` bytes."""
    out: list[tuple[int, int]] = []
    for start, length in spans:
        if out and start - out[-1][1] <= gap and start + length - out[-1][0] <= most:
            out[-1] = (out[-1][0], max(out[-1][1], start + length))
        else:
            out.append((start, start + length))
    return out


def read_records(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20, region: int = 64 << 20, payloads: bool = True) -> DataFrame:
    """The records (RECORDS) that the given index rows name, each once for each row. payloads: give those of responses too."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = index.select("file", "offset", "length").withColumn("region", F.floor(F.col("offset") / region)).repartition(parts, "file", "region")

    def read(table: pa.Table) -> pa.Table:
        spans = sorted(zip(table.column("offset").to_pylist(), table.column("length").to_pylist()))
        fs, path = filesystem(table.column("file")[0].as_py())
        rows, k = [], 0
        with fs.open_input_file(path) as f:
            for start, end in joined_ranges(spans, gap, most):
                data = f.read_at(end - start, start)
                while k < len(spans) and spans[k][0] + spans[k][1] <= end:
                    offset, length = spans[k]
                    found = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    if not payloads:
                        found["payload"] = None
                    elif found["payload"] is not None:
                        found["payload"] = found["payload"].decode()
                    rows.append(found)
                    k += 1
        return pa.Table.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string())]))

    return wanted.groupBy("file", "region").applyInArrow(read, RECORDS)
