"""Web archives, index first.

Writing appends one gzip member per record to files in a shared folder and returns an index row per
record: file, offset, length, URL and digest.  Reading takes any selection of index rows, orders them by
file and offset, coalesces neighbouring byte ranges into single reads of bounded size, and parses the
records found there.

A record whose payload has at least `least` bytes and equals others' is written once, as the response
of the largest page_id; the others are revisits that hold no payload.  Writers that are run again leave
files that no index row names.

A URL with blanks or control characters is percent-encoded as target URI and kept as given in a header of its own.

Null html is an empty payload, a null url leaves out the target URI, a null page_id leaves out the id and
is never the largest.  Rows equal in page_id and payload are equal records (all responses if theirs is the
largest id).
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path

LEAST = 1000
FILE_BYTES = 1 << 30  # a new file begins beyond this
READ_BYTES, GAP_BYTES = 8 << 20, 64 << 10  # largest coalesced read; largest gap read over
TASK_BYTES = 64 << 20  # archive bytes that a reading task has, about
INDEX = "page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_SPACE = uuid.UUID("5a0a2a4e-6c1f-4f5e-9d5c-8f2a41d0c7b1")


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def _record(page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member of its own."""
    revisit = refers_to is not None
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
        head.append(("WARC-Target-URI", target))
        if target != url:  # as given
            head.append(("X-Page-URL", json.dumps(url)))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    head.append(("X-Payload-Length", str(size)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(lines.encode() + block + b"\r\n\r\n") + z.flush()


def _parse(raw: bytes) -> dict:
    """A record as a row of RECORD; the payload's digest is checked."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    said = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind, number = fields["WARC-Type"], lambda k: int(fields[k]) if k in fields else None
    if kind == "response" and hashlib.sha1(payload).hexdigest() != said:
        raise ValueError(f"digest of {fields['WARC-Record-ID']} is wrong")
    return {
        "page_id": number("X-Page-ID"), "url": json.loads(fields["X-Page-URL"]) if "X-Page-URL" in fields else fields.get("WARC-Target-URI"), "payload_bytes": len(payload) if kind == "response" else number("X-Payload-Length"),
        "payload_digest": said, "record_type": kind, "refers_to": number("X-Refers-To-Page"), "payload": payload if kind == "response" else None,
    }


def write_archive(pages: DataFrame, root: str | None = None, least: int = LEAST) -> DataFrame:
    """Write pages (page_id, url, html) and return the index, one row per record."""
    root = root or new_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"))
    rows = rows.select("page_id", "url", "html", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("payload_bytes"))
    first = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null").drop("_n")
    rows = rows.join(first, "digest", "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    rows = rows.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "digest", "payload_bytes", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(root)
        fs.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                made = []
                for r in batch.to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    raw = _record(r["page_id"], r["url"], (r.pop("html") or "").encode(), r["payload_bytes"], r["digest"], r["refers_to"])
                    out.write(raw)
                    made.append(r | {"record_type": "response" if r["refers_to"] is None else "revisit", "file": name, "offset": at, "length": len(raw)})
                    at += len(raw)
                yield pa.RecordBatch.from_pylist(made, schema=_schema(INDEX))
        finally:
            if out is not None:
                out.close()

    index = materialize(rows.mapInArrow(write, INDEX), "warc-index")
    index._warc_root = root
    return index


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def read_archive(selected: DataFrame, root: str) -> DataFrame:
    """The records that rows of an index point to.  Tasks are dealt by the bytes to be read, not by the index's size."""
    spark = selected.sparkSession
    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_BYTES))
    rows = selected.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(root)
        source, name = None, None

        def fetch(name_: str, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
            nonlocal source, name
            if name_ != name:
                if source is not None:
                    source.close()
                source, name = fs.open_input_file(f"{folder}/{name_}"), name_
            begin = ranges[0][0]
            data = source.read_at(ranges[-1][0] + ranges[-1][1] - begin, begin)
            return pa.RecordBatch.from_pylist([_parse(data[o - begin : o - begin + n]) for o, n in ranges], schema=_schema(RECORD))

        held, of = [], None
        for batch in batches:
            for f, o, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (f != of or o - sum(held[-1]) > GAP_BYTES or o + n - held[0][0] > READ_BYTES):
                    yield fetch(of, held)
                    held = []
                of = f
                held.append((o, n))
        if held:
            yield fetch(of, held)
        if source is not None:
            source.close()

    return rows.mapInArrow(read, RECORD)
