"""WARC archives that are read by their index.

Writing: each task writes gzip'd archives of its own, one member for each record, and hands on an
index row for each record: file, offset, length, URL, digest. The index is a table written by
Spark's committer, and is what makes records exist: an archive that a lost or repeated task left
behind is in no index row, and nobody reads it. Reading: the selected index rows are sorted by file and
offset, neighbouring ones are joined into one byte range, and each range is read once.

Archives are opened with pyarrow's file systems (local or mounted folders, HDFS, S3, GCS), so the
folder must be one that every executor reaches by its URI.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import Tables, small_batches, trim

INDEX = "file string, offset long, length long, url string, digest string, payload_bytes long, page_id long, record_type string, refers_to long"
_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

# Fixed values of the format.
VERSION, PROFILE, END = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"\r\n\r\n"


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1: 32 characters, no padding."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    """A URL as a header can hold it: blanks and control characters as percent codes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    """The page of such a name."""
    found = name.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "none" else int(found)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> tuple[bytes, str]:
    """(the record, its payload's digest). A revisit has the headers of its page, with the payload's length, and no payload."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END, digest


def parse(raw: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for a revisit) of one record. A record that contradicts its own length or digest raises an error."""
    head, _, rest = raw.partition(END)
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if lines[0] != VERSION or rest[len(block) :] != END:
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    http, _, payload = block.partition(END)
    size = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
    return {"page_id": _id(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _id(fields["warc-refers-to"]) if kind == "revisit" else None, "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None}


def _member(raw: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = 1 << 28, level: int = 6, date: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for each row under `path`, and its index, which is returned.

    Payloads are the pages' UTF-8 bytes (null: empty). Of records with equal payloads of
    `least_bytes` or more, that with the largest page_id is a response and the others revisit it. Rows of one page_id
    and payload are of one type, so several may be responses; rows without an id come before all ids, and are
    responses where no row of the payload has one. A null URL has no header. An empty table gives an empty index.
    Archives are closed beyond `file_bytes`. Only payloads that occur more than once are joined to
    the pages; their table is written first, so that Spark knows its size and can split a page that many rows share.
    """
    spark = pages.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), body.alias("payload")).withColumn("key", F.sha2("payload", 256))
    again = rows.where(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("times")).where("times > 1")
    known = rows.join(Tables(spark).put(again.select("key", "first", F.lit(True).alias("repeated")), "repeated"), "key", "left")
    revisit = F.coalesce("repeated", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    typed = known.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    at = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = f"{path.rstrip('/')}/archives"
    place(path)[0].create_dir(place(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = place(folder)
        out, name, offset = None, "", 0
        info = _member(f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {at}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0".encode() + END + END, level)
        for batch in batches:
            index = []
            for r in batch.to_pylist():
                if out is None:
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", len(info)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(info)
                raw, digest = record(r["page_id"], r["url"], r["payload"], r["refers_to"], r["revisit"], at)
                packed = _member(raw, level)
                out.write(packed)
                index.append({"file": name, "offset": offset, "length": len(packed), "url": r["url"], "digest": digest, "payload_bytes": len(r["payload"]), "page_id": r["page_id"], "record_type": "revisit" if r["revisit"] else "response", "refers_to": r["refers_to"]})
                offset += len(packed)
                if offset >= file_bytes:
                    out.close()
                    out = None
            if index:
                yield pa.RecordBatch.from_pylist(index, schema=_INDEX)
            trim()
        if out is not None:
            out.close()

    typed.mapInArrow(run, INDEX).write.parquet(f"{path.rstrip('/')}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path.rstrip('/')}/index")


#: Bytes of an archive that one task reads in a row, about.
STRIPE = 16 << 20


def ranges(rows: Iterator[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, begin, end, records) of (file, offset, length) in order: records of one file that lie no more than `gap` bytes apart, up to `most` bytes or one longer record."""
    file, begin, end, held = None, 0, 0, []
    for name, offset, length in rows:
        if held and (name != file or offset - end > gap or offset + length - begin > most):
            yield file, begin, end, held
            held = []
        if not held:
            file, begin, end = name, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield file, begin, end, held


def read_warc(index: DataFrame, path: str, gap: int = 1 << 16, most: int = 1 << 23, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows, each parsed and held against its length and digest; a row selected twice is read once and given twice.

    Rows are dealt by stripes of the archives, so that a task reads what lies together. A task holds a
    range of `most` bytes, or one longer record. No rows give no records. `with_payload=False` leaves payloads null.
    """
    small_batches(index.sparkSession)
    folder = f"{path.rstrip('/')}/archives"
    total = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(1, math.ceil(total / (STRIPE / 4)))
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / STRIPE)).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = place(folder)
        source, opened = None, None
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for file, begin, end, held in ranges(rows, gap, most):
            if file != opened:
                source, opened = store.open_input_file(f"{root}/{file}"), file
            source.seek(begin)
            raw = source.read(end - begin)
            if len(raw) != end - begin:
                raise ValueError(f"{file} ends before {end}")
            out = []
            for offset, length in held:
                found = parse(zlib.decompress(raw[offset - begin : offset - begin + length], 31))
                out.append(found if with_payload else found | {"payload": None})
            yield pa.RecordBatch.from_pylist(out, schema=_RECORDS)
            del raw, out
            trim()

    return dealt.mapInArrow(run, RECORDS)
