"""Operator 4: WARC archives, and a normaliser for monolithic gzip.

``write_archives`` makes whole-file gzip archives: one gzip stream over all records of an archive, as many crawlers
leave them.  ``normalise`` inflates such a stream once, rewrites every record as a gzip member of its own and makes a
sidecar index of members, so that one record can be read without the others.  ``read_records`` reads by that index.

Archives are rows (name, content) of a Parquet table in shared storage, of about ``ARCHIVE_BYTES`` of records each, so
every store that Spark can write serves and a lost executor costs one task; the index is a column of the same table,
read apart from the contents.  ``normalise_stream`` does the same for open files and is what the tasks run;
``export_files`` writes normalised archives as ``.warc.gz`` files, each with its index beside it, to a mounted folder.

Equal payloads are stored once: the record of the largest page_id is the response, the others are revisits that refer
to it, with digest and length of the full payload.  Payloads shorter than ``min_bytes`` are always responses.

Defined results: null html is an empty payload; of repeated rows of the largest page_id one is the response (the least url); a null page_id
is written as such and is a response only if no equal payload has an id; a null url has no target header, control
characters in urls are percent-encoded; pages of any length are written whole; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, ship, stored
from .textkit import slices

ARCHIVE_BYTES, LEVEL, CHUNK = 16 << 20, 5, 1 << 18
INDEX = "array<struct<offset:bigint,length:bigint,record_id:string,record_type:string,uri:string,digest:string>>"
DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = DATE) -> bytes:
    """A response record, or a revisit that carries the HTTP head but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest32(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a readable gzip stream (one member or many), inflated once, piece by piece."""
    inflate, buffer, eof = zlib.decompressobj(31), bytearray(), False
    need = None  # (head length, whole length) of the record at the buffer's start
    while True:
        if need is None and (end := buffer.find(b"\r\n\r\n")) >= 0:
            head = parse_head(bytes(buffer[:end]))
            need = (head, end + 4, end + 4 + int(head["content-length"]) + 4)
        if need is not None and len(buffer) >= need[2]:
            head, _, whole = need
            yield head, bytes(buffer[:whole])
            del buffer[:whole]
            need = None
            continue
        raw = inflate.unconsumed_tail or (inflate.unused_data if inflate.eof else b"") or stream.read(CHUNK)
        if inflate.eof and raw:
            inflate = zlib.decompressobj(31)
        eof = not raw
        if eof:
            if buffer:
                raise ValueError("the archive ends inside a record")
            return
        buffer += inflate.decompress(raw, CHUNK)


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def normalise_stream(source, target, level: int = LEVEL) -> list[dict]:
    """Rewrite an archive with a gzip member for each record; returns the index of the members written."""
    index, at = [], 0
    for head, raw in records(source):
        member = gzip_member(raw, level)
        target.write(member)
        index.append({
            "offset": at, "length": len(member), "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"),
            "uri": head.get("warc-target-uri"), "digest": head.get("warc-payload-digest"),
        })
        at += len(member)
    return index


def read_member(content, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Head and block of the one record at an index entry."""
    raw = zlib.decompress(content[offset : offset + length], 31)
    end = raw.index(b"\r\n\r\n")
    head = parse_head(raw[:end])
    return head, raw[end + 4 : end + 4 + int(head["content-length"])]


def _write_task(archive_bytes: int, level: int):
    def run(batches):
        where = TaskContext.get().partitionId() if TaskContext.get() else 0
        z, parts, size, serial = None, [], 0, 0

        def archive():
            return pa.record_batch([pa.array([f"pages-{where:06d}-{serial:05d}.warc.gz"]), pa.array([b"".join([*parts, z.flush()])], pa.binary())], ["name", "content"])

        for b in slices(batches, "html"):
            cols = (b.column(c).to_pylist() for c in ("page_id", "url", "html", "rep", "revisit"))
            for page, url, html, rep, revisit in zip(*cols, strict=True):
                z = z or zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = record(page, url, (html or "").encode(), rep, revisit)
                parts.append(z.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    yield archive()
                    z, parts, size, serial = None, [], 0, serial + 1
        if z is not None:
            yield archive()

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as monolithic archives to ``path``; returns the archives as read back."""
    ship(texts=True)
    src = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    src = src.withColumn("key", F.concat(F.sha2("html", 256), F.octet_length("html").cast("string")))
    pages_of = src.select("key", "page_id").groupBy("key", "page_id").agg(F.count("*").alias("rows"))
    reps = pages_of.groupBy("key").agg(F.max(F.struct("page_id", "rows")).alias("top")).select("key", F.col("top.page_id").alias("rep"), F.col("top.rows").alias("rows"))
    reps = stored(reps, "payloads")
    marked = src.join(reps, "key").withColumn("nth", F.lit(1))
    if reps.where("rep is not null and rows > 1").limit(1).count():
        # of repeated rows of the largest page_id one is the response: these few rows are numbered
        tied = F.col("page_id").isNotNull() & (F.col("page_id") == F.col("rep")) & (F.col("rows") > 1)
        tied = F.coalesce(tied, F.lit(False)) & (F.octet_length("html") >= min_bytes)
        numbered = marked.where(tied).withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.col("url").asc_nulls_first())))
        marked = marked.where(~tied).union(numbered)
    revisit = (F.octet_length("html") >= min_bytes) & F.col("rep").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("rep")) | (F.col("nth") > 1))
    out = marked.select("page_id", "url", "html", "rep", revisit.alias("revisit"))
    out.mapInArrow(_write_task(archive_bytes, level), "name string, content binary").write.parquet(path)
    return pages.sparkSession.read.schema("name string, content binary").parquet(path)


def normalise(archives: DataFrame, path: str, level: int = LEVEL) -> DataFrame:
    """Normalise archives of any gzip layout to ``path``: (name, content, index)."""
    ship(texts=True)
    entry = pa.struct([("offset", pa.int64()), ("length", pa.int64()), *((k, pa.string()) for k in ("record_id", "record_type", "uri", "digest"))])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                out = io.BytesIO()
                index = normalise_stream(pa.BufferReader(b.column("content")[i].as_buffer()), out, level)
                cols = [b.column("name").slice(i, 1), pa.array([out.getvalue()], pa.binary()), pa.array([index], pa.list_(entry))]
                yield pa.record_batch(cols, ["name", "content", "index"])

    schema = f"name string, content binary, index {INDEX}"
    archives.select("name", "content").mapInArrow(run, schema).write.parquet(path)
    return archives.sparkSession.read.schema(schema).parquet(path)


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_records(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of normalised archives, read member by member through the index."""
    ship(texts=True)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                content, name, rows = memoryview(b.column("content")[i].as_buffer()), b.column("name")[i].as_py(), []
                for e in b.column("index")[i].as_py():
                    head, block = read_member(content, e["offset"], e["length"])
                    cut = block.index(b"\r\n\r\n") + 4
                    said = head["warc-payload-digest"].removeprefix("sha1:")
                    length = int(parse_head(block[: cut - 4])["content-length"])
                    if head["warc-type"] == "response":
                        length, found = len(block) - cut, digest32(block[cut:])
                        if found != said:
                            raise ValueError(f"{name}: the payload of {head['warc-record-id']} doesn't have its digest")
                    rows.append((
                        _page(head["warc-record-id"]), length, said, head["warc-type"], _page(head.get("warc-refers-to")), name, e["offset"], e["length"],
                        *([block[cut:] if head["warc-type"] == "response" else None] * payloads),
                    ))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length", "payload"]
                if cols:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names[: len(cols)])

    return archives.select("name", "content", "index").mapInArrow(run, schema + (", payload binary" if payloads else ""))


def export_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write normalised archives as files to a folder that every executor has mounted: ``name`` and ``name.idx``, a line
    of JSON for each record.  Files are renamed when whole, so a task that runs again does no harm; returns (name, bytes)."""
    ship(texts=True)

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for i, (name, index) in enumerate(zip(b.column("name").to_pylist(), b.column("index").to_pylist(), strict=True)):
                content = b.column("content")[i].as_buffer()
                lines = "".join(json.dumps(e) + "\n" for e in index).encode()
                for path, data in ((f"{folder}/{name}.idx", lines), (f"{folder}/{name}", content)):
                    part = f"{path}.{uuid.uuid4().hex}"
                    with open(part, "wb") as f:
                        f.write(data)
                    os.replace(part, path)
                yield pa.record_batch([pa.array([name]), pa.array([len(content)], pa.int64())], ["name", "bytes"])

    return archives.select("name", "content", "index").mapInArrow(run, "name string, bytes long")


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/moraine/warc-{uuid.uuid4().hex}"
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{base}/monolithic")
    read = read_records(normalise(archives, f"{base}/members"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has sha1 as hex; base 32 of its 160 bits is spelled out, five bits a letter.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS rep,
  row_number() OVER (PARTITION BY html, page_id) AS nth FROM p),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: lpad(bin(instr('0123456789abcdef', hex[i + 1]) - 1), 4, '0')), '') AS bits FROM r)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    CAST(list_sum(list_transform(range(5), lambda j: CAST(bits[5 * i + j + 1] AS INT) * CAST(pow(2, 4 - j) AS INT))) AS INT) + 1]), '') AS payload_digest,
  CASE WHEN rep IS NULL OR page_id = rep AND nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN rep IS NULL OR page_id = rep AND nth = 1 THEN NULL ELSE rep END AS refers_to
FROM b
"""
