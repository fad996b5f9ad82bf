"""Legacy archive converter: ARC files of either version into WARC files.

An ARC file opens with a version block that names the fields of its record
lines; each record line declares the length of the bytes that follow. The
converter reads records by those lengths and synthesises what WARC needs and
ARC lacks: identifiers (from the record's own content and place), ISO dates,
record types and SHA-1 digests. Of records with equal payloads the one with the
smallest key becomes the response and the others revisit it.

Archives are written and read by Spark's own sources, so they may lie in any
store that Spark reaches. One file holds at most ``CHUNK_BYTES`` of records (one
longer record has a file of its own); a task never holds more than a few files,
as batches are bounded in bytes.

Edge cases: a null payload is an empty one; a null key or URL gives null back;
keys may be of any type that a string can be cast to, and a null key ranks after
the others; with repeated rows the first in file order is the response; an empty
table gives empty archives; payloads are bytes of any kind and may contain
anything that looks like a header, as only lengths delimit records; one record
with its headers must fit in 2 GB, the bound of a value in Spark; further
columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.llm.common import dealt_join, fresh_path, materialise, small_batches, table

CHUNK_BYTES = 8_000_000
KEY_HEADER = b"X-Page-Id"
NO_URL = "urn:none:"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Field names that the version block of an ARC file declares (fixed values of the format).
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_EPOCH = datetime.datetime(2020, 1, 1)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- ARC -------------------------------------------------------------------


def arc_head(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 symweave\n".encode() + ARC_FIELDS[version] + b"\n"
    if version == 1:
        line = f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n"
    else:
        line = f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n"
    return line.encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, block: bytes, offset: int, name: str) -> bytes:
    if version == 1:
        line = f"{url} 0.0.0.0 {date} text/html {len(block)}\n"
    else:
        line = f"{url} 0.0.0.0 {date} text/html 200 {hashlib.md5(block).hexdigest()} - {offset} {name} {len(block)}\n"
    return line.encode() + block + b"\n"


def http_block(key: object, payload: bytes) -> bytes:
    own = b"" if key is None else KEY_HEADER + b": " + quote(str(key), safe="").encode() + b"\r\n"
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(fields, offset, block) of each record; the version block says which fields a record line has."""
    at, names = 0, ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"]
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").split(" ")
        first = values[0].startswith("filedesc:")
        size = int(values[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"record at {at} declares {size} bytes and has {len(block)}")
        if first:
            lines = block.split(b"\n")
            if int(lines[0].split(b" ")[0]) not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {lines[0]!r}")
            names = lines[1].decode().split(" ")
        # a URL may hold spaces in version 1: the other fields are counted from the right
        head, tail = values[: len(values) - len(names) + 1], values[len(values) - len(names) + 1 :]
        if not first:
            yield dict(zip(names, [" ".join(head), *tail], strict=True)), at, block
        at = end + 1 + size


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Header (with its blank line) and payload of an HTTP message; all is payload where there is no header."""
    cut = block.find(b"\r\n\r\n")
    return (block[: cut + 4], block[cut + 4 :]) if block.startswith(b"HTTP/") and cut >= 0 else (b"", block)


def header_value(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n"):
        if line[: len(name) + 1].lower() == name.lower() + b":":
            return line[len(name) + 1 :].strip()
    return None


def key_of(head: bytes) -> str | None:
    own = header_value(head, KEY_HEADER)
    return None if own is None else unquote(own.decode())


def file_table(files: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(files, pa.large_binary()).cast(pa.binary())], names=["value"])


def write_files(chunks: DataFrame, path: str) -> None:
    """Each row becomes one gzip file. The text writer puts out the bytes of a string as they are, and a cast from binary does not look at them."""
    chunks.select(F.col("value").cast("string")).write.option("compression", "gzip").option("maxRecordsPerFile", 1).option("zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write rows as ARC files, in version 1 and 2 by turns."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        name, version = f"part-{part:06d}-{number:04d}.arc", 1 + part % 2
        for batch in batches:
            for k, u, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                date = (_EPOCH + datetime.timedelta(seconds=zlib.crc32(str(k).encode()) % 150_000_000)).strftime("%Y%m%d%H%M%S")
                if not held:
                    held = [arc_head(name, version, date)]
                    size = len(held[0])
                address = NO_URL if u is None else quote(u, safe="%/:?#[]@!$&'()*+,;=~-._")
                record = arc_record(version, address, date, http_block(k, raw or b""), size, name)
                held.append(record)
                size += len(record)
                if size >= CHUNK_BYTES:
                    yield file_table([b"".join(held)])
                    number, held, size = number + 1, [], 0
                    name, version = f"part-{part:06d}-{number:04d}.arc", 1 + (part + number) % 2
        if held:
            yield file_table([b"".join(held)])

    write_files(pages.select(F.col(key).cast("string"), F.col(url).cast("string"), F.col(payload).cast("binary")).mapInArrow(run, "value binary"), path)


# ---- WARC ------------------------------------------------------------------


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def record_id(name: str, offset: int, url: str, date: str) -> str:
    """An identifier that any conversion of the same archive gives again."""
    return str(uuid.UUID(bytes=hashlib.sha1(f"{name}\n{offset}\n{url}\n{date}".encode()).digest()[:16], version=5))


def iso_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = b"".join(k + b": " + v + b"\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def arc_index(arcs: DataFrame, key_type: str = "long") -> DataFrame:
    """(path, pos, key, id, url, date, digest, size) of every ARC record, payloads left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                name = path.rsplit("/", 1)[-1]
                for fields, offset, block in arc_records(gzip.decompress(content.as_buffer())):
                    head, payload = http_parts(block)
                    rows.append((path, offset, key_of(head), record_id(name, offset, fields["URL"], fields["Archive-date"]), fields["URL"], fields["Archive-date"], base32_sha1(payload), len(payload)))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "pos", "key", "id", "url", "date", "digest", "size"])

    return arcs.mapInArrow(run, "path string, pos long, key string, id string, url string, date string, digest string, size long").withColumn("key", F.col("key").cast(key_type))


def revisits(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(path, again): for each archive file, the records that revisit another, with that other's identity."""
    rank = F.struct(F.col("key").isNull().alias("unkeyed"), "key", "path", "pos", "id", "url", "date")
    first = index.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = dealt_join(index, first, ["digest", "size"], ["path", "pos"]).where("path <> first.path or pos <> first.pos")
    return again.groupBy("path").agg(F.collect_list(F.struct("pos", F.col("first.id").alias("id"), F.col("first.url").alias("url"), F.col("first.date").alias("date"))).alias("again"))


def convert(arcs: DataFrame, again: DataFrame, path: str) -> None:
    """Write one WARC file for each ARC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content, others in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                origin = {r["pos"]: r for r in others or ()}
                name = source.rsplit("/", 1)[-1]
                out: list[bytes] = []
                for fields, offset, block in arc_records(gzip.decompress(content.as_buffer())):
                    url, date = fields["URL"], fields["Archive-date"]
                    if not out:
                        note = b"software: symweave\r\nformat: WARC File Format 1.1\r\n"
                        out.append(warc_record([(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", b"<urn:uuid:%s>" % record_id(name, -1, "", "").encode()), (b"WARC-Date", iso_date(date).encode()), (b"Content-Type", b"application/warc-fields")], note))
                    head, payload = http_parts(block)
                    of = origin.get(offset)
                    kept = head if of else block
                    rows = [
                        (b"WARC-Type", b"revisit" if of else b"response"),
                        (b"WARC-Record-ID", b"<urn:uuid:%s>" % record_id(name, offset, url, date).encode()),
                        (b"WARC-Target-URI", url.encode()),
                        (b"WARC-Date", iso_date(date).encode()),
                        (b"WARC-IP-Address", fields["IP-address"].encode()),
                        (b"WARC-Payload-Digest", b"sha1:" + base32_sha1(payload).encode()),
                        (b"WARC-Block-Digest", b"sha1:" + base32_sha1(kept).encode()),
                        (b"Content-Type", b"application/http; msgtype=response"),
                    ]
                    if of:
                        rows += [
                            (b"WARC-Profile", REVISIT_PROFILE),
                            (b"WARC-Refers-To", b"<urn:uuid:%s>" % of["id"].encode()),
                            (b"WARC-Refers-To-Target-URI", of["url"].encode()),
                            (b"WARC-Refers-To-Date", iso_date(of["date"]).encode()),
                        ]
                    out.append(warc_record(rows, kept))
                if out:
                    yield file_table([b"".join(out)])

    write_files(arcs.join(again, "path", "left").select("path", "content", "again").mapInArrow(run, "value binary"), path)


def warc_records(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(b": ", 1) for line in data[at:end].split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        if len(data) < end + 4 + size:
            raise ValueError(f"record at {at} declares {size} bytes")
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """(key, id, url, record_type, payload_bytes, payload_digest, refers_to_id) of each record but warcinfo."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for fields, block in warc_records(gzip.decompress(content.as_buffer())):
                    kind = fields[b"WARC-Type"].decode()
                    if kind == "warcinfo":
                        continue
                    head, payload = http_parts(block)
                    declared = header_value(head, b"Content-Length")
                    size = len(payload) if kind == "response" else int(declared or 0)
                    digest = base32_sha1(payload) if kind == "response" else fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
                    if fields[b"WARC-Payload-Digest"] != b"sha1:" + digest.encode() or fields[b"WARC-Block-Digest"] != b"sha1:" + base32_sha1(block).encode():
                        raise ValueError("digest of a record does not match its bytes")
                    url = fields[b"WARC-Target-URI"].decode()
                    refers = fields.get(b"WARC-Refers-To")
                    rows.append((key_of(head), fields[b"WARC-Record-ID"].decode(), None if url == NO_URL else unquote(url), kind, size, digest, None if refers is None else refers.decode()))
                if rows:
                    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to_id"])

    found = read_files(spark, path).mapInArrow(run, "key string, id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to_id string")
    return found.withColumn("key", F.col("key").cast(key_type))


def convert_archives(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0, key_type: str = "long") -> None:
    """Convert a folder of ARC files into a folder of WARC files; ``key_type`` gives the order of the keys."""
    small_batches(spark)
    arcs = read_files(spark, arc_path)
    convert(arcs, materialise(revisits(materialise(arc_index(arcs, key_type), "arc-index"), least_bytes), "revisits"), warc_path)


def op1_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), arc)
    convert_archives(spark, arc, warc)
    found = materialise(read_warc(spark, warc), "warc-index")
    names = found.where("record_type = 'response'").select(F.col("id").alias("refers_to_id"), F.col("key").alias("refers_to"))
    plain = found.where("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long"))
    linked = dealt_join(found.where("refers_to_id is not null"), names, ["refers_to_id"], ["id"], "left")
    columns = [F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return plain.select(*columns).unionByName(linked.select(*columns))


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p),
b AS (
  SELECT page_id, n, h, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(j // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (j % 4))) & 31 AS INTEGER) + 1, 1)), '') AS digest FROM d),
f AS (SELECT h, n, min(page_id) AS first_id FROM b GROUP BY h, n)
SELECT page_id, CAST(b.n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b JOIN f ON b.h = f.h AND b.n = f.n
"""
