"""Converter from legacy ARC archives to WARC, and the archive round trip.

An ARC file is a version block followed by records, each a header line whose
fields depend on the version, a declared length and that many bytes. The
converter trusts only declared lengths, never blank lines, and synthesises what
WARC wants besides: record ids, ISO timestamps, record types and digests.

Records are compressed one by one, a gzip member each, as WARC readers expect (a record
of 16 MB and more takes several). Spark's text writer puts members after one another, so
files go through Hadoop's commit protocol to any store that Spark can write: a member ends
in the highest byte of its length, which is zero below 16 MB, and that zero byte is the
writer's line separator. Files hold FILE_BYTES and a record more at most.

Which pages are revisits is found on ids, digests and sizes alone. Payloads that a
ten-thousandth of all pages share, of which there can't be more than ten thousand, are
looked up by broadcast, so their copies meet in no task; only pages that may be revisits are
then joined to their marks, by id and digest.

Nulls: a null html is an empty payload, a null url becomes about:blank, a null
page_id is kept and never referred to. Empty tables give empty results, repeated
rows one record each, other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm.common import cut, id_filter, maybe_in, scratch_path

#: Payloads below this size are never revisits.
LEAST_REVISIT = 100
#: Compressed bytes of a file, so that it fits into memory when read back.
FILE_BYTES = 32 << 20
#: Bytes of a gzip member's content at most; its length then ends in a zero byte.
MEMBER_BYTES = (1 << 24) - 1
LEVEL = 6
#: Payloads of this many pages, and of one in HOT_SHARE, are broadcast.
HOT_PAGES, HOT_SHARE = 1000, 10_000
RECORD_END = b"\r\n\r\n"
#: Fixed values of the ARC formats: header fields by version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


# ---- ARC ------------------------------------------------------------------


def arc_date(seconds: int) -> str:
    return datetime.fromtimestamp(seconds % (1 << 32), UTC).strftime("%Y%m%d%H%M%S")


def arc_head(version: int, name: str, origin: str = "relspark") -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} {1 if version == 2 else 0} {origin}\n{ARC_TITLES[version]}\n".encode()
    rest = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 {arc_date(0)} text/plain {rest}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, block: bytes, mime: str = "text/html", name: str = "-") -> bytes:
    url = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) or "about:blank"
    rest = "" if version == 1 else f"200 {hashlib.md5(block, usedforsecurity=False).hexdigest()} - 0 {name} "
    return f"{url} 0.0.0.0 {date} {mime} {rest}{len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file. The version block says which header fields follow;
    a record's block is exactly as long as its header declares."""
    at, version = 0, None
    view = memoryview(data)
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line at byte {at} isn't ended")
        line = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        if not line:  # the line feed between records
            at = end + 1
            continue
        parts = line.split(" ")
        if version is None:
            block = data[end + 1 : end + 1 + int(parts[-1])]
            version = int(block.split(b" ", 1)[0])
            if not line.startswith("filedesc:") or version not in ARC_FIELDS:
                raise ValueError(f"no ARC version block: {line[:80]}")
            at = end + 1 + len(block)
            continue
        names = ARC_FIELDS[version]
        if len(parts) != len(names):
            raise ValueError(f"an ARC {version} header has {len(names)} fields, not {len(parts)}: {line[:80]}")
        head = dict(zip(names, parts, strict=True))
        start, length = end + 1, int(head["length"])
        if start + length > len(data):
            raise ValueError(f"ARC record at byte {at} is cut short")
        yield head | {"version": version, "offset_in_file": at, "block": bytes(view[start : start + length])}
        at = start + length


# ---- WARC -----------------------------------------------------------------


def record_id(key: int | None, offset: int = 0) -> str:
    """A version 8 UUID (custom layout) whose last 62 and first 48 bits carry a
    signed 64-bit key, so that ids are unique, repeatable and can be read back."""
    value = 0 if key is None else key & ((1 << 64) - 1)
    high = (0x1 if key is None else 0x2) << 44 | offset % (1 << 40)
    return f"urn:uuid:{uuid.UUID(int=high << 80 | 8 << 76 | (value >> 62) << 64 | 2 << 62 | value & ((1 << 62) - 1))}"


def key_of(uri: str) -> int | None:
    number = uuid.UUID(uri.strip("<>").removeprefix("urn:uuid:")).int
    value = (number >> 64 & 3) << 62 | number & ((1 << 62) - 1)
    return None if number >> 124 == 1 else value - (1 << 64) if value >> 63 else value


def iso_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload; no header: all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def arc_to_warc(record: dict, key: int | None, refers_to: int | None = None) -> bytes:
    """The WARC record, without the final blank lines, for an ARC record. A
    revisit keeps the HTTP header alone; its digest and length still describe
    the payload that it had."""
    http, payload = split_http(record["block"])
    digest = hashlib.sha256(payload).hexdigest()
    kind = "response" if refers_to is None else "revisit"
    block = http if refers_to is not None else record["block"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id(key)}>",
        f"WARC-Date: {iso_date(record['date'])}",
        f"WARC-Target-URI: {record['url']}",
        f"WARC-IP-Address: {record['ip']}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{record_id(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if http else record['type']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.lower()] = value.strip()
        start = end + 4
        length = int(fields["content-length"])
        if start + length > len(data):
            raise ValueError(f"WARC record at byte {at} is cut short")
        yield fields, data[start : start + length]
        at = start + length + 4
    return


def gzip_members(record: bytes) -> bytes:
    """The record and its end as gzip members, the last byte (zero) of all left out."""
    whole = record + RECORD_END
    parts = [gzip.compress(whole[at : at + MEMBER_BYTES], LEVEL, mtime=0) for at in range(0, len(whole), MEMBER_BYTES)]
    return b"".join(parts)[:-1]


def read_members(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a file, a record in memory at a time."""
    view, at, held = memoryview(data), 0, b""
    while at < len(data):
        member, parts = zlib.decompressobj(wbits=31), []
        while not member.eof:
            chunk = view[at : at + (1 << 16)]
            if not len(chunk):
                raise ValueError("gzip member is cut short")
            parts.append(member.decompress(chunk))
            at += len(chunk) - len(member.unused_data)
        content = b"".join(parts)
        held += content
        if len(content) < MEMBER_BYTES:  # a full member is followed by the record's rest
            yield from parse_warc(held)
            held = b""
    if held:
        yield from parse_warc(held)


# ---- over tables ----------------------------------------------------------


def _slim(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.where(F.octet_length(payload) >= LEAST_REVISIT).select(F.col("page_id").cast("bigint").alias("page_id"), F.sha2(payload.cast("binary"), 256).alias("digest"))


def revisits(slim: DataFrame) -> DataFrame:
    """page_id, digest, first_id of the pages (slim: page_id, digest) that are revisits,
    each pair once. Counts are summed before the shuffle."""
    rows = cut(slim.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n")), "page-digests")
    groups = cut(rows.groupBy("digest").agg(F.sum("n").alias("n"), F.min("page_id").alias("first_id")).where((F.col("n") > 1) & F.col("first_id").isNotNull()), "page-groups")
    pages = rows.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= max(HOT_PAGES, pages // HOT_SHARE)
    hot = F.broadcast(groups.where(often).select("digest", F.col("first_id").alias("hot_id")))  # HOT_SHARE rows at most
    looked_up = rows.select("page_id", "digest").join(hot, "digest", "left")
    rare = looked_up.where(F.col("hot_id").isNull()).join(groups.where(~often).select("digest", "first_id"), "digest")
    found = looked_up.where(F.col("hot_id").isNotNull()).select("page_id", "digest", F.col("hot_id").alias("first_id")).union(rare.select("page_id", "digest", "first_id"))
    # A repeated page_id: all rows with the smallest id are responses.
    return found.where(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")))


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of the task's file, and a record's members; file by file."""
    file, size = 0, 0
    for batch in batches:
        out, files = [], []
        for key, url, html, first in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "html", "first_id")), strict=True):
            payload = (html or "").encode("utf-8", "surrogatepass")
            http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
            version = 1 + (key or 0) % 2
            name = f"pages-{version}.arc"
            legacy = arc_head(version, name) + arc_record(version, url or "", arc_date(key or 0), http + payload, name=name)
            for record in parse_arc(legacy):
                out.append(gzip_members(arc_to_warc(record, key, first)))
                size += len(out[-1]) + 1
                files.append(file)
                if size >= FILE_BYTES:
                    file, size = file + 1, 0
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(out, pa.binary())], ["file", "value"])


def write_archives(pages: DataFrame, path: str) -> None:
    """A WARC record per row of pages, in gzipped files below path."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    marks = cut(revisits(_slim(pages)), "revisits")
    # Other pages need no shuffle.
    touched = id_filter(marks.select(F.col("page_id").alias("id")))
    other = maybe_in(rows, touched, member=False, key="page_id").withColumn("first_id", F.lit(None).cast("bigint"))
    some = maybe_in(rows, touched, key="page_id").withColumn("digest", F.sha2(payload.cast("binary"), 256))
    mine = marks.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first_id")
    marked = some.join(mine, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "first_id")
    archives = other.union(marked).mapInArrow(_convert, "file int, value binary").select("file", F.col("value").cast("string").alias("value"))
    archives.write.partitionBy("file").option("lineSep", "\0").text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in read_members(content.as_buffer()):
                kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                size = int(fields["warc-x-payload-length"])
                if kind == "response":
                    payload = split_http(block)[1]
                    size, found = len(payload), hashlib.sha256(payload).hexdigest()
                    if found != said:
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                target = fields.get("warc-refers-to")
                rows.append((key_of(fields["warc-record-id"]), size, said, kind, None if target is None else key_of(target), fields["warc-target-uri"], fields["warc-date"]))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per WARC record, payload digests recomputed and compared."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)
