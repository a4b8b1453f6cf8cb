"""Conversion of legacy ARC archives to WARC, and reading WARC back.

An ARC file starts with a version block whose second line names the version. A version 1
header line has five fields (URL, IP address, date, type, length), a version 2 line ten (a
result code, checksum, location, offset and file name come before the length). The declared
length says where a record's content ends. From these the converter makes a WARC record: its
identifier from the archive's own key or from URL, date and content, its date from the
14-digit ARC date, its type from the URL's scheme, its digests from the content.

Archives are values of a binary column, of bounded size each, so Spark itself stores and
reads them in whatever file system the cluster has.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.arrow_rows import bounded_batches, map_batches
from kindred.plans.sizes import broadcast_if_small
from kindred.plans.stored import scratched, stored

#: An archive value is closed once it holds so many bytes.
ARCHIVE_BYTES = 4 << 20
#: Records that revisit others (some 150 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_REVISITS = 100_000

# The field lists of ARC version blocks, and WARC profile names.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_HEADER, TARGET_HEADER = "X-Archive-Key", "X-Archive-Refers-To-Key"


@dataclass(frozen=True)
class ArcRecord:
    version: int
    url: str
    ip: str
    date: str
    mime: str
    content: bytes


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(records: list[tuple[str, str, str, str, bytes]], version: int, name: str = "legacy.arc") -> bytes:
    """An ARC file of (url, ip, 14-digit date, type, content) records."""
    note = f"{version} 0 kindred\n{ARC_FIELDS[version]}\n\n".encode()
    extra = "200 - - 0 " + name + " " if version == 2 else ""
    out = [f"filedesc://{name} 0.0.0.0 19960101000000 text/plain {extra}{len(note)}\n".encode() + note + b"\n"]
    at = len(out[0])
    for url, ip, date, mime, content in records:
        middle = f"200 {sha1_base32(content)} - {at} {name} " if version == 2 else ""
        # header fields are separated by single spaces: none may hold white space itself
        line = f"{_field(url)} {ip} {date} {_field(mime)} {middle}{len(content)}\n".encode()
        out += [line, content, b"\n"]
        at += len(line) + len(content) + 1
    return b"".join(out)


def _field(s: str) -> str:
    return re.sub(r"[\s\x00-\x20]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), s) or "-"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, without its version block. Raises ValueError on a broken file."""
    end = data.index(b"\n")
    first = data[:end].split(b" ")
    size = int(first[-1])
    block = data[end + 1 : end + 1 + size]
    version = int(block.split(b" ", 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version} is unknown")
    width = len(ARC_FIELDS[version].split())
    at = end + 1 + size
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").split(" ")
        if len(line) != width:
            raise ValueError(f"{len(line)} fields where version {version} has {width}")
        size = int(line[-1])
        if end + 1 + size > len(data):
            raise ValueError("a declared length goes beyond the file")
        yield ArcRecord(version, line[0], line[1], line[2], line[3], data[end + 1 : end + 1 + size])
        at = end + 1 + size


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and body of an HTTP response; content without a head is all body."""
    if content.startswith(b"HTTP/") and (cut := content.find(b"\r\n\r\n")) >= 0:
        return content[: cut + 4], content[cut + 4 :]
    return b"", content


def http_header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def record_id(key: int | None, url: str, date: str, content: bytes) -> str:
    """A WARC identifier: of the key if there is one, else of what the record holds."""
    name = f"key {key}" if key is not None else f"{url} {date} {sha1_base32(content)}"
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}"


def warc_record(r: ArcRecord, identifier: str, refers_to: str | None, refers_to_key: int | None = None) -> bytes:
    """A WARC 1.1 record; with refers_to, a revisit without payload, which also names the target's key."""
    head, body = split_http(r.content)
    kind = "revisit" if refers_to else "response" if re.match(r"https?:", r.url) or head else "resource"
    block = head if refers_to else r.content
    d = (re.sub(r"\D", "", r.date) + "19960101000000"[len(re.sub(r"\D", "", r.date)) :])[:14]
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{identifier}>",
        "WARC-Date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "WARC-Target-URI": r.url,
        "WARC-IP-Address": r.ip,
        "WARC-Payload-Digest": f"sha1:{sha1_base32(body)}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
        "Content-Type": "application/http;msgtype=response" if head else r.mime,
        "Content-Length": str(len(block)),
    }
    if refers_to:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{refers_to}>"}
        if refers_to_key is not None:
            fields[TARGET_HEADER] = str(refers_to_key)
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a gzipped WARC."""
    while data:
        z = zlib.decompressobj(31)
        record = z.decompress(data)
        if not z.eof:
            raise ValueError("a WARC member ends early")
        data = z.unused_data
        cut = record.index(b"\r\n\r\n")
        lines = record[:cut].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield fields, record[cut + 4 : cut + 4 + int(fields["content-length"])]


# -- on DataFrames -------------------------------------------------------------------------


def legacy_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`archive binary`: ARC files of the pages, version 1 and 2 in turn, of about ARCHIVE_BYTES each.

    Null html is an empty payload, a null url "-"; the page's id goes into an HTTP header.
    """

    def pack(batches):
        held, size, turn = [], 0, 0
        for b in batches:
            for key, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body = (html or "").encode()
                mark = f"{KEY_HEADER}: {key}\r\n" if key is not None else ""
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(body)}\r\n\r\n".encode() + body
                day = (key or 0) % 28 + 1
                held.append((url or "-", "192.0.2.1", f"200401{day:02d}000000", "text/html", content))
                size += len(content)
                if size >= ARCHIVE_BYTES:
                    yield _binary([write_arc(held, 1 + turn % 2)])
                    held, size, turn = [], 0, turn + 1
        if held:
            yield _binary([write_arc(held, 1 + turn % 2)])

    return bounded_batches(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))).mapInArrow(pack, "archive binary")


def _binary(values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["archive"])


_PARSED = "key long, record string, digest string, version int, url string, ip string, date string, mime string, content binary"


def parsed_archives(archives: DataFrame) -> DataFrame:
    """The records of ARC archives (column archive), with key, WARC identifier and payload digest."""

    def parse(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in b.column(0).to_pylist():
            for r in read_arc(data or write_arc([], 1)):
                head, body = split_http(r.content)
                mark = http_header(head, KEY_HEADER)
                key = int(mark) if mark and re.fullmatch(r"-?\d{1,19}", mark) else None
                rows.append((key, record_id(key, r.url, r.date, r.content), sha1_base32(body), r.version, r.url, r.ip, r.date, r.mime, r.content))
        columns = list(zip(*rows, strict=True)) or [()] * 9
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _PARSED.split(", ")])

    return map_batches(archives.select("archive"), parse, _PARSED)


@scratched
def convert_archives(archives: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`archive binary`: gzipped WARC archives with the records of ARC archives, written to the shared folder.

    Of records with equal payloads of at least least_bytes bytes, that with the largest key is
    a response and the others revisit it. Records that repeat a key and payload are marked
    alike; records without key revisit if a keyed record has the payload, else are responses.
    """
    parsed = stored(parsed_archives(archives), "parsed")
    length = "octet_length(content) - if(startswith(content, X'485454502F'), coalesce(nullif(instr(decode(content, 'ISO-8859-1'), '\\r\\n\\r\\n'), 0) + 3, 0), 0)"
    facts = stored(parsed.select("key", "record", "digest", F.expr(length).alias("bytes")).distinct(), "facts")
    first = stored(facts.where((F.col("bytes") >= least_bytes) & F.col("key").isNotNull()).groupBy("digest").agg(F.max(F.struct("key", "record")).alias("top")), "first")
    later = facts.where(F.col("bytes") >= least_bytes).join(first, "digest").where(F.col("record") != F.col("top.record"))
    revisits = stored(later.select("record", "digest", F.col("top.record").alias("refers_to"), F.col("top.key").alias("refers_to_key")), "revisits")
    together = parsed.join(broadcast_if_small(revisits, BROADCAST_REVISITS), ["record", "digest"], "left")
    together = together.select("record", "refers_to", "refers_to_key", "version", "url", "ip", "date", "mime", "content")

    def pack(batches):
        held, size = [], 0
        for b in batches:
            for identifier, refers_to, target, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(gzip_member(warc_record(ArcRecord(*rest), identifier, refers_to, target)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield _binary([b"".join(held)])
                    held, size = [], 0
        if held:
            yield _binary([b"".join(held)])

    return stored(bounded_batches(together).mapInArrow(pack, "archive binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of WARC archives: key, record, record_type, url, date, payload_digest, payload_bytes, refers_to_key.

    payload_bytes of a revisit is what its HTTP head declares.
    """

    def parse(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in b.column(0).to_pylist():
            for f, block in read_warc(data or b""):
                head, body = split_http(block)
                declared = http_header(head, "Content-Length")
                size = int(declared) if f["warc-type"] == "revisit" and declared else len(body)
                digest = f["warc-payload-digest"].removeprefix("sha1:")
                if f["warc-type"] != "revisit" and digest != sha1_base32(body):
                    raise ValueError(f"digest of {f['warc-record-id']} does not match")
                mark = http_header(head, KEY_HEADER)
                rows.append((int(mark) if mark else None, f["warc-record-id"].strip("<>"), f["warc-type"], f["warc-target-uri"], f["warc-date"], digest, size, int(f[TARGET_HEADER.lower()]) if TARGET_HEADER.lower() in f else None))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = ["key", "record", "record_type", "url", "date", "payload_digest", "payload_bytes", "refers_to_key"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return map_batches(archives.select("archive"), parse, "key long, record string, record_type string, url string, date string, payload_digest string, payload_bytes long, refers_to_key long")
