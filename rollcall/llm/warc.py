"""WARC archives: writer, and a sequential reader that decompresses member by member.

An archive is a row of a stage table, a name and the bytes of a .warc.gz file: one gzip
member per record, as the format has it.  Response records hold a whole HTTP message,
revisit records its header.  The reader feeds compressed bytes to zlib in small pieces,
starts a new decompressor at each member's end, takes messages and payloads by their
Content-Length and verifies their digests; a revisit's digest is held against that of the
record it refers to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollcall.stage import staged

#: An archive is closed once it has this many compressed bytes.
ARCHIVE_BYTES = 8 << 20
PIECE = 64 << 10
DATE = "1970-01-01T00:00:00Z"
ARCHIVE_SCHEMA = "archive string, warc binary"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


class WarcError(ValueError):
    """The archive is not what its headers say."""


def _record(headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(body)}\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode() + body + b"\r\n\r\n") + deflate.flush()


def _uri(value: str | None) -> str:
    """A header value on one line: what a URI can't hold as it is gets percent-encoded, what is encoded already stays."""
    encoded = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")
    return re.sub("%(?![0-9A-Fa-f]{2})", "%25", encoded)


#: Names of the records; rows without an id are told apart by their place.
NAME = "urn:page:"


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, kind: str, place: str = "") -> bytes:
    """The gzip member of one page.  A revisit record has the digest of the payload and the HTTP header, with the payload's length, but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    message = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{NAME}{f'none:{place}' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if kind == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{NAME}{first}>")]
    return _record(headers, message + (payload if kind == "response" else b""))


def _page_id(name: str) -> int | None:
    text = name.removeprefix(f"<{NAME}").removesuffix(">")
    return None if text.startswith("none:") else int(text)


def _http(body: bytes) -> tuple[int, bytes]:
    """The length that an HTTP message states and the payload that it has."""
    head, mark, payload = body.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    if not mark or not lines[0].startswith("HTTP/1.") or not fields.get("content-length", "").isdigit():
        raise WarcError("no HTTP message")
    return int(fields["content-length"]), payload


def _members(archive: memoryview) -> Iterator[bytes]:
    """Decompressed gzip members in turn."""
    at, rest = 0, b""
    while at < len(archive) or rest:
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest:
                if at >= len(archive):
                    raise WarcError("the archive ends within a member")
                rest, at = archive[at : at + PIECE], at + PIECE
            out.append(inflate.decompress(rest))
            rest = inflate.unused_data
        yield b"".join(out)


def read_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record in order, and as ``Payload-Length`` the length its message states; raises ``WarcError`` on a bad frame or digest."""
    for member in _members(memoryview(archive)):
        head, mark, rest = member.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not mark or not lines[0].startswith("WARC/1."):
            raise WarcError("no WARC header")
        headers = {k: v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(headers["Content-Length"])
        body = rest[:size]
        if len(body) != size or rest[size:] != b"\r\n\r\n":
            raise WarcError("the content length does not frame the record")
        size, payload = _http(body)
        headers["Payload-Length"] = str(size)
        if headers["WARC-Type"] == "response":
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if headers["WARC-Payload-Digest"] != f"sha1:{digest}" or len(payload) != size:
                raise WarcError("the payload digest does not verify")
        elif payload:
            raise WarcError("a revisit record with a payload")
        yield headers, payload


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, n, size, parts = TaskContext.get().partitionId(), 0, 0, []

    def archive() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{n:05d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], ["archive", "warc"])

    for batch in batches:
        for page_id, url, html, first, kind in zip(*(c for c in batch.columns)):
            parts.append(page_record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), first.as_py(), kind.as_py(), f"{part}.{n}.{len(parts)}"))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield archive()
                n, size, parts = n + 1, 0, []
    if parts:
        yield archive()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for blob in batch.column(1):
            rows: list[list] = [[] for _ in names]
            for headers, _ in read_records(blob.as_py()):
                kind = headers["WARC-Type"]
                values = (
                    _page_id(headers["WARC-Record-ID"]), int(headers["Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), kind,
                    _page_id(headers["WARC-Refers-To"]) if kind == "revisit" else None, headers["WARC-Target-URI"],
                )
                for column, value in zip(rows, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names)


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Archives of ``(page_id, url, html)`` rows as a stage table of ``(archive, warc)``.

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes, those with the
    smallest page_id are responses and the others revisit it.  A null html is an empty payload.  Pages
    without an id are responses; rows that repeat a response's id repeat the response, its
    record's name included.  A null url is an empty target.  A payload is held in memory by
    itself.  Other columns are not read; an empty table gives no archives.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = page.withColumn("digest", F.unhex(F.sha2(F.encode("html", "UTF-8"), 256)))
    firsts = keyed.where(F.octet_length("html") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"))
    roles = keyed.join(firsts, "digest", "left").select(
        "page_id", "url", "html", "first", F.when(F.col("page_id") > F.col("first"), "revisit").otherwise("response").alias("kind")
    )
    return staged(roles.mapInArrow(_write, ARCHIVE_SCHEMA), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of ``(archive, warc)`` rows.

    An archive that fails verification fails the job, as does a revisit whose digest or length is not
    that of the response it refers to, or which refers to none.  No archives give no records.
    """
    records = staged(archives.select("archive", "warc").mapInArrow(_read, RECORD_SCHEMA), "warc-records")
    key = [F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes"]
    responses = records.where("record_type = 'response' AND page_id IS NOT NULL").select(*key).distinct().withColumn("known", F.lit(True))
    known = F.col("refers_to").isNull() | F.coalesce("known", F.lit(False))
    checked = F.when(known, F.col("record_type")).otherwise(F.raise_error(F.lit("a revisit does not match the record it refers to")).cast("string"))
    joined = records.join(responses, ["refers_to", "payload_digest", "payload_bytes"], "left")
    return joined.select(*[checked.alias(c) if c == "record_type" else F.col(c) for c in records.columns])


#: The same records in DuckDB SQL; base32 from the hexadecimal digest, four characters from each five digits.
RECORDS_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
roles AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM roles
"""
