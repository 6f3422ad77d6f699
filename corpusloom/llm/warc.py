"""WARC archives: writer, and a reader that salvages what stands after damage.

The writer makes one gzip member per record and leaves the files to Spark's text
sink: rows are bytes, and the line separator is an empty gzip member, so that a
file is a plain sequence of members, committed like any other Spark output.

The reader takes whole files, of which the writer bounds the size; a task needs
memory for the largest file, and files of 2 GB and more cannot be read. Members and
plain records may follow each other. Where a member or a record fails its checks,
the reader keeps the records that decode before a member's break, goes on at the
nearer of the next member and the next version line that is sound, and logs the
bytes between as a quarantined gap.

Nulls and odd rows: a null html is an empty payload; a null url is written as an
urn of the page; a null page_id reads back as null and never is referred to;
repeated rows each give a record; extra columns are ignored; an empty table gives
archives without records and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import new_folder, stored

#: Payloads under this are never revisits.
LEAST_REVISIT = 100
#: Bytes of members that make a row of the sink, and rows of a file: 32 MB, and what the last record of each row adds.
ROW_BYTES = 2 << 20
ROWS_PER_FILE = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:x-page:"
VERSION = b"WARC/1."
MAGIC = b"\x1f\x8b\x08"
#: Bytes in which the headers of a record end, so that a search over many version lines stays linear.
HEADER_BYTES = 1 << 16
#: Bytes of payload per Arrow batch of the reader.
BATCH_BYTES = 4 << 20


def gzip_member(data: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


EMPTY_MEMBER = gzip_member(b"")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """The bytes of one response, or of one revisit if refers_to is not None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = f"{RECORD_URN}{'' if page_id is None else page_id}"
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else name
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_URN}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def with_roles(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, refers_to: the smallest id of equal payloads answers for the others.

    Only digests that occur more than once are gathered, without payloads.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    repeated = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .where((F.col("_n") > 1) & F.col("_first").isNotNull()).select("_digest", "_first")
    )
    repeated = stored(repeated, "warc-repeated")
    joined = rows.join(repeated, rows["digest"] == repeated["_digest"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, row_bytes: int = ROW_BYTES, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write rows of with_roles() below path as gzip members, one per record.

    Members are joined into rows of about row_bytes, so that a file of so many rows
    is bounded in bytes, whatever the size of pages, but for what one record adds.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = lambda x: None if pd.isna(x) else int(x)
        held, size = [], 0
        for rows in batches:
            for r in rows.astype({"page_id": "Int64", "refers_to": "Int64"}).itertuples(index=False):
                held.append(gzip_member(record(none(r.page_id), r.url, bytes(r.payload), r.digest, none(r.refers_to))))
                size += len(held[-1])
                if size >= row_bytes:
                    yield pd.DataFrame({"member": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"member": [b"".join(held)]})

    (
        pages.mapInPandas(pack, "member binary")
        .select(F.col("member").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", rows_per_file)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("ISO-8859-1"))
        .text(path)
    )


class Damaged(ValueError):
    pass


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at a place; raises Damaged if a check fails."""
    if not data.startswith(VERSION, at):
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", at, at + HEADER_BYTES)
    if head_end < 0:
        raise Damaged("headers do not end")
    lines = data[at:head_end].decode("utf-8", "surrogateescape").split("\r\n")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header has no colon")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit() or "warc-type" not in headers:
        raise Damaged("a header that every record has is missing")
    start, end = head_end + 4, head_end + 4 + int(length)
    if end > len(data) or data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the block does not end where its length says")
    return headers, data[start:end], end + 4


class Broken(Damaged):
    """A member that does not decode to its end; `front` is what decodes of it."""

    def __init__(self, reason: str, front: bytes):
        super().__init__(reason)
        self.front = front


def member_at(data: bytes, at: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member at a place; raises Broken if it does not decode with a right checksum."""
    unpacker = zlib.decompressobj(31)
    parts = []
    for chunk in range(at, len(data), 1 << 16):
        try:
            parts.append(unpacker.decompress(data[chunk : chunk + (1 << 16)]))
        except zlib.error as error:
            raise Broken(str(error), b"".join(parts) + _up_to_fault(data, at, chunk)) from None
        if unpacker.eof:
            return b"".join(parts), min(chunk + (1 << 16), len(data)) - len(unpacker.unused_data)
    raise Broken("the member does not end", b"".join(parts))


def _up_to_fault(data: bytes, at: int, chunk: int) -> bytes:
    """What the failing chunk of the member at a place gives, byte by byte, before its fault."""
    unpacker = zlib.decompressobj(31)
    for sound in range(at, chunk, 1 << 16):
        unpacker.decompress(data[sound : sound + (1 << 16)])
    parts = []
    try:
        for i in range(chunk, min(chunk + (1 << 16), len(data))):
            parts.append(unpacker.decompress(data[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(parts)


def plain_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """salvage() of bytes that are not compressed."""
    at, gap, size = 0, None, len(data)
    while at < size:
        try:
            headers, block, end = parse_record(data, at)
        except Damaged:
            gap = at if gap is None else gap
            at = data.find(VERSION, at + 1)
            if at < 0:
                break
            continue
        if gap is not None:
            yield gap, at - gap, None, b""
            gap = None
        yield at, end - at, headers, block
        at = end
    if gap is not None:
        yield gap, size - gap, None, b""


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """(offset, length, headers, block) of each sound record, and (offset, length, None, b"") of each gap.

    A file may hold gzip members and plain records in any order. Offsets are those of
    the file. Records of a member have the member's range, and so has a gap inside a
    member that decodes. Of a member that breaks, the records before the break have
    its range up to the next sound place, and that range is a gap too. After a
    failure the nearer of the next member and the next version line is tried; a
    member met in that search counts only if it holds a record or nothing at all, as
    payloads may be compressed themselves.
    """
    at, gap, size, saved = 0, None, len(data), []
    marks = dict.fromkeys((VERSION, MAGIC), 0)

    def nearest(begin: int) -> int:
        for mark, place in marks.items():
            if 0 <= place < begin:
                marks[mark] = data.find(mark, begin)
        return min((place for place in marks.values() if place >= 0), default=-1)

    def closed(end: int) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
        for place, headers, block in saved:
            yield place, end - place, headers, block
        yield gap, end - gap, None, b""

    while at < size:
        try:
            if data.startswith(VERSION, at):
                headers, block, end = parse_record(data, at)
                found = [(headers, block)]
            elif data.startswith(MAGIC[:2], at):
                content, end = member_at(data, at)
                found = [(headers, block) for _, _, headers, block in plain_records(content)]
                if gap is not None and content and all(headers is None for headers, _ in found):
                    raise Damaged("a member without records")
            else:
                raise Damaged("neither a member nor a version line")
        except Damaged as fault:
            gap = at if gap is None else gap
            if isinstance(fault, Broken):
                saved += [(at, headers, block) for _, _, headers, block in plain_records(fault.front) if headers is not None]
            at = nearest(at + 1)
            if at < 0:
                break
            continue
        if gap is not None:
            yield from closed(at)
            gap, saved = None, []
        for headers, block in found:
            yield at, end - at, headers, block
        at = end
    if gap is not None:
        yield from closed(size)


COLUMNS = (
    "file string, offset long, length long, record_type string, page_id long, target_uri string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)


def _page(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").removeprefix(RECORD_URN)
    return int(text) if text.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, and one of record_type "gap" per quarantined range, of all files below path.

    payload is what the record itself holds; payload_bytes and payload_digest are
    those that it declares for the full payload.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        rows, held = [], 0

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names, dtype=object)
            return out.astype({"offset": "int64", "length": "int64", "page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                for offset, length, headers, block in salvage(bytes(content)):
                    if headers is None:
                        rows.append((name, offset, length, "gap", None, None, None, None, None, None))
                    else:
                        head, _, payload = block.partition(b"\r\n\r\n")
                        declared = [x.split(b":")[1].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                        full = int(declared[0]) if declared and declared[0].isdigit() else len(payload)
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        kind = headers["warc-type"]
                        refers = _page(headers.get("warc-refers-to"))
                        rows.append((name, offset, length, kind, _page(headers.get("warc-record-id")), headers.get("warc-target-uri"), refers, full, digest, payload))
                        held += len(payload)
                    if held >= BATCH_BYTES or len(rows) >= 1000:
                        yield frame(rows)
                        rows, held = [], 0
        if rows:
            yield frame(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, COLUMNS)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as archives, read them back, and give what the archives hold of each page.

    Digest and size of a response are worked out from the payload read; those of a
    revisit are the ones it declares for the payload it refers to.
    """
    spark = pages.sparkSession
    path = path or new_folder(spark, "warc")
    write_archives(with_roles(pages), path)
    own = F.col("record_type") == "response"
    return (
        read_archives(spark, path)
        .where(F.col("record_type") != "gap")
        .select(
            "page_id",
            F.when(own, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
            F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
            "record_type",
            "refers_to",
        )
    )


#: DuckDB SQL for round_trip over pages.
ORACLE = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
