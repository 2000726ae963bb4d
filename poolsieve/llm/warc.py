"""WARC archives: a writer through Spark's text sink, and a reader that salvages damaged archives.

Writer: records are built by DataFrame functions and each is compressed as a gzip member of its own, so that damage costs the records it hits and no other.
The sink's line separator is the zero byte that ends a member (the highest byte of its length), so the part files are ordinary
``.warc.gz`` content on any store Spark can write to. Uncompressed, the separator is a record's closing CRLF CRLF. Payloads
that repeat are written once (``response``); the others become ``revisit`` records.

Reader: files are parsed record by record. Each record is
checked (version line, header, length, terminator, block and payload digest). After a failed check the
reader searches for the next gzip member or version line, goes on there, and logs the bytes between as a
quarantined gap. A failed record whose length leads to a sound end and the next record goes as a whole; otherwise records found where its block should be are told as
``doubtful``: they may have been part of its payload. Plain records and gzip members, of one record or of many, are read; of a damaged member, what can be inflated before the
damage is read, to the byte. A file is one row of Spark's binary source, 2 GB at most, and is read by one task; the writer's files are of some TARGET_BYTES.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
BEGIN = re.compile(VERSION.pattern + b"|" + re.escape(MEMBER))
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
TARGET_BYTES = 16 << 20
RECORD_SCHEMA = (
    "file string, offset long, length long, status string, record_type string, page_id long, uri string, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary, reason string"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    doubtful: bool = False


UNENDED, DAMAGED, CHECK = "record without end", "damaged gzip member", "gzip member fails its check"


#: A header is no longer than this; beyond it a version line was none.
HEADER_BYTES = 1 << 20


class Broken(ValueError):
    """A record that fails a check; ``end``: where its length says that it ends, if it has one."""

    def __init__(self, reason: str, end: int | None = None) -> None:
        super().__init__(reason)
        self.end = end


class Ahead:
    """The next place of a pattern, remembered: places asked for rise, so that a file is searched once."""

    def __init__(self, data: bytes, pattern: re.Pattern[bytes]) -> None:
        self.data, self.pattern, self.asked, self.hit = data, pattern, 0, -1

    def after(self, at: int) -> int:
        if not self.asked <= at <= self.hit:
            found = self.pattern.search(self.data, at)
            self.asked, self.hit = at, found.start() if found else len(self.data)
        return self.hit


def parse_record(data: bytes, at: int) -> tuple[Record, int]:
    """The record that begins at ``at`` and where it ends; raises Broken."""
    if not (start := VERSION.match(data, at)):
        raise Broken("no version line")
    headers: dict[str, str] = {}
    first = start.end()
    while True:
        stop = data.find(b"\r\n", first, at + HEADER_BYTES)
        if stop < 0:
            raise Broken(UNENDED if len(data) < at + HEADER_BYTES else "header too long")
        line, first = data[first:stop], stop + 2
        if not line:
            break
        name, colon, value = line.partition(b":")
        if not colon or not name.strip() or b"\n" in line:
            raise Broken("malformed header line")
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        raise Broken("no content length")
    last = first + int(headers["content-length"])
    if data[last : last + 4] != b"\r\n\r\n":
        raise Broken(UNENDED if last + 4 > len(data) else "no terminator where the length says", last + 4)
    block = data[first:last]
    said = headers.get("warc-block-digest", "")
    if said and said != f"sha1:{base32_sha1(block)}":
        raise Broken("block digest differs", last + 4)
    return Record(at, last + 4 - at, headers, block), last + 4


def inflate_member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What can be inflated of the gzip member that begins at ``at``; where it ends, or where its damage shows; what is wrong, if anything is.

    A step that fails is taken again in halves, down to the byte that fails."""
    inflate, inner, step = zlib.decompressobj(31), [], 1 << 16
    while at < len(data):
        before = inflate.copy() if step > 1 else None
        try:
            inner.append(inflate.decompress(data[at : at + step]))
        except zlib.error as e:
            if step == 1:
                return b"".join(inner), at, CHECK if "incorrect" in str(e) else DAMAGED
            inflate, step = before, step // 2
            continue
        at = min(at + step, len(data))
        if inflate.eof:
            return b"".join(inner), at - len(inflate.unused_data), ""
    return b"".join(inner), len(data), DAMAGED


def _inflated(data: bytes, at: int) -> tuple[list[Record | tuple[int, int, str]], int, str]:
    """What the member that begins at ``at`` holds, where its sound part ends, and what is wrong with it. A record that one member does
    not end goes on in the next."""
    begin, inner = at, b""
    while True:
        more, end, wrong = inflate_member(data, at)
        inner += more
        found = list(salvage(inner, (begin, end - begin)))
        if wrong:
            # a record's digest vouches for its block, a member's check for its headers as well: if it fails, a single record goes
            records = [x for x in found if isinstance(x, Record) and "warc-block-digest" in x.headers]
            return ([] if wrong == CHECK and len(records) < 2 else records), end, wrong
        # does the record that has no end here go on in the next member, which then begins with no version line?
        if not (found and isinstance(found[-1], tuple) and found[-1][2] == UNENDED and data.startswith(MEMBER, end)):
            return found, end, ""
        if not (head := _head(data, end)) or VERSION.match(head):
            return found, end, ""
        at = end


def _head(data: bytes, at: int) -> bytes:
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 4096], 64)
    except zlib.error:
        return b""


def salvage(data: bytes, inside: tuple[int, int] | None = None) -> Iterator[Record | tuple[int, int, str]]:
    """All sound records of an archive, and (offset, length, reason) of each gap between them.

    A gzip member may hold one record or many. Of a damaged member, the records before the damage are
    recovered; the gap begins where the damage shows, or with the member if nothing in it was sound. ``inside``: the place of the member that
    ``data`` was inflated from, told instead of places in ``data``. Records that begin before a failed one should end, or after one of unknown (or
    impossible) length without a terminator before them, are ``doubtful``.
    """
    at, gap, reason = 0, None, ""
    begins = Ahead(data, VERSION if inside else BEGIN)
    block, unsure = 0, False  # a failed record's block goes on to here; or nobody knows
    while at < len(data):
        found: list[Record | tuple[int, int, str]] = []
        whole = None
        try:
            if not inside and data.startswith(MEMBER, at):
                found, end, wrong = _inflated(data, at)
            else:
                record, end = parse_record(data, at)
                found, wrong = [record], ""
                record.doubtful = at < block or (unsure and data[at - 4 : at] != b"\r\n\r\n")
                unsure = unsure and record.doubtful
                if inside:
                    record.offset, record.length = inside
        except Broken as e:
            end, wrong = at, str(e)
            if e.end is None or e.end > len(data):
                unsure = unsure or bool(VERSION.match(data, at))
            elif at >= block and data[e.end - 4 : e.end] == b"\r\n\r\n" and (e.end == len(data) or BEGIN.match(data, e.end)):
                whole = e.end
            else:
                block = max(block, e.end)
        if gap is not None and (found or not wrong):
            yield (*(inside or (gap, at - gap)), reason)
            gap = None
        yield from found
        if wrong:
            later = begins.after(at + 1) if whole is None else whole
            if gap is None:
                gap, reason = min(end, later) if found else at, wrong
            at = later
        else:
            at = end
    if gap is not None:
        yield (*(inside or (gap, len(data) - gap)), reason)


def read_rows(name: str, data: bytes) -> Iterator[dict]:
    """The rows of RECORD_SCHEMA for one archive."""
    empty = dict.fromkeys(x.split()[0] for x in RECORD_SCHEMA.split(", "))
    for x in salvage(data):
        if isinstance(x, tuple):
            yield empty | {"file": name, "offset": x[0], "length": x[1], "status": "gap", "reason": x[2]}
            continue
        h = x.headers
        row = empty | {"file": name, "offset": x.offset, "length": x.length, "status": "doubtful" if x.doubtful else "record", "record_type": h.get("warc-type"), "uri": h.get("warc-target-uri")}
        row["page_id"] = page_of(h.get("warc-record-id", ""))
        row["refers_to"] = page_of(h.get("warc-refers-to", ""))
        row["payload_digest"] = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if row["record_type"] == "response":
            payload = x.block.partition(b"\r\n\r\n")[2]
            if row["payload_digest"] and base32_sha1(payload) != row["payload_digest"]:
                row |= {"status": "gap", "reason": "payload digest differs"}
            row |= {"payload": payload, "payload_bytes": len(payload)}
        elif h.get("x-payload-length", "").isdigit():
            row["payload_bytes"] = int(h["x-payload-length"])
        yield row


def page_of(record_id: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", record_id)
    return int(m[1]) if m else None


# fixed values: the alphabet of base32 (RFC 4648)
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(hexed: Column) -> Column:
    """Base32 of a 160-bit hex digest: eight groups of 5 hex digits are 4 characters of 5 bits each."""
    bits = lambda i, k: F.shiftright(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int"), 15 - 5 * k).bitwiseAND(F.lit(31))
    return F.concat(*[F.substring(F.lit(BASE32), bits(i, k) + 1, F.lit(1)) for i in range(8) for k in range(4)])


def archive_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One column ``value`` holding each page's record without its terminator.

    Of pages with equal payloads of ``min_bytes`` or more, the one with the largest page_id is the
    response and others revisit it; smaller payloads are all responses. Null html is an empty payload.
    A repeated row of the largest page_id is a response too; a page_id of null sorts below all others and
    is written without a page id. Digests are grouped with map-side combination (one row a distinct
    payload); the join to them is an equi-join that adaptive execution may split on a hot payload.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("html"))
    base = base.withColumn("sha", F.sha1(F.encode("html", "utf-8"))).withColumn("n", F.octet_length("html").cast("long"))
    first = base.groupBy("sha", "n").agg(F.max("page_id").alias("first"))
    row = base.join(first, ["sha", "n"])
    revisit = (F.col("n") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    row = row.withColumn("revisit", revisit).withColumn("digest", base32_of_hex(F.col("sha")))
    block = F.when(F.col("revisit"), F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), F.col("html")))
    row = row.withColumn("block", block).withColumn("size", F.octet_length("block"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(page(F.col("page_id")), F.lit("<urn:page:none>"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", page(F.col("first"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.sha1(F.encode("block", "utf-8"))))),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.col("size").cast("string")),
        F.lit("\r\n"),
    )
    return row.select(F.concat(header, F.col("block")).alias("value"))


#: What a member inflates to, at most: its length's highest byte is zero.
MEMBER_BYTES = 8 << 20


def member(record: bytes) -> bytes:
    """A whole record, its end added, as gzip: a member, or several of MEMBER_BYTES if it is longer; without the last byte, which is zero."""
    out = []
    record += b"\r\n\r\n"
    for at in range(0, len(record), MEMBER_BYTES):
        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [deflate.compress(record[at : at + MEMBER_BYTES]), deflate.flush()]
    return b"".join(out)[:-1]


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, target_bytes: int = TARGET_BYTES, compression: str = "gzip") -> None:
    """Writes ``pages`` as WARC files of about ``target_bytes``, before compression (``gzip``, a member a record, or ``none``), under ``path``."""
    n, mean = pages.agg(F.count("*"), F.avg(F.octet_length("html"))).first()
    per_file = max(1, int(target_bytes / ((mean or 0) + 700)))
    records, end = archive_records(pages, min_bytes), "\r\n\r\n"
    if compression == "gzip":
        common.modest_batches(pages.sparkSession)

        def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([member(r.as_buffer().to_pybytes()) for r in batch.column(0)], pa.binary())], names=["value"])
                common.trim()

        # the sink writes a string's bytes as they are
        records = records.mapInArrow(compress, "value binary").select(F.col("value").cast("string").alias("value"))
        end = "\x00"
    records.write.option("lineSep", end).option("maxRecordsPerFile", per_file).text(path)


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of RECORD_SCHEMA: a row for each record, status ``record`` or ``doubtful``, and each gap, status ``gap``.
    Without ``payloads`` they are checked but not returned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[dict] = []
                size = 0
                for row in read_rows(name.as_py(), data.as_buffer().to_pybytes()):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    row["payload"] = row["payload"] if payloads else None
                    if size > 8 << 20 or len(rows) >= 4000:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return files.select("path", "content").mapInArrow(parse, RECORD_SCHEMA)


ARROW = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[k]) for n, k in (x.split() for x in RECORD_SCHEMA.split(", "))])


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads these back."""
    spark = pages.sparkSession
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, min_bytes)
    return read_archive(spark, path, payloads=False).where("status = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(common.table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with digests as (
    select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages
), encoded as (
    select page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        cast(((cast('0x' || substr(h, cast(5 * (i // 4) + 1 as int), 5) as bigint) >> cast(15 - 5 * (i % 4) as int)) & 31) as int) + 1, 1)), 'string_agg', '') as payload_digest
    from digests
), first as (select payload_digest, max(page_id) as first from encoded group by payload_digest)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
    case when page_id = first then null else first end as refers_to
from encoded join first using (payload_digest)
"""
