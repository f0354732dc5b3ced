"""WARC writer and salvage reader.

Writer: one record a page, payload the page in UTF-8. Of records with equal
payloads the one with the largest id is a response and the others revisit it;
the decision comes from digests alone, so pages are not shuffled for it while
the table of repeated digests is small. Each record is a gzip member of its
own. Members are packed up to ``FILE_BYTES`` and each pack is a file, written by
Spark's own committed writer into the shared folder; the line end that it adds
is an empty gzip member, which keeps a file a valid series of members.

Reader: members (or plain records) are read one after another and checked: the
member's checksum, the version line, the length and the closing blank lines,
and a response's payload digest. After a failed check the reader searches on
for the next member or version line that passes, and logs the bytes between as
a quarantined gap. A member that fails is decoded as far as possible, and a
member may hold any number of records: within its content the search goes on
in the same way, so that a bad record costs itself only. Reading is linear in
the size of a file. A file is one value of Spark's binary source, which holds
two GB at most.

Defined results: a null payload counts as empty; line breaks in urls are
written as %0A and %0D; rows that share id and payload with the response are
responses too; rows with a null id revisit a response of equal payload that has
an id, else are responses; an empty table gives no records; extra columns are
ignored. Very long pages are records and files of their own. Equal payloads of a
third of all pages cost nothing beside their one row in the table of repeated
digests. Readers yield nothing for an empty file; a file without any record is
one gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stored

#: A table of repeated digests up to so many rows (about 50 bytes each) is broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of a file, about: it ends with the member that reaches them.
FILE_BYTES = 16 << 20
#: Bytes that are decoded at once, and that a record's headers have at most.
CHUNK = 1 << 16
HEADER_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
# Fixed value: a gzip member of no bytes.
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000".replace(" ", ""))
RECORD_SCHEMA = (
    "path string, offset bigint, length bigint, inner bigint, ok boolean, reason string, record_type string, record_id string, "
    "target_uri string, page_id bigint, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
)


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal string of 40 digits, ten at a time."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def decide(pages: DataFrame, id_col: str, payload_col: str, url_col: str, least: int = 0) -> DataFrame:
    """(page_id, url, payload, bytes, digest, refers_to null for responses)."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    source = source.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_of_hex(F.sha1("payload")))
    repeated = source.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = stored(repeated.select("digest", F.col("bytes").alias("of_bytes"), "first"), "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return source.join(repeated, (source["digest"] == repeated["digest"]) & (F.col("bytes") == F.col("of_bytes")), "left").select("page_id", "url", "payload", "bytes", source["digest"], first.alias("refers_to"))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record, closing blank lines included."""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = 0, compress: bool = True) -> None:
    """Archives of ``pages`` under ``path``."""
    decided = decide(pages, id_col, payload_col, url_col, least)

    closing = EMPTY_MEMBER if compress else b"\r\n\r\n"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, size = [], 0
        for batch in batches:
            for row in zip(*batch.columns):
                record = record_bytes(*[x.as_py() for x in row])
                pack.append(gzip_member(record) if compress else record)
                size += len(pack[-1])
                if size >= FILE_BYTES:
                    yield _file(pack)
                    pack, size = [], 0
        if pack:
            yield _file(pack)

    def _file(pack: list[bytes]) -> pa.RecordBatch:
        data = b"".join(pack)
        return pa.RecordBatch.from_arrays([pa.array([data if compress else data.removesuffix(closing)], pa.binary())], names=["value"])

    files = decided.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(work, "value binary")
    writer = files.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1")
    writer.option("lineSep", closing.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


class Bad(ValueError):
    """A failed check."""


def whole_number(text: str) -> int | None:
    """A number of up to 18 digits, so one that fits a long; else None."""
    return int(text) if len(text) <= 18 and text.isascii() and text.isdigit() else None


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers in lower case, block, end) of the plain record at ``at``."""
    line = re.compile(rb"WARC/1\.[01]\r\n").match(data, at)
    if not line:
        raise Bad("no version line")
    close = data.find(b"\r\n\r\n", line.end() - 2, line.end() + HEADER_BYTES)
    if close < 0:
        raise Bad("headers do not end")
    headers = {}
    for row in data[line.end() : close].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            raise Bad("header without a colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = whole_number(headers.get("content-length", ""))
    if size is None:
        raise Bad("no valid length")
    if headers.get("warc-type") == "revisit" and whole_number(headers.get("x-payload-length", "0")) is None:
        raise Bad("no valid payload length")
    begin, end = close + 4, close + 4 + size
    if data[end : end + 4] != b"\r\n\r\n":
        raise Bad("record is cut short or has a wrong length")
    block = data[begin:end]
    if headers.get("warc-type") == "response" and headers.get("warc-payload-digest", "").startswith("sha1:"):
        payload = block.partition(b"\r\n\r\n")[2] if "application/http" in headers.get("content-type", "") else block
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != headers["warc-payload-digest"][5:]:
            raise Bad("payload digest differs")
    return headers, block, end + 4


def read_member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """(content, end, fault) of the gzip member at ``at``: what can be decoded,
    in slices of bounded size, and what is wrong with it, empty if nothing. The
    end of a faulty member is where decoding stopped."""
    unpacker, out, here = zlib.decompressobj(31), [], at
    while here < len(data):
        before = unpacker.copy()
        try:
            out.append(unpacker.decompress(data[here : here + CHUNK]))
        except zlib.error as e:
            # once more in small steps, for what precedes the fault
            for step in (256, 1):
                unpacker = before.copy()
                while here < len(data):
                    before = unpacker.copy()
                    try:
                        out.append(unpacker.decompress(data[here : here + step]))
                    except zlib.error:
                        break
                    here += step
            return b"".join(out), here, f"member: {e}"
        here += CHUNK
        if unpacker.eof:
            return b"".join(out), min(here, len(data)) - len(unpacker.unused_data), ""
    return b"".join(out), len(data), "member is cut short"


VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
Found = tuple[int, int, dict[str, str] | None, bytes, str]


def records_in(data: bytes) -> Iterator[Found]:
    """Records and gaps of plain ``data``, as :func:`salvage` gives them."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            headers, block, end = parse_record(data, at)
        except Bad as e:
            if gap is None:
                gap, reason = at, str(e)
            onward = VERSION.search(data, at + 1)
            at = onward.start() if onward else len(data)
            continue
        if gap is not None:
            yield gap, at - gap, None, b"", reason
            gap = None
        yield at, end - at, headers, block, ""
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, b"", reason


def salvage(data: bytes) -> Iterator[tuple[int, int, int | None, dict[str, str] | None, bytes, str]]:
    """(offset, length, inner, headers or None for a gap, block, reason).

    Rows without ``inner`` are of the file's own bytes: plain records, members
    of one record, and gaps. What a member holds beside is counted in bytes of
    its content, from ``inner`` on, at the member's offset. A faulty member's
    records come first and then the gap that it is part of."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        fault = ""
        if data.startswith(b"\x1f\x8b", at):
            content, end, fault = read_member(data, at)
            held = list(records_in(content)) if not fault or VERSION.search(content) else []
            sound = not fault and all(h[2] is not None for h in held)
            if fault or not sound:
                # the last gap of a member that is cut is the cut itself
                rest = held[:-1] if fault and held and held[-1][2] is None else held
                for inner, length, headers, block, why in rest:
                    yield at, length, inner, headers, block, why
        else:
            try:
                headers, block, end = parse_record(data, at)
                held, sound = [(0, end - at, headers, block, "")], True
            except Bad as e:
                fault, sound = str(e), False
        if fault:
            if gap is None:
                gap, reason = at, fault
            onward = START.search(data, at + 1)
            at = onward.start() if onward else len(data)
            continue
        if gap is not None:
            yield gap, at - gap, None, None, b"", reason
            gap = None
        if sound:
            for inner, length, headers, block, _ in held:
                yield (at, end - at, None, headers, block, "") if len(held) == 1 else (at, length, inner, headers, block, "")
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, None, b"", reason


def _page(urn: str) -> int | None:
    """A page's number; None for other urns and for what does not fit a long."""
    m = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", urn)
    return int(m[1]) if m and -(1 << 63) <= int(m[1]) < 1 << 63 else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps (``ok`` false) of all files under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("inner", pa.int64()), ("ok", pa.bool_()), ("reason", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for n in range(batch.num_rows):
                name, content = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                rows = []
                for offset, length, inner, headers, block, reason in salvage(content):
                    if headers is None:
                        rows.append((name, offset, length, inner, False, reason, None, None, None, None, None, None, None, None))
                        continue
                    kind = headers.get("warc-type", "")
                    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in headers.get("content-type", "") else block
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if kind == "revisit":
                        size = int(headers.get("x-payload-length", "0"))
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    identity = headers.get("warc-record-id", "")
                    rows.append((name, offset, length, inner, True, None, kind, identity, headers.get("warc-target-uri"), _page(identity), _page(headers.get("warc-refers-to", "")), size, digest, payload if payloads and kind != "revisit" else None))
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.mapInArrow(work, RECORD_SCHEMA)


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = 0) -> DataFrame:
    """Write ``pages`` to the shared folder and read the archives back, stored
    without payloads; a gap, or another number of records than pages, raises."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, payload_col, url_col, least)
    back = stored(read_archives(pages.sparkSession, path, payloads=False).drop("payload"), "records")
    good, gaps = back.agg(F.count_if("ok"), F.count_if(~F.col("ok"))).first()
    if gaps or good != pages.count():
        raise RuntimeError(f"{good} records and {gaps} gaps of {pages.count()} pages came back")
    return back
