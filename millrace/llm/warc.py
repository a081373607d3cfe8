"""WARC archives: writing with segmented records, and reading with segment reassembly.

A record whose block is over the segment size goes out as a first segment and
``continuation`` records that name their origin and number; the last one also
tells the total length. They may lie in any archive. Reading groups the
segments by origin, orders them by number, verifies numbers and total length,
and decodes the chunked framing of the HTTP body.

Archives are runs of gzip members, one a record, about ARCHIVE_BYTES each, held
as rows ``(archive, data)`` of a table in the shared folder, which Spark's
reader and writer reach on any store. ``read_archives`` also takes .warc and
.warc.gz files by way of Spark's binaryFile source.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin, small

SEGMENT_BYTES, ARCHIVE_BYTES, HTTP_CHUNK = 16 << 10, 4 << 20, 4 << 10
#: Equal payloads from this size on are written once.
REVISIT_BYTES = 1000
DATE = "2026-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_CRLF = b"\r\n"


def record_id(row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(row))}>"


def frame_chunks(payload: bytes, size: int = HTTP_CHUNK) -> bytes:
    """Chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, _CRLF]
    return b"".join(out) + b"0\r\n\r\n"


def unframe_chunks(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(_CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != _CRLF:
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def record_bytes(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _CRLF * 2 + block + _CRLF * 2


def http_block(payload: bytes, revisit: bool) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        return head + b"Content-Length: %d\r\n\r\n" % len(payload)
    return head + b"Transfer-Encoding: chunked\r\n\r\n" + frame_chunks(payload)


def page_records(row: int, page_id, url, payload: bytes, refers_row, refers_to, segment: int):
    """The WARC records of one page: a revisit, or a response in as many segments as it takes."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = refers_row is not None
    block = http_block(payload, revisit)
    common = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(row)), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else "".join(str(url).split())), ("WARC-Payload-Digest", digest), ("WARC-Page-ID", page_id),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if revisit:
        common += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_row)), ("WARC-Refers-To-Page-ID", refers_to),
        ]
    if len(block) <= segment:
        yield record_bytes(common, block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record_bytes([*common, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        yield record_bytes(
            [
                ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'{row}/{n}')}>"), ("WARC-Date", DATE),
                ("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", record_id(row)),
                ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None),
            ],
            part,
        )


def write_archives(pages: DataFrame, segment: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``pages(page_id, url, html)`` → a written table of archives ``(archive, data)``.

    Of pages with equal payloads of at least REVISIT_BYTES the one with the
    largest page_id is the response, and the others revisit it; null page_ids
    come before all others, and of rows with one page_id the later counts as
    larger. Null html is an empty payload. Equality is told by SHA-1 and
    length. The numbered rows are written once, so that a rerun task finds the
    same numbers. Only digests are grouped and joined; the payloads stay where
    they are unless the marks are too many to broadcast.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pin(
        pages.select(
            F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("string").alias("page"), F.col("page_id").alias("order_id"),
            F.col("url").cast("string").alias("url"), payload.alias("payload"),
        ).withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    )
    slim = rows.where(F.col("n") >= REVISIT_BYTES).select("row", "order_id", "page", "digest", "n")
    key = F.struct(F.col("order_id").isNotNull().alias("known"), "order_id", "row", "page")
    held = slim.groupBy("digest", "n").agg(F.max(key).alias("held"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "n", "held")
    marks = pin(
        slim.join(held, ["digest", "n"]).where("row <> held.row").select("row", F.col("held.row").alias("refers_row"), F.col("held.page").alias("refers_to"))
    )
    whole = rows.drop("digest", "n", "order_id").join(small(marks), "row", "left")

    def run(batches):
        size, held, serial = 0, [], 0
        name = None
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            for row, page, url, data, refers_row, refers_to in zip(*cols):
                name = name if name is not None else row.as_py()
                for record in page_records(row.as_py(), page.as_py(), url.as_py(), data.as_py(), refers_row.as_py(), refers_to.as_py(), segment):
                    squeeze = zlib.compressobj(1, wbits=31)
                    member = squeeze.compress(record) + squeeze.flush()
                    held.append(member)
                    size += len(member)
                    if size >= archive_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([f"{name}-{serial}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "data"])
                        size, held, serial = 0, [], serial + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}-{serial}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "data"])

    whole = whole.select("row", "page", "url", "payload", "refers_row", "refers_to")
    return pin(whole.mapInArrow(run, "archive string, data binary"))


def _inflate(data: bytes):
    """The bytes of a run of gzip members, piece by piece; plain bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    view, engine = memoryview(data), zlib.decompressobj(31)
    while at < len(data):
        piece = view[at : at + 65536]
        yield engine.decompress(piece)
        if engine.eof:
            at += len(piece) - len(engine.unused_data)
            engine = zlib.decompressobj(31)
        else:
            at += len(piece)


class _Stream(io.RawIOBase):
    def __init__(self, pieces):
        self.pieces, self.rest = pieces, b""

    def readable(self):
        return True

    def readinto(self, into):
        while not self.rest:
            self.rest = next(self.pieces, None)
            if self.rest is None:
                self.rest = b""
                return 0
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def parse_records(data: bytes):
    """(headers with lower-case names, block) of each record of an archive."""
    stream = io.BufferedReader(_Stream(_inflate(data)), 1 << 17)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers = {}
        for line in iter(stream.readline, _CRLF):
            if not line:
                raise ValueError("an archive ends in a record's header")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("an archive ends in a record's block")
        yield headers, block


_RECORD = "record string, origin string, number int, total long, type string, uri string, page string, refers_to string, digest string, block binary"


def read_records(archives: DataFrame) -> DataFrame:
    """``data`` of each archive → a row per WARC record. warcinfo and other records come too."""

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 5, pa.binary()]
        names = [x.split()[0] for x in _RECORD.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                for h, block in parse_records(data.as_py()):
                    number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
                    rows.append(
                        (
                            h.get("warc-record-id"), h.get("warc-segment-origin-id"), int(number) if number else None, int(total) if total else None,
                            h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-page-id"), h.get("warc-refers-to-page-id"), h.get("warc-payload-digest"), block,
                        )
                    )
                    size += len(block)
                    if size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return archives.select("data").mapInArrow(run, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records from segments: adds ``complete``; continuation records go into their origin's row.

    Complete means that the numbers run from 1 without gap or repeat and the
    last segment's total equals the length of all. Segments without an origin
    give a row with null type that is not complete. A group is one record's
    segments, so no group outgrows the record.
    """
    alone = records.where("number is null").select("record", "type", "uri", "page", "refers_to", "digest", "block", F.lit(True).alias("complete"))
    parts = records.where("number is not null").withColumn("origin", F.coalesce("origin", "record"))
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    grouped = parts.groupBy("origin").agg(
        *(first(c) for c in ("type", "uri", "page", "refers_to", "digest")),
        F.max("total").alias("total"), F.array_sort(F.collect_list("number")).alias("numbers"), F.expr("listagg(block) WITHIN GROUP (ORDER BY number)").alias("block"),
    )
    block = F.coalesce("block", F.lit(b""))
    in_order = F.col("numbers") == F.sequence(F.lit(1), F.size("numbers"))
    whole = grouped.select(
        F.col("origin").alias("record"), "type", "uri", "page", "refers_to", "digest", block.alias("block"),
        F.coalesce(in_order & (F.col("total") == F.octet_length(block)), F.lit(False)).alias("complete"),
    )
    return alone.unionByName(whole)


def decode_payloads(records: DataFrame) -> DataFrame:
    """Adds to each HTTP record ``payload`` (chunk framing decoded; null for revisits), ``payload_bytes`` and ``framed_well``."""

    def run(batches):
        for b in batches:
            out = []
            for kind, block in zip(b.column("type"), b.column("block")):
                head, _, body = block.as_py().partition(_CRLF * 2)
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(_CRLF)[1:])}
                try:
                    if kind.as_py() == "revisit":
                        out.append((None, int(fields[b"content-length"]), True))
                        continue
                    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
                        body = unframe_chunks(body)
                    out.append((body, len(body), True))
                except (ValueError, KeyError):
                    out.append((None, None, False))
            cols = list(zip(*out)) if out else [[]] * 3
            keep = [i for i, n in enumerate(b.schema.names) if n != "block"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep), *(pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.bool_())))],
                [*(b.schema.names[i] for i in keep), "payload", "payload_bytes", "framed_well"],
            )

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema if f.name != "block")
    return records.mapInArrow(run, f"{kept}, payload binary, payload_bytes long, framed_well boolean")


def read_archives(archives: DataFrame) -> DataFrame:
    """Archives ``(data)`` → one row per HTTP response or revisit, reassembled and decoded."""
    return decode_payloads(reassemble(read_records(archives)).where("type in ('response', 'revisit') or type is null"))


def round_trip(pages: DataFrame, segment: int = SEGMENT_BYTES) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, complete`` as the archives tell.

    One row per row of ``pages``, repeated rows and null page_ids too; other
    columns are not read; no rows give no rows.
    """
    kind = pages.schema["page_id"].dataType
    told = read_archives(write_archives(pages, segment))
    return told.select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes",
        F.when(F.col("type") == "revisit", _hex_digest(F.col("digest"))).otherwise(F.sha1("payload")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"),
        (F.col("complete") & F.col("framed_well")).alias("complete"),
    )


def _hex_digest(digest):
    """sha1:BASE32 as lower-case hex: each of the 32 characters stands for five bits."""
    letters = F.substring_index(digest, ":", -1)
    halves = []
    for start in (1, 9, 17, 25):  # eight characters are forty bits, ten hex digits
        value = F.lit(0).cast("long")
        for i in range(8):
            value = value * 32 + (F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.substring(letters, start + i, 1)) - 1)
        halves.append(F.lpad(F.lower(F.hex(value)), 10, "0"))
    return F.concat(*halves)
