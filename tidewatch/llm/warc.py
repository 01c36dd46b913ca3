"""WARC archives: pages as HTTP responses, large ones in segments, equal payloads as revisits; and back.

A payload of at least ``MIN_SHARED`` bytes is stored once, with the page of the smallest page_id; the other pages with
that payload become revisit records.  A response carries its payload in chunked transfer framing.  A record whose
block is longer than ``SEGMENT`` bytes goes on in continuation records, which name the first record and their number,
the last one also the total length.  Files are written by Spark's text writer as gzip: every row is a record, the
separator of rows is the one of WARC records, and a file ends after ``FILE_RECORDS`` of them.

Reading groups continuation records by their origin alone, so segments may lie in any file, orders them by number,
verifies that no number is missing and that the length is the total, and takes away the HTTP head and the framing.
A record that fails has a null payload and says so in ``error``.  Archives of others are read too: a record id that does
not name a page gives a null page_id, records that are neither responses nor revisits have their block as payload, and a
damaged or truncated part of a file gives an error row, behind which reading goes on at the next record.

A null html is an empty payload.  Repeated rows are written and read as often as they occur (those of the smallest
page_id are all responses).  A null page_id never is the page that others revisit, unless no page with that payload has
an id.  Other columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, text_batches

SEGMENT, CHUNK, MIN_SHARED, FILE_RECORDS = 32_768, 8_192, 100, 4_096
#: Bytes that are decompressed at once.
PORTION = 1 << 20
END = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
_HEX = re.compile(rb"[0-9A-Fa-f]+")


def chunked(payload: bytes) -> bytes:
    parts = [payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Raises ValueError where the framing is wrong."""
    out, at = [], 0
    while True:
        line = body.find(END, at)
        if line < 0:
            raise ValueError("the last chunk is missing")
        digits = body[at:line].partition(b";")[0].strip()
        if not _HEX.fullmatch(digits):
            raise ValueError("a chunk has no size")
        size, at = int(digits, 16), line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != END:
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, mark: str) -> Iterator[bytes]:
    """The records of one page; refers_to: the page whose payload it shares; mark: what tells its id from those of rows alike."""
    digest = hashlib.sha256(payload).hexdigest()
    name = lambda page: f"urn:page:{'' if page is None else page}:{digest[:16]}"
    own = f"<{name(page_id)}{mark}>"
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or None
    fields = {"WARC-Type": "response", "WARC-Record-ID": own, "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        fields |= {"WARC-Type": "revisit", "WARC-Refers-To": f"<{name(refers_to)}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        yield _record(fields, http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    if len(parts) == 1:
        yield _record(fields, block)
        return
    for number, part in enumerate(parts, 1):
        if number > 1:
            fields = {"WARC-Type": "continuation", "WARC-Record-ID": f"{own[:-1]}/{number}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": own}
        last = {"WARC-Segment-Total-Length": len(block)} if number == len(parts) else {}
        yield _record(fields | {"WARC-Segment-Number": number} | last, part)


def write(pages: DataFrame, folder: str) -> None:
    """Write all pages to gzipped WARC files.

    A record's id is made of the page and the payload.  The one row with the smallest page_id of a payload, to which
    revisits refer, has no more than that; all others also have the number of their task and of their row in it.
    """
    pages = text_batches(pages).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    # Short pages share nothing; a key of their own keeps them apart.
    pages = pages.withColumn("key", F.when(F.octet_length("html") >= MIN_SHARED, F.sha2("html", 256)).otherwise(F.concat(F.lit("short"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    named = pages.filter((F.length("key") == 64) & F.col("page_id").isNotNull()).groupBy("key", "page_id").agg(F.count("*").alias("rows"))
    firsts = cut(named.groupBy("key").agg(F.min(F.struct("page_id", "rows")).alias("first")).select("key", F.col("first.page_id").alias("origin"), (F.col("first.rows") == 1).alias("single")))
    joined = pages.join(firsts, "key", "left").drop("key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page_id, url, html, origin, single in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "origin", "single"))):
                first = origin is not None and origin == page_id
                out += records(page_id, url, html.encode(), None if first else origin, "" if first and single else f":{task}.{row}")
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", FILE_RECORDS).text(folder, compression="gzip", lineSep="\r\n\r\n")


def plain(data: bytes) -> Iterator[bytes]:
    """The bytes of a file, gzipped (in one or more members) or not, in portions; raises zlib.error or ValueError where it is damaged."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            out = member.decompress(data, PORTION)
            data = member.unconsumed_tail
            if not out and not member.eof and not data:
                raise ValueError("the file ends within a gzip member")
            yield out
        data = member.unused_data


_START = re.compile(rb"WARC/\d")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Fields (names in lower case), block and error of each record of a file; an error has no fields or a block that is cut off."""
    portions, held, at, over = plain(data), bytearray(), 0, None

    def more() -> bool:
        nonlocal over, at
        try:
            held.extend(next(portions))
            return True
        except StopIteration:
            over = over or ""
        except (zlib.error, ValueError) as e:
            over = str(e)
        return False

    while True:
        del held[:at]
        at = 0
        looked = 0  # what was searched already is not searched again
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0 and over is None:
            looked = len(held)
            more()
        if end < 0:
            if held.strip() or over:
                yield {}, b"", over or "the file ends within a record"
            return
        version, *lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = fields.get("content-length", "")
        if not version.startswith("WARC/") or not size.isdecimal():
            # On with the next record, be it in what was read or behind it.
            looked = 1
            while not (m := _START.search(held, max(1, looked - 6))) and over is None:
                looked = len(held)
                more()
            yield {}, b"", "no record where one should begin"
            at = m.start() if m else len(held)
            continue
        stop = end + 4 + int(size)
        while len(held) < stop and over is None:
            more()
        if len(held) < stop:
            yield fields, b"", over or "the file ends within a record"
            return
        yield fields, bytes(held[end + 4 : stop]), None
        while len(held) < stop + 4 and over is None:
            more()
        at = stop + 4 if held[stop : stop + 4] == b"\r\n\r\n" else stop


RECORD = "file string, record_id string, record_type string, page_id long, refers_to long, digest string, segment int, total long, block binary, error string"
_PAGE = re.compile(r"<urn:page:(-?\d{1,18}):")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record; those of a segmented record have the record_id of the first."""

    def page(name: str | None) -> int | None:
        m = _PAGE.match(name or "")
        return int(m[1]) if m else None

    def number(value: str | None) -> int | None:
        return int(value) if value and value.isdecimal() and len(value) < 10 else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                rows = []
                for f, block, error in parse(content.as_py()):
                    origin = f.get("warc-segment-origin-id") or f.get("warc-record-id")
                    algorithm, _, digest = f.get("warc-payload-digest", "").partition(":")
                    rows.append((file, origin, f.get("warc-type"), page(origin), page(f.get("warc-refers-to")), digest if algorithm == "sha256" else None, number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), block, error))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), "content")
    return files.mapInArrow(run, RECORD)


def reassemble(parts: DataFrame) -> DataFrame:
    """One row for each record or group of segments of one origin, with ``segments``, their numbers and blocks in order."""
    head = [F.first(F.col(c), ignorenulls=True).alias(c) for c in ("page_id", "refers_to", "digest")]
    alone = F.col("segment").isNull() | F.col("record_id").isNull()
    whole = parts.filter(alone).select("record_type", "page_id", "refers_to", "digest", F.octet_length("block").cast("long").alias("total"), F.array(F.struct(F.lit(1).alias("segment"), "block")).alias("segments"), "error")
    split = parts.filter(~alone).groupBy("record_id").agg(
        F.min(F.when(F.col("record_type") != "continuation", F.col("record_type"))).alias("record_type"), *head, F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("segments"), F.min("error").alias("error")
    )
    return whole.unionByName(split.drop("record_id"))


def _payload(r: dict) -> tuple[bytes | None, int, str | None]:
    """Payload (none for a revisit), its size and digest; raises ValueError where the record is wrong."""
    if r["error"]:
        raise ValueError(r["error"])
    numbers = [s["segment"] for s in r["segments"]]
    block = b"".join(s["block"] for s in r["segments"])
    if numbers != [*range(1, len(numbers) + 1)] or len(block) != r["total"]:
        raise ValueError("segments are missing, repeated or of another length than their total")
    if r["record_type"] not in ("response", "revisit") or not block.startswith(b"HTTP/"):
        return (None, 0, r["digest"]) if r["record_type"] == "revisit" else (block, len(block), hashlib.sha256(block).hexdigest())
    head, mark, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    if not mark:
        raise ValueError("the HTTP head has no end")
    if r["record_type"] == "revisit":
        return None, int(fields.get("content-length", 0)), r["digest"]
    payload = unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body
    digest = hashlib.sha256(payload).hexdigest()
    if r["digest"] not in (None, digest):
        raise ValueError("the payload has another digest than its record says")
    return payload, len(payload), digest


def decode(whole: DataFrame, with_payload: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, error and, if asked for, payload (null for revisits)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error", "payload"][: 6 + with_payload]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                payload, size, digest, error = None, None, r["digest"], None
                try:
                    payload, size, digest = _payload(r)
                except ValueError as e:
                    error = str(e)
                rows.append((r["page_id"], size, digest, r["record_type"], r["refers_to"], error, payload))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)][: len(names)], names)

    return whole.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string" + ", payload binary" * with_payload)
