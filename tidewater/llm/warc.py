"""WARC archives: segmented records, revisits, and their reassembly.

The writer chunks each payload's HTTP body and splits a block beyond a limit
into a first segment and continuation records.  The reader groups
continuations by their row and origin, orders them by segment number, checks
the total length, and decodes the chunked framing.  A record's identifier
names page and payload; rows that share both are told apart by X-Row.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.kernels import bounded_batches, trimmed
from tidewater.plans.scratch import durable

#: Bytes of a block in one record, and of a body in one chunk.
SEGMENT_BYTES, CHUNK_BYTES = 32 << 10, 8 << 10

#: Uncompressed bytes of an archive after which the next one is begun.
ARCHIVE_BYTES = 64 << 20

DATE = "2024-01-01T00:00:00Z"
_LINE = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, sha: str) -> str:
    return f"<urn:page:{'' if page is None else page}:{sha}>"


def chunked(body: bytes, most: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + most]), body[i : i + most]) for i in range(0, len(body), most)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The body of a chunked message; raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = framed.find(_LINE, at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != _LINE:
            raise ValueError("chunk is cut short")
        out.append(framed[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + _LINE + block + _LINE + _LINE) + packer.flush()


def records(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, segment: int = SEGMENT_BYTES, row: str = "0") -> Iterator[bytes]:
    """The gzip members of one row: a revisit, a response, or a response and its continuations; no other row has this ``row``."""
    sha = digest(payload)
    own = [("WARC-Record-ID", record_id(page, sha)), ("WARC-Date", DATE), ("WARC-Target-URI", (url or "").replace("\r", "").replace("\n", "")), ("WARC-Payload-Digest", "sha1:" + sha), ("X-Payload-Length", len(payload))]
    if revisit:
        extra = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, sha))]
        yield _record([("WARC-Type", "revisit"), *own, *extra], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), *own], block)
        return
    cuts = range(0, len(block), segment)
    for number, at in enumerate(cuts, 1):
        last = [("WARC-Segment-Total-Length", len(block))] if number == len(cuts) else []
        if number == 1:
            yield _record([("WARC-Type", "response"), *own, ("WARC-Segment-Number", 1), ("X-Row", row)], block[:segment])
        else:
            name = record_id(page, sha)[:-1] + f":{number}>"
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", record_id(page, sha)), ("WARC-Segment-Number", number), ("X-Row", row), *last], block[at : at + segment])


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each gzip member of a stream."""
    rest = stream.read(1 << 20)
    while rest:
        unpack = zlib.decompressobj(31)
        out = [unpack.decompress(rest)]
        while not unpack.eof:
            more = stream.read(1 << 20)
            if not more:
                raise ValueError("archive is cut short")
            out.append(unpack.decompress(more))
        rest = unpack.unused_data or stream.read(1 << 20)
        if len(rest) < 1 << 16:
            rest += stream.read(1 << 20)
        head, _, body = b"".join(out).partition(_LINE + _LINE)
        lines = head.decode().split("\r\n")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        yield headers, body[: int(headers["content-length"])]


def decided(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 0) -> DataFrame:
    """``pages`` as ``(page_id, url, payload, winner)``: of equal payloads of at least ``least`` bytes the largest id wins.

    A null payload is empty.  A null id never wins over another and, alone or
    with other null ones, is a response; rows that repeat all get the same
    verdict.  Columns beside id, url and payload are not read; an empty table
    gives no rows.  Only digests, lengths and identifiers are grouped, with map-side maxima.
    """
    bounded_batches(pages.sparkSession)
    body = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url"), body.alias("payload"))
    own = own.withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.length("payload").cast("long")})
    groups = own.groupBy("sha", "size").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("times"))
    # Few pages repeat: only groups of two or more are joined back, so unique payloads take part in one shuffle of small rows alone.
    groups = durable(groups.where((F.col("times") > 1) & (F.col("size") >= least)).drop("times"), "repeats")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return own.join(F.broadcast(groups) if few else groups, ["sha", "size"], "left").select("page_id", "url", "payload", F.coalesce("winner", "page_id").alias("winner"))


#: Groups of repeated payloads up to this many (about 60 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 200_000


def write_archives(pages: DataFrame, folder: str, segment: int = SEGMENT_BYTES) -> list[str]:
    """Write rows ``(page_id, url, payload, winner)`` as gzipped WARC files and return their names, none for an empty table.

    Every row is written, rows that repeat and rows without an id too.
    A task writes under names of its own attempt and moves each finished
    archive into place; the names of the attempts that count reach the driver.
    """
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        names, out, held, row = [], None, 0, 0
        for b in batches:
            for page, url, payload, winner in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    names.append(f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(names):04d}.warc.gz")
                    out, held = fs.open_output_stream(f"{base}/{names[-1]}.part", compression=None), 0
                for r in records(page, url, payload, winner, page != winner, segment, f"{context.partitionId()}-{row}"):
                    out.write(r)
                row += 1
                held += len(payload)
                if held >= ARCHIVE_BYTES:
                    out.close()
                    fs.move(f"{base}/{names[-1]}.part", f"{base}/{names[-1]}")
                    out = None
        if out is not None:
            out.close()
            fs.move(f"{base}/{names[-1]}.part", f"{base}/{names[-1]}")
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return sorted(r[0] for r in pages.mapInArrow(trimmed(run), "name string").collect())


def _page(name: str) -> int | None:
    number = name[len("<urn:page:") : -1].partition(":")[0]
    return int(number) if number else None


ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _opened(page: int | None, headers: dict[str, str], block: bytes) -> tuple:
    http, _, framed = block.partition(_LINE + _LINE)
    payload = dechunked(framed) if b"transfer-encoding: chunked" in http.lower() else framed
    if "sha1:" + digest(payload) != headers["warc-payload-digest"]:
        raise ValueError(f"payload of page {page} does not match its digest")
    return page, len(payload), digest(payload), "response", None, payload


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    columns = zip(*rows, strict=True) if rows else ([],) * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])


def read_archives(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """One row for each row written: ``page_id, payload_bytes, payload_digest, record_type, refers_to, payload`` (null for revisits).

    Without archives there are no rows; a page without an id comes back without one.
    Whole records are decoded where they are read; only segments are shuffled,
    by row and origin.  A missing segment, a wrong total length, broken chunks or
    another digest than the header's raise ValueError.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    rows, held = [], 0
                    for h, block in read_records(f):
                        number = int(h.get("warc-segment-number", 0))
                        origin = h.get("warc-segment-origin-id", h["warc-record-id"])
                        row = (None,) * 6
                        if h["warc-type"] == "revisit":
                            row = (_page(origin), int(h["x-payload-length"]), h["warc-payload-digest"][5:], "revisit", _page(h["warc-refers-to"]), None)
                        elif not number:
                            row = _opened(_page(origin), h, block)
                        rows.append((*row, f"{h['x-row']} {origin}" if number else None, number, int(h.get("warc-segment-total-length", 0)), h.get("warc-payload-digest"), block if number else None))
                        held += len(block)
                        if held > 4 << 20:
                            yield whole(rows)
                            rows, held = [], 0
                    yield whole(rows)

    def whole(rows: list[tuple]) -> pa.RecordBatch:
        first = _rows([r[:6] for r in rows])
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        more = [pa.array([r[6 + j] for r in rows], k) for j, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*first.columns, *more], names=[*first.schema.names, "origin", "number", "total", "expected", "block"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                origin = key.partition(" ")[2]
                seen = {p["number"]: p for p in parts}  # a record read twice counts once
                block = b"".join(seen[n]["block"] for n in sorted(seen))
                if sorted(seen) != list(range(1, len(seen) + 1)) or len(block) != max(p["total"] for p in parts):
                    raise ValueError(f"segments of {origin} do not add up")
                rows.append(_opened(_page(origin), {"warc-payload-digest": seen[1]["expected"]}, block))
            yield _rows(rows)

    files = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)))
    read = files.mapInArrow(trimmed(scan), ROW + ", origin string, number long, total long, expected string, block binary")
    read = durable(read, "warc-records")
    parts = read.where("origin is not null").groupBy("origin").agg(F.collect_list(F.struct("number", "total", "expected", "block")).alias("parts"))
    return read.where("origin is null").select(*(x.split()[0] for x in ROW.split(", "))).unionAll(parts.mapInArrow(trimmed(join), ROW))
