"""WARC archives: written by Spark's own text writer, read back with segment reassembly.

A page becomes a response record (HTTP head, chunked body) or, where an equal payload has a smaller id, a
revisit record. Blocks longer than ``SEGMENT`` bytes are cut into continuation records. On reading, the
segments are grouped by the identifier of their origin and ordered by number, their total length is
verified, and the chunked transfer framing is decoded; digests and lengths are those of the payload found.

The record separator is the line separator of the text writer, so archives need no local files: executors
write and read them in the shared folder through Spark.

Defined results: a null html is an empty payload; a null url is written as ``-``; a null page id is always
a response; a repeated row gives its result once for each time; a record whose segments are missing, out
of number or of the wrong total length gives a row with an error and no payload. So does a damaged stretch of
an archive (a broken gzip stream, a header without its end, length or identifier): reading goes on at the next
record that begins behind one. An empty archive has no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import forget, frequent, often, pieces, shared_folder, spread, stored, table

SEGMENT, CHUNK = 65_536, 16_384
#: Records of one archive at most; with SEGMENT it bounds what a task holds at once.
RECORDS = 512
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_FIELDS = "page long, id string, type string, refers string, digest string, segment int, total long, block binary, error string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    return dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def _record(block: bytes, **fields: str) -> bytes:
    lines = [b"WARC/1.1", *(f"{k.replace('_', '-')}: {v}".encode() for k, v in fields.items()), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def records(page: int | None, url: str | None, payload: bytes, first: int | None) -> Iterator[bytes]:
    """The records of a page without the two line ends that close each of them. first: the smallest id with this payload."""
    digest = digest_of(payload)
    name = f"<urn:tensorloom:page:{'-' if page is None else page}:{digest}>"
    common = {"WARC_Target_URI": " ".join((url or "-").split()) or "-", "WARC_Date": "2024-01-01T00:00:00Z", "WARC_Payload_Digest": f"sha1:{digest}"}
    if page is not None and first is not None and first != page:
        yield _record(_HEAD, WARC_Type="revisit", WARC_Record_ID=name, **common, WARC_Refers_To=f"<urn:tensorloom:page:{first}:{digest}>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", Content_Type="application/http;msgtype=response")
        return
    block = _HEAD + chunked(payload)
    if len(block) <= SEGMENT:
        yield _record(block, WARC_Type="response", WARC_Record_ID=name, **common, Content_Type="application/http;msgtype=response")
        return
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    yield _record(parts[0], WARC_Type="response", WARC_Record_ID=name, **common, WARC_Segment_Number="1", Content_Type="application/http;msgtype=response")
    for k, part in enumerate(parts[1:], 2):
        last = {"WARC_Segment_Total_Length": str(len(block))} if k == len(parts) else {}
        yield _record(part, WARC_Type="continuation", WARC_Record_ID=f"{name[:-1]}:{k}>", WARC_Segment_Origin_ID=name, WARC_Segment_Number=str(k), **common, **last)


def write(pages: DataFrame, path: str) -> None:
    """Writes rows of (page_id, url, html) as gzipped archives of at most RECORDS records into the folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # only payloads that occur twice need a lookup; the most frequent ones are dealt to several tasks
    several = stored(rows.groupBy("sha").agg(F.min("page").alias("first"), F.count("*").alias("m")).where("m > 1"), "payloads")
    hot = several.where(F.col("m") > often(several.agg(F.sum("m")).first()[0] or 0)).select("sha", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            made = []
            for page, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "first"))):
                made += records(page, url, html.encode(), first)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    out = spread(rows, several.drop("m"), "sha", "page", hot, "left").select("page", "url", "html", "first").mapInArrow(run, "record binary")
    out.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)
    forget(several)


def _unzipped(data: bytes) -> tuple[bytes, str | None]:
    """The bytes of all gzip members, as far as they can be read, and what was wrong with the rest."""
    whole = []
    while data:
        stream = zlib.decompressobj(31)
        try:
            whole.append(stream.decompress(data))
        except zlib.error as error:
            return b"".join(whole), f"the archive is damaged: {error}"
        if not stream.eof:
            return b"".join(whole), "the archive is cut off"
        data = stream.unused_data
    return b"".join(whole), None


def _record_at(data: bytes, at: int) -> tuple[tuple, int]:
    """The record that begins there, as _FIELDS has it, and where the next one begins; raises ValueError."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or not data.startswith(b"WARC/", at):
        raise ValueError("a record has no header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in data[at:end].decode(errors="replace").split("\r\n")[1:])}
    for name in ("content-length", "warc-record-id", "warc-type"):
        if not fields.get(name):
            raise ValueError(f"a record has no {name}")
    size = int(fields["content-length"])
    if size < 0:
        raise ValueError("a record has a negative length")
    block = data[end + 4 : end + 4 + size]
    name = fields.get("warc-segment-origin-id", fields["warc-record-id"])
    page = name.split(":")[3] if name.startswith("<urn:tensorloom:page:") else ""
    number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    row = int(page) if page.lstrip("-").isdigit() else None, name, fields["warc-type"], fields.get("warc-refers-to"), digest, int(number) if number else None, int(total) if total else None, block, None if len(block) == size else "the record is cut off"
    return row, end + 4 + size + 4


def parsed(data: bytes) -> Iterator[tuple]:
    """The records of an archive, as _FIELDS has them; a damaged stretch is a row of type ``damaged``."""
    wrong = None
    if data[:2] == b"\x1f\x8b":
        data, wrong = _unzipped(data)
    at = 0
    while at < len(data):
        try:
            row, at = _record_at(data, at)
        except ValueError as error:
            row = None, None, "damaged", None, "", None, None, b"", str(error)
            found = data.find(b"\r\n\r\nWARC/", at)
            at = found + 4 if found >= 0 else len(data)
        yield row
    if wrong:
        yield None, None, "damaged", None, "", None, None, b"", wrong


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 9, kinds)], names=[f.split()[0] for f in _FIELDS.split(", ")])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "content", 1):
        for data in batch.column("content").to_pylist():
            rows, size = [], 0
            for row in parsed(data):
                rows.append(row)
                size += len(row[7])
                if size > 4_000_000:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)


def _decoded(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, name, kind, refers, digest, n, error, parts, total in zip(*(batch.column(c).to_pylist() for c in ("page", "id", "type", "refers", "digest", "copies", "error", "parts", "total"))):
                payload = None
                if kind == "response" and not error:
                    found = {p["segment"]: p["block"] for p in parts}
                    block = b"".join(found[k] for k in sorted(found, key=lambda k: k or 1))
                    if total is not None and (sorted(found) != list(range(1, len(found) + 1)) or len(block) != total) or total is None and set(found) != {None}:
                        error = "segments are missing or their total length is wrong"
                    else:
                        try:
                            payload = payload_of(block)
                        except ValueError as e:
                            error = str(e)
                if payload is not None and digest and digest_of(payload) != digest:
                    payload, error = None, "the payload has another digest"
                rows += [(page, name, kind, refers, digest, None if payload is None else len(payload), payload if keep else None, error)] * n
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 8, kinds)], names=["page", "id", "type", "refers", "digest", "bytes", "payload", "error"])

    return run


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per page of the archives in a folder: page, id, type, refers, digest, bytes, payload (if asked for), error."""
    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, _FIELDS)
    part = F.struct("segment", "block")
    shape = "page", "id", "type", "refers", "digest"
    whole = found.where("segment IS NULL").select(*shape, F.lit(1).alias("copies"), "error", F.array(part).alias("parts"), "total")
    cut = found.where("segment IS NOT NULL").groupBy("id").agg(
        F.first("page").alias("page"), F.lit("response").alias("type"), F.first("refers").alias("refers"), F.first("digest").alias("digest"),
        F.greatest(F.count_if(F.col("segment") == 1), F.lit(1)).cast("int").alias("copies"), F.max("error").alias("error"), F.collect_list(part).alias("parts"), F.coalesce(F.max("total"), F.lit(-1)).alias("total"),
    )
    return whole.unionByName(cut).mapInArrow(_decoded(payloads), "page long, id string, type string, refers string, digest string, bytes long, payload binary, error string")


def query(spark, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_folder(spark)}/tensorloom/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    back = stored(read(spark, path, payloads=False).drop("payload"), "records")
    lengths = back.where("type = 'response'").select(F.col("id").alias("refers"), F.col("bytes").alias("full"), F.col("page").alias("to")).distinct()
    again = back.where("type = 'revisit'")
    hot = frequent(again, "refers", again.count())
    out = spread(again, lengths, "refers", "id", hot, "left").select("page", F.col("full").alias("bytes"), "digest", "type", "to")
    every = back.where("type = 'response'").select("page", "bytes", "digest", "type", F.lit(None).cast("long").alias("to")).unionByName(out)
    return every.select(F.col("page").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("to").alias("refers_to"))
