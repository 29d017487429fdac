"""TIFF columns: files of one or more grey 8-bit pages, written and read without an imaging library.

``read_pages`` walks the image directories of a file in either byte order, decodes PackBits, LZW, deflate and
plain strips or tiles, undoes the horizontal predictor and gives one page after another; ``pages`` applies it
to a column and emits one row per page. ``packed`` stores byte payloads as such files.

Defined results: a null or empty file has no pages; a damaged one gives a single row with its error and no
samples, and ``described`` an error for it; equal payloads give equal files; a null text is an empty payload; repeated
rows are rows of their own, an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import pieces, table

PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {PLAIN: "plain", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
WIDTH = 576
#: Rows of a page, rows of a strip, width and height of a tile.
PAGE_ROWS, STRIP_ROWS, TILE = 64, 16, (192, 16)
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 6: 1, 7: 1, 8: 2, 9: 4, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}


def packbits(data: bytes) -> bytes:
    out, n = bytearray(), len(data)
    values = np.frombuffer(data, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [n]]) if n else np.zeros(1, int)
    runs = np.flatnonzero(np.diff(edges) >= 3)
    plain_from = 0
    for a, b in zip(edges[runs].tolist(), edges[runs + 1].tolist()):
        for i in range(plain_from, a, 128):
            part = data[i : min(a, i + 128)]
            out += bytes([len(part) - 1]) + part
        i = a
        while b - i >= 2:
            run = min(128, b - i)
            out += bytes([257 - run, data[i]])
            i += run
        plain_from = i
    for i in range(plain_from, n, 128):
        part = data[i : i + 128]
        out += bytes([len(part) - 1]) + part
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += 2 + k
        else:
            if k > 128:
                out += data[i + 1 : i + 2] * (257 - k)
            i += 2 if k > 128 else 1
    return bytes(out)


#: LZW: codes for clear and end, first free code, and how many codes after a clear the widths 9, 10 and 11 last.
CLEAR, END, FREE, WIDENS = 256, 257, 258, (254, 766, 1790)
#: Codes after a clear until the encoder clears again: the table holds 4094 entries then.
RESET = 4094 - FREE


def _widths(first: int, n: int) -> np.ndarray:
    """Bits of the n codes from the one with number ``first`` after a clear; codes widen one early, as TIFF 6.0 has it."""
    return 9 + np.searchsorted(WIDENS, np.arange(first, first + n), "right")


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the table starts anew when it is full."""
    codes, widths = [CLEAR], [np.array([9])]
    rest = iter(data)
    now = next(rest, -1)
    while True:
        known: dict[int, int] = {}  # by the code of the string before, shifted, and the byte behind it
        segment: list[int] = []
        for byte in rest:
            pair = now << 8 | byte
            if pair in known:
                now = known[pair]
                continue
            segment.append(now)
            now = byte
            known[pair] = FREE + len(known)
            if len(segment) == RESET:
                break
        else:
            segment += [now, END] if now >= 0 else [END]
            codes += segment
            widths.append(_widths(0, len(segment)))
            break
        codes += [*segment, CLEAR]
        widths.append(_widths(0, len(segment) + 1))
    bits = np.concatenate(widths)
    values = np.array(codes, np.uint16) << (16 - bits).astype(np.uint16)
    every = np.unpackbits(values.astype(">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(every[np.arange(16) < bits[:, None]]).tobytes()


def unlzw(data: bytes) -> bytes:
    """Reads codes in blocks, as their widths follow from their numbers after a clear; data may end without an end code."""
    raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    out: list[bytes] = []
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    known, before, at, number, total = list(first), b"", 0, 0, 8 * len(data)
    while at + 9 <= total:
        bits = _widths(number, 4096)
        stop = at + np.cumsum(bits)
        bits = bits[stop <= total]
        if not len(bits):
            break
        place = stop[: len(bits)] - bits
        byte = place >> 3
        window = raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]
        codes = (window >> (24 - (place & 7) - bits).astype(np.uint32)) & ((1 << bits) - 1).astype(np.uint32)
        marks = np.flatnonzero((codes == CLEAR) | (codes == END))
        here = int(marks[0]) if len(marks) else len(codes)
        for code in codes[:here].tolist():
            if not before:
                entry = known[code]
            else:
                entry = known[code] if code < len(known) else before + before[:1]
                known.append(before + entry[:1])
            out.append(entry)
            before = entry
        if here == len(codes):
            at, number = int(stop[len(codes) - 1]), number + here
        elif codes[here] == END:
            break
        else:
            at, number, known, before = int(stop[here]), 0, list(first), b""
    return b"".join(out)


PACK = {PLAIN: bytes, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, 4), PACKBITS: packbits}
UNPACK = {PLAIN: bytes, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpackbits}


#: What reading a damaged file may raise.
DAMAGED = (ValueError, KeyError, IndexError, TypeError, OverflowError, MemoryError, struct.error, zlib.error)


def written(payload: bytes, codec: int = DEFLATE, predictor: bool = True, tiled: bool = False, order: str = "<", width: int = WIDTH) -> bytes:
    """A TIFF file of the payload, whose length is a positive multiple of the width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 0))
    link = 4
    for top in range(0, len(rows), PAGE_ROWS):
        page = rows[top : top + PAGE_ROWS]
        tags = {254: (4, [2]), 256: (4, [width]), 257: (4, [len(page)]), 258: (3, [8]), 259: (3, [codec]), 262: (3, [1]), 277: (3, [1]), 317: (3, [2 if predictor else 1])}
        if tiled:
            across, down = TILE
            blocks = [np.pad(page[y : y + down, x : x + across], ((0, max(0, y + down - len(page))), (0, max(0, x + across - width)))) for y in range(0, len(page), down) for x in range(0, width, across)]
            tags |= {322: (4, [across]), 323: (4, [down])}
        else:
            blocks = [page[y : y + STRIP_ROWS] for y in range(0, len(page), STRIP_ROWS)]
            tags[278] = (4, [STRIP_ROWS])
        at, sizes = [], []
        for block in blocks:
            if predictor:
                block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
            data = PACK[codec](np.ascontiguousarray(block).tobytes())
            at.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        tags |= {324: (4, at), 325: (4, sizes)} if tiled else {273: (4, at), 279: (4, sizes)}
        entries = []
        for tag, (kind, values) in sorted(tags.items()):
            data = struct.pack(f"{order}{len(values)}{_CODES[kind]}", *values)
            if len(data) > 4:
                place = struct.pack(order + "I", len(out))
                out += data
                data = place
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def read_pages(data: bytes) -> Iterator[tuple[dict, np.ndarray]]:
    """(tags, samples) of each page: an array of rows, columns and samples of a pixel."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(order + "H", data[2:4]) != (42,):
        raise ValueError("not a TIFF file")
    (at,), seen = struct.unpack(order + "I", data[4:8]), set()
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        (n,) = struct.unpack(order + "H", data[at : at + 2])
        tags = {}
        for i in range(n):
            place = at + 2 + 12 * i
            tag, kind, count = struct.unpack(order + "HHI", data[place : place + 8])
            length = _SIZES.get(kind, 0) * count
            place = place + 8 if length <= 4 else struct.unpack(order + "I", data[place + 8 : place + 12])[0]
            if kind in _CODES:
                tags[tag] = list(struct.unpack(f"{order}{count}{_CODES[kind]}", data[place : place + length]))
        (at,) = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])
        yield tags, _samples(data, tags)


def _samples(data: bytes, tags: dict) -> np.ndarray:
    width, height, each = tags[256][0], tags[257][0], tags.get(277, [1])[0]
    codec, predictor = tags.get(259, [1])[0], tags.get(317, [1])[0]
    if codec not in UNPACK or predictor not in (1, 2) or set(tags.get(258, [1])) != {8} or tags.get(284, [1])[0] != 1:
        raise ValueError("kind of TIFF image that isn't supported")
    tiled = 322 in tags
    across, down = (tags[322][0], tags[323][0]) if tiled else (width, min(height, tags.get(278, [height])[0]))
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    out = np.zeros((height, width, each), np.uint8)
    for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
        y, x = divmod(k, -(-width // across))
        y, x = y * down, x * across
        tall = down if tiled else min(down, height - y)
        block = np.frombuffer(UNPACK[codec](data[place : place + size]), np.uint8)[: tall * across * each].reshape(tall, across, each)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        out[y : y + tall, x : x + across] = block[: height - y, : width - x]
    return out


def pages(files: DataFrame, column: str = "tiff", key: str = "doc_id") -> DataFrame:
    """One row per page of each file: key, page, width, height, codec, samples, error."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches, column):
            rows = []
            for k, data in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist()):
                try:
                    for i, (tags, samples) in enumerate(read_pages(data) if data else ()):
                        rows.append((k, i, samples.shape[1], samples.shape[0], NAMES[tags.get(259, [1])[0]], samples.tobytes(), None))
                except DAMAGED as error:
                    rows.append((k, None, None, None, None, None, str(error) or "damaged"))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 7, (batch.schema.field(key).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()))], names=[key, "page", "width", "height", "codec", "samples", "error"])

    return files.select(key, column).mapInArrow(run, f"`{key}` {kind}, page int, width int, height int, codec string, samples binary, error string")


def layout(payload: bytes) -> dict:
    """The form a payload is stored in: its checksum deals the codecs evenly, and predictor, tiles and byte order by bits of their own."""
    k = zlib.crc32(payload)
    return {"codec": (DEFLATE, LZW, PACKBITS)[k % 3], "predictor": bool(k >> 8 & 1), "tiled": bool(k >> 9 & 1), "order": "<>"[k >> 10 & 1]}


def packed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, tiff): the UTF-8 text, filled up with bytes 255 to whole rows, as a TIFF file."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches, "text"):
            files, sizes = [], []
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                t = t or b""
                sizes.append(len(t))
                payload = t + b"\xff" * (max(WIDTH, -(-len(t) // WIDTH) * WIDTH) - len(t))
                files.append(written(payload, **layout(payload)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["key", "n_bytes", "tiff"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, tiff binary").withColumnRenamed("key", key)


def described(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads stored files (key, n_bytes, tiff) back: sizes and digests of payload and file, a feature string of pages, codec, mean
    and histogram, and an error where a file is damaged, which has no payload then."""
    kind = files.schema[key].dataType.simpleString()
    types = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]

    def row(data: bytes) -> tuple:
        file = len(data), hashlib.sha256(data).hexdigest()
        try:
            found = list(read_pages(data))
            payload = b"".join(s.tobytes() for _, s in found)
            samples = np.frombuffer(payload, np.uint8)
            bins = np.bincount(samples >> 5, minlength=8)
            mean = int(samples.sum(dtype=np.int64)) * 1000 // max(1, len(samples))
            codec = NAMES[found[0][0].get(259, [1])[0]] if found else "none"
            feature = f"pages={len(found)};codec={codec};mean={mean};bins={'-'.join(map(str, bins.tolist()))}"
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *file, feature, None
        except DAMAGED as error:
            return None, None, None, *file, None, str(error) or "damaged"

    def run(batches):
        for batch in pieces(batches, "tiff"):
            rows = [row(data or b"") for data in batch.column("tiff").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), *[pa.array(list(c), t) for c, t in zip(zip(*rows), types)]], names=["key", "n_bytes", *names])

    fields = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return files.select(F.col(key).alias("key"), "n_bytes", "tiff").mapInArrow(run, fields).withColumnRenamed("key", key)


def query(spark, sf_dir: str) -> DataFrame:
    return described(packed(table(spark, sf_dir, "documents")))
