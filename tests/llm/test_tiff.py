import hashlib
import os
import random
import zlib

import pytest

from tensorloom.llm import tiff

SAMPLES = [b"", b"a", b"a" * 1000, bytes(range(256)) * 9, os.urandom(5000), b"the cat sat on the mat " * 400, bytes(random.Random(1).choice(b"ab") for _ in range(40000))]


@pytest.mark.parametrize("codec", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_codecs_round_trip(codec):
    for data in SAMPLES:
        assert tiff.UNPACK[codec](tiff.PACK[codec](data)) == data


def test_known_codes():
    assert tiff.packbits(b"\xaa\xaa\xaa\x80\x00\x2a\xaa\xaa\xaa\xaa\x80\x00\x2a\x22" + b"\xaa" * 10) == bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    # the example of the format's specification
    assert tiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == bytes.fromhex("8001E0408044080C068080")
    assert tiff.unlzw(bytes.fromhex("8001E0408044080C068080")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def plain_unlzw(data):
    """Bit by bit, as the specification words it."""
    bits = "".join(f"{b:08b}" for b in data)
    at, width, known, before, out = 0, 9, [], None, b""
    while True:
        code, at = int(bits[at : at + width], 2), at + width
        if code == 257:
            return out
        if code == 256:
            known, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        entry = known[code] if code < len(known) else before + before[:1]
        out += entry
        if before is not None:
            known.append(before + entry[:1])
        before = entry
        # codes widen one early
        width = 9 + sum(len(known) >= n for n in (511, 1023, 2047))


@pytest.mark.parametrize("size", [0, 1, 252, 253, 254, 255, 256, 509, 510, 511, 764, 765, 766, 767, 768, 1788, 1789, 1790, 1791, 3834, 3835, 3836, 3837, 3838, 3839, 9000])
def test_lzw_where_codes_widen_and_tables_fill_up(size):
    rnd = random.Random(size)
    for data in (rnd.randbytes(size), bytes(rnd.choices(b"abcd", k=size))):
        assert tiff.unlzw(tiff.lzw(data)) == data == plain_unlzw(tiff.lzw(data))


def test_layouts_are_dealt_evenly():
    seen = [tuple(tiff.layout(str(i).encode() * 9).values()) for i in range(4800)]
    counts = [seen.count(k) for k in set(seen)]
    assert len(counts) == 24 and min(counts) > 120 and max(counts) < 290


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("predictor", [False, True])
@pytest.mark.parametrize("codec", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_files_round_trip(order, tiled, predictor, codec):
    payload = (b"some text, " * 9000)[: 576 * 150]
    data = tiff.written(payload, codec, predictor, tiled, order)
    found = list(tiff.read_pages(data))
    assert len(found) == 3 and b"".join(s.tobytes() for _, s in found) == payload


def test_query_on_fixture(spark, tmp_path):
    texts = [None, "", "é" * 600, "x" * 576, "x" * 577, "long " * 30000, "x" * 576]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("text", "text").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in tiff.query(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert rows[3][1:] == rows[6][1:]


def test_pages_and_damaged_files(spark):
    good = tiff.written(b"q" * 576 * 130, tiff.LZW)
    df = spark.createDataFrame([(1, good, "x"), (2, b"junk", "x"), (3, None, "x"), (4, b"", "x"), (5, good[:-40], "x")], "doc_id long, tiff binary, page string")
    rows = tiff.pages(df).collect()
    assert sorted((r.doc_id, r.page) for r in rows if r.error is None and r.doc_id == 1) == [(1, 0), (1, 1), (1, 2)]
    assert {r.doc_id for r in rows if r.error} >= {2, 5} and not {3, 4} & {r.doc_id for r in rows}


def test_described_with_other_ids_damaged_files_and_clashing_columns(spark):
    rows = [("a", 3, tiff.written(b"q" * 576, tiff.LZW), 7, "x"), ("b", 1, b"junk", 7, "x"), (None, 0, None, 7, "x"), ("c", 1, tiff.written(b"z" * 5760, tiff.DEFLATE)[:-20], 7, "x")]
    out = {r.name: r for r in tiff.described(spark.createDataFrame(rows, "name string, n_bytes long, tiff binary, media_bytes int, error string"), "name").collect()}
    assert out["a"].payload_bytes == 576 and out["a"].error is None
    assert all(out[k].error and out[k].payload_sha256 is None and out[k].media_bytes is not None for k in ("b", "c", None))


def test_empty_table_and_extra_columns(spark, tmp_path):
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert tiff.query(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([(1, "t", 5, "key"), (1, "t", 5, "key")], "doc_id long, text string, n_bytes long, key string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = tiff.query(spark, str(tmp_path)).collect()
    assert [r.n_bytes for r in rows] == [1, 1] and rows[0] == rows[1]


def test_each_codec_comes_back_from_its_pages(spark):
    texts = [f"{i} " + "some words of a text " * (i * 7) for i in range(60)]
    files = tiff.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got, codecs = {}, set()
    for r in sorted(tiff.pages(files).collect(), key=lambda r: (r.doc_id, r.page)):
        assert r.error is None and r.width == 576 and len(r.samples) == r.width * r.height
        got[r.doc_id] = got.get(r.doc_id, b"") + r.samples
        codecs.add(r.codec)
    assert codecs == {"lzw", "packbits", "deflate"} and {k: v.rstrip(b"\xff").decode() for k, v in got.items()} == dict(enumerate(texts))
