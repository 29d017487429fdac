import base64
import hashlib

import pytest

from tensorloom.llm import common, warc


@pytest.mark.parametrize("payload", [b"", b"x", b"\r\n\r\n" * 9, b"WARC/1.1\r\n\r\n" * 9000])
def test_chunked_framing(payload):
    assert warc.dechunked(warc.chunked(payload, 7)) == payload
    assert warc.payload_of(warc._HEAD + warc.chunked(payload)) == payload


def test_query_on_fixture(spark, tmp_path):
    rows = [(5, "http://a", "same"), (2, "http://b", "same"), (9, None, None), (4, "http://c", ""), (7, "u", "é\r\n\r\n" * 60000), (8, "u", "é\r\n\r\n" * 60000), (None, "u", "same"), (3, "u", "z" * 65536), (2, "http://b", "same"), (11, "u", "y" * 300000), (11, "u", "y" * 300000)]
    spark.createDataFrame([(*r, 0, "x") for r in rows], "page_id long, url string, html string, first int, sha string").write.parquet(str(tmp_path / "pages.parquet"))
    want = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        first = min(same)
        kind = "response" if page is None or page == first else "revisit"
        want.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, first if kind == "revisit" else None))
    assert sorted((tuple(r) for r in warc.query(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_lost_segment_is_an_error(spark, tmp_path):
    cut = list(warc.records(1, "u", b"z" * 200000, None))
    whole = list(warc.records(2, "u", b"a", None))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in [cut[0], whole[0], *cut[2:]]))
    rows = {r.page: r for r in warc.read(spark, str(tmp_path / "a")).collect()}
    assert rows[1].error and rows[1].payload is None and rows[2].payload == b"a"


def test_damaged_archives_give_errors_and_go_on(spark, tmp_path):
    import gzip

    good = [b"".join(r + b"\r\n\r\n" for r in warc.records(k, "u", b"payload %d" % k, None)) for k in range(6)]
    (tmp_path / "a").mkdir()
    files = {
        "cut.warc.gz": gzip.compress(good[0] + good[1])[:-30],
        "broken.warc.gz": gzip.compress(good[0]) + gzip.compress(good[2])[:20] + b"\0" * 40,
        "length.warc": good[3].replace(b"Content-Length", b"Contents") + good[4],
        "number.warc": good[3].replace(b"Content-Length: ", b"Content-Length: x") + good[5],
        "junk.warc": b"no archive at all",
        "tail.warc": good[1][:-30],
        "none.warc": b"",
        "chunk.warc": good[2].replace(b"9\r\npayload", b"z\r\npayload"),
    }
    for name, data in files.items():
        (tmp_path / "a" / name).write_bytes(data)
        rows = list(warc.parsed(data))
        assert all(len(r) == 9 for r in rows) and (not data or any(r[8] for r in rows) or name == "chunk.warc"), name
    rows = warc.read(spark, str(tmp_path / "a")).collect()
    assert {(r.page, r.payload) for r in rows if r.error is None} >= {(0, b"payload 0"), (4, b"payload 4"), (5, b"payload 5")}
    assert sum(r.error is not None for r in rows) == 8 and all(r.payload is None for r in rows if r.error)


def test_frequent_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "HOT", 3)
    rows = [(k, "u", "the page of all") for k in range(50, 10, -1)] + [(k, "u", None) for k in range(60, 80)] + [(5, "u", "own")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    out = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.query(spark, str(tmp_path)).collect()}
    assert out == {5: (3, "response", None), 11: (15, "response", None), 60: (0, "response", None)} | {k: (15, "revisit", 11) for k in range(12, 51)} | {k: (0, "revisit", 60) for k in range(61, 80)}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.query(spark, str(tmp_path)).count() == 0
