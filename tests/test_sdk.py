import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from tensorloom import sdk
from tensorloom.operators import catalog, linalg, search
from tensorloom.sources import images
from tensorloom.sources.store import DatasetError, Store

RNG = np.random.default_rng(8)


def test_frame_arithmetic_and_products(spark):
    a, b = RNG.standard_normal((3, 2, 2)), RNG.standard_normal((3, 2, 2))
    x, y = sdk.TensorFrame.of(spark, a), sdk.TensorFrame.of(spark, b)
    for got, want in (((x + y) * 2 - 1, (a + b) * 2 - 1), (1 - x, 1 - a), (-x / 2, -a / 2), (x**2, a**2), (x @ y, a @ b), (x.transpose(), a.transpose(0, 2, 1)), (x.reshape(4), a.reshape(3, 4)), (x.sum(1), a.sum(2)), (x.norm(), np.linalg.norm(a, axis=(1, 2)))):
        found = got.collect()
        assert sorted(found) == [0, 1, 2] and all(np.allclose(found[i], want[i]) for i in found)
    assert x.similar(a[1], k=1).first().tensor_id == 1
    assert np.allclose(sdk.TensorFrame.of(spark, [[1, 2], [True, False]]).collect()[1], [1, 0])
    with pytest.raises(PySparkException):
        (x + sdk.TensorFrame.of(spark, [[1.0]])).collect()


def test_arrow_there_and_back(spark):
    a = RNG.standard_normal((4, 3, 2)).astype(np.float32)
    array = sdk.arrow_array(a)
    assert isinstance(array, pa.FixedShapeTensorArray) and np.array_equal(sdk.from_arrow_array(array), a)
    frame = sdk.TensorFrame.of(spark, a)
    table = frame.to_arrow()
    assert np.allclose(sdk.TensorFrame.from_arrow(spark, table).collect()[2], a[2]) and table.num_rows == 4


def test_connector(spark, tmp_path):
    c = sdk.StoreConnector(Store(spark, f"file://{tmp_path}/s"))
    key = c.store("d", [[1, 2], [3, 4]], {"k": 1})
    assert np.array_equal(c.retrieve("d", key), [[1, 2], [3, 4]]) and c.details("d", key)["shape"] == [2, 2]
    c.delete("d", key)
    with pytest.raises(DatasetError):
        c.retrieve("d", key)
    with pytest.raises(DatasetError):
        c.delete("d", key)
    with pytest.raises(TypeError):
        sdk.Connector().store("d", [1])


def png(pixels: np.ndarray) -> bytes:
    """A picture of rows, columns and three channels in the PNG format."""
    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_pictures(spark, tmp_path):
    plain = np.zeros((6, 4, 3), np.uint8)
    plain[...] = (255, 128, 0)
    ramp = np.repeat(np.arange(0, 256, 2, dtype=np.uint8)[None, :, None], 3, axis=2).repeat(128, axis=0)
    (tmp_path / "a.png").write_bytes(png(plain))
    (tmp_path / "b.png").write_bytes(png(ramp))
    (tmp_path / "c.png").write_bytes(b"no picture")
    (tmp_path / "d.csv").write_text("x\n1\n2\n")
    (tmp_path / "e.txt").write_text("left alone")
    rows = {r.path.rpartition("/")[2]: np.array(r.data).reshape(r.shape) for r in images.read_images(spark, f"{tmp_path}/*.png", normal=False).collect()}
    assert set(rows) == {"a.png", "b.png"} and rows["a.png"].shape == (3, 128, 128)
    assert np.allclose(rows["a.png"][:, 5, 7], [1, 128 / 255, 0]) and np.allclose(rows["b.png"][0] * 255, ramp[:, :, 0])
    normal = {r.path.rpartition("/")[2]: np.array(r.data).reshape(r.shape) for r in images.read_images(spark, f"{tmp_path}/*.png").collect()}
    assert np.allclose(normal["a.png"][:, 0, 0], (np.array([1, 128 / 255, 0]) - images.MEAN) / images.DEVIATION)
    assert sorted(r.path.rpartition("/")[2] for r in images.ingest(spark, str(tmp_path)).collect()) == ["a.png", "b.png", "d.csv"]
    assert images.resized(np.arange(4.0).reshape(1, 4, 1), 1, 2).ravel().tolist() == [0.5, 2.5]


def test_knn_join_of_many_queries_equals_one_block(spark, monkeypatch):
    x = RNG.standard_normal((300, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, data array<double>")
    for metric in ("cosine", "l2", "dot"):
        one = {(r.query_id, r.rank): r.vec_id for r in search.knn_join(df.where("vec_id < 90"), df, 4, metric).collect()}
        with monkeypatch.context() as m:
            m.setattr(search, "QUERY_BLOCK", 20)
            m.setattr(search, "GROUP_ROWS", 70)
            many = {(r.query_id, r.rank): r.vec_id for r in search.knn_join(df.where("vec_id < 90"), df, 4, metric).collect()}
        assert one == many and len(one) == 360
    assert search.knn_join(df.limit(0), df, 4).count() == 0


def test_upserts_keep_one_row_a_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, catalog.upserted(old, new, "k").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    merged, counts = catalog.imported(old, new, "k", "skip")
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "b"), (3, "e")] and {r.action: r.n for r in counts.collect()} == {"skipped": 1, "imported": 1}
    with pytest.raises(PySparkException):
        catalog.attached(old, new, old, "k").collect()


def test_partial_tucker_keeps_free_modes():
    a = np.einsum("ir,js,rsk->ijk", RNG.standard_normal((5, 2)), RNG.standard_normal((6, 3)), RNG.standard_normal((2, 3, 4)))
    core, factors = linalg.partial_tucker(a, [2, 3, None])
    assert core.shape == (2, 3, 4) and factors[2] is None and np.allclose(linalg.from_partial_tucker(core, factors), a)
    with pytest.raises(ValueError):
        linalg.partial_tucker(a, [2, 9, None])


def test_exact_derivatives():
    from tensorloom.functions import dual

    x = RNG.standard_normal(5)
    m = RNG.standard_normal((3, 5))
    assert np.allclose(linalg.jacobian(lambda v: m @ v, x), m) and np.allclose(linalg.jacobian(lambda v: dual.tanh(v) / 2, x), np.diag((1 - np.tanh(x) ** 2) / 2))
    f = lambda v: (dual.exp(v[:2]) * dual.sin(v[2:4])).sum() + v.dot(v) / dual.sqrt(1 + v[4] ** 2)
    plain = lambda v: (np.exp(v[:2]) * np.sin(v[2:4])).sum() + v.dot(v) / np.sqrt(1 + v[4] ** 2)
    assert np.allclose(linalg.gradient(f, x), linalg.differences(plain, x), atol=1e-6)
    assert np.allclose(linalg.gradient(lambda v: dual.log(v * v + 1).reshape(5, 1).sum(0).sum(), x), 2 * x / (x * x + 1))
    assert np.allclose(linalg.gradient(lambda v: 3.0, x), 0)
    with pytest.raises(ValueError):
        linalg.gradient(lambda v: v * 2, x)
