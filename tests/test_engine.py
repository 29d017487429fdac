import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tensorloom import model
from tensorloom.functions import codecs, descriptor
from tensorloom.functions import dense as D
from tensorloom.operators import catalog, elements, lineage, search, series, vectors
from tensorloom.sources import store
from tensorloom.streaming import feeds


def one(spark, column, rows=None, schema="a array<double>, b array<double>"):
    rows = [tuple([float(x) for x in v] for v in row) for row in rows or [([1.0, 2.0, 4.0], [2.0, 0.0, 8.0])]]
    return spark.createDataFrame(rows, schema).select(column.alias("x")).first().x


def test_dense_functions(spark):
    assert one(spark, D.add("a", "b")) == [3, 2, 12] and one(spark, D.subtract("a", 1)) == [0, 1, 3]
    assert one(spark, D.divide("a", "b")) == [0.5, float("inf"), 0.5] and one(spark, D.dot("a", "b")) == 34
    assert np.allclose(one(spark, D.cross("a", "b")), np.cross([1, 2, 4], [2, 0, 8]))
    logs = one(spark, D.log("b"), [([1.0], [0.0, -1.0, 1.0])])
    assert logs[0] == float("-inf") and np.isnan(logs[1]) and logs[2] == 0
    assert one(spark, D.permute("a", [2, 3], [1, 0]), [([0.0, 1, 2, 3, 4, 5], [])]) == [0, 3, 1, 4, 2, 5] == one(spark, D.transpose("a", 2, 3), [([0.0, 1, 2, 3, 4, 5], [])])
    assert one(spark, D.cosine_similarity("a", "b"), [([1.0, 0.0], [0.0])]) == 0 and one(spark, D.frobenius_similarity("a", "b"), [([3.0, 4.0], [0.0])]) == 1 / 6
    with pytest.raises(ZeroDivisionError):
        D.divide("a", 0)
    with pytest.raises(PySparkException):
        one(spark, D.add("a", "b"), [([1.0], [1.0, 2.0])])
    assert one(spark, F.size(model.nested("a", [2, 2])), [([1.0, 2, 3, 4], [])]) == 2


def test_descriptor_and_properties(spark):
    rows = [("sym", [3, 3], [1.0, 2, 3, 2, 4, 5, 3, 5, 6]), ("eye", [2, 2], [1.0, 0, 0, 1]), ("diag", [3, 3], [1.0, 0, 0, 0, 2, 0, 0, 0, 3]), ("vec", [3], [1.0, 2, 2]), ("wide", [2, 3], [1.0, 0, 0, 0, 0, 0]), ("empty", [0], [])]
    rows = [(i, s, [float(x) for x in d]) for i, s, d in rows]
    t = descriptor.described(spark.createDataFrame(rows, "tensor_id string, shape array<bigint>, data array<double>")).persist()

    def ids(test):
        return {r.tensor_id for r in t.where(test).collect()}

    assert ids(descriptor.has_property("symmetric")) == {"sym", "eye", "diag"} and ids(descriptor.has_property("positive_definite")) == {"eye", "diag"}
    assert ids(descriptor.has_property("sparse")) == {"diag", "wide"} and ids(descriptor.has_property("square")) == {"sym", "eye", "diag"}
    assert ids(descriptor.norm_between(2.9, 3.1)) == {"vec"} and ids(descriptor.shape_is([3])) == {"vec"} and ids(descriptor.predicate("rank", "eq", 1)) == {"wide"}
    assert ids(descriptor.decomposition_candidate("cholesky")) == {"eye", "diag"} and ids(descriptor.matmul_compatible([5, 2])) == {"eye", "wide"}
    assert ids(descriptor.property_query(symmetric=True, min_norm=3)) == {"sym", "diag"} and ids(descriptor.predicate("nope", "eq", 1.0)) == set()
    with pytest.raises(ValueError):
        descriptor.predicate("rank", "eq", "two")
    assert descriptor.aggregate(t.limit(0), "min", "l1_norm").first().value == float("inf") and descriptor.aggregate(t, "count", "").first().value == 6
    assert descriptor.index_statistics(t).first()["symmetric_count"] == 3


def test_einsum_planner(spark):
    rng = np.random.default_rng(1)
    arrays = {"ij": rng.random((3, 4)), "jk": rng.random((4, 5)), "kl": rng.random((5, 2))}

    def cells(a):
        return spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(a) for i in [i]], ", ".join(f"i{k} long" for k in range(a.ndim)) + ", value double")

    for equation, names in (("ij,jk,kl->il", ["ij", "jk", "kl"]), ("ij,jk->", ["ij", "jk"]), ("ij->ji", ["ij"]), ("ij,jk", ["ij", "jk"]), ("ij,kl->ik", ["ij", "kl"])):
        want = np.einsum(equation, *[arrays[n] for n in names])
        got = elements.einsum(equation, *[cells(arrays[n]) for n in names])
        out = np.zeros(want.shape)
        for r in got.collect():
            out[tuple(r[:-1])] = r[-1]
        assert np.allclose(out, want), equation
    square = rng.random((4, 4))
    assert np.isclose(elements.einsum("ii->", cells(square)).first().value, np.trace(square))
    with pytest.raises(ValueError):
        elements.parse_equation("ij,jk->ix")


def test_outer_products_are_bounded(spark, monkeypatch):
    v = spark.createDataFrame([(i, float(i)) for i in range(4)], "i0 long, value double")
    assert elements.einsum("i,j->ij", v, v).count() == 16
    monkeypatch.setattr(elements, "OUTER", 15)
    with pytest.raises(ValueError):
        elements.einsum("i,j->ij", v, v)


def test_catalog(spark):
    rows = [("t1", "x", ["a", "b", "c"], {"project": "Alpha"}, 100.0), ("t2", "y", ["b", "c"], {}, 200.0), ("t3", "x", None, None, 150.0), ("t4", None, ["a", "b"], {"k": "v"}, None)]
    d = spark.createDataFrame(rows, "tensor_id string, owner string, tags array<string>, meta map<string,string>, bytes double")
    assert {r.key: r.value for r in catalog.grouped(d, "owner", "sum", "bytes").collect()} == {"x": 250, "y": 200, "N/A": 0}
    assert {r.key: r.value for r in catalog.grouped(d, "owner", "count").collect()} == {"x": 2, "y": 1, "N/A": 1}
    assert {r.tensor_id for r in d.where(catalog.has_tags("tags", ["a", "b"])).collect()} == {"t1", "t4"}
    assert {r.tensor_id for r in d.where(catalog.contains_any("alph", ["owner"], ["tags"], ["meta"])).collect()} == {"t1"}
    pairs = {(r.tag, r.partner): (r.n, r["rank"]) for r in catalog.co_occurring(d, "tags").collect()}
    assert pairs == {("a", "b"): (2, 1), ("b", "a"): (2, 1), ("b", "c"): (2, 2), ("c", "b"): (2, 1)}
    merged, summary = catalog.imported(d.limit(2), d, conflict="skip")
    assert merged.count() == 4 and {r.action: r.n for r in summary.collect()} == {"imported": 2, "skipped": 2}
    with pytest.raises(ValueError):
        catalog.complex_tensors(d, "a", "b", "c")
    copies, edges = catalog.new_versions(d, spark.createDataFrame([("t1", "t9", "2.0")], "tensor_id string, new_id string, version string"), owner="z")
    assert copies.first().tensor_id == "t9" and copies.first().owner == "z" and edges.first().parent == "t1"
    out = catalog.exported(d.select("tensor_id"), semantic=spark.createDataFrame([("t1", "n1"), ("t1", "n2")], "tensor_id string, name string"))
    assert {r.tensor_id: len(r.semantic) for r in out.collect()} == {"t1": 2, "t2": 0, "t3": 0, "t4": 0}


def test_lineage_with_a_cycle(spark):
    edges = spark.createDataFrame([(2, 1, "a"), (3, 2, "b"), (4, 3, "c"), (2, 4, "d"), (5, 3, "e")], "child long, parent long, operation_id string")
    start = spark.createDataFrame([(5,)], "node long")
    assert {(r.node, r.depth) for r in lineage.ancestors(edges, start).collect()} == {(3, 1), (2, 2), (1, 3), (4, 3)}
    assert {r.node for r in lineage.descendants(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {2, 3, 4, 5}
    assert lineage.shortest_path(spark, edges, 1, 5, 6).first().nodes == [1, 2, 3, 5]
    assert lineage.shortest_path(spark, edges, 5, 1, 6).count() == 0
    dot = lineage.dot(edges.where("child < 4"), spark.createDataFrame([("a", "add"), ("b", "mul")], "operation_id string, operation_type string")).first().dot
    assert '"1" -> "2" [label="add"];' in dot and '"1" [color=green];' in dot


def test_search(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    v = spark.createDataFrame([(i, r.tolist(), {"k": "a"} if i % 2 else {}) for i, r in enumerate(x)], "vec_id long, data array<double>, meta map<string,string>")
    order = np.argsort(((x - x[3]) ** 2).sum(1))[:5].tolist()
    assert [r.vec_id for r in search.nearest(v, x[3].tolist(), 5, "l2").orderBy("rank").collect()] == order
    got = search.knn_join(v.where("vec_id % 20 = 0"), v, 4, "l2").collect()
    for q in range(0, 300, 20):
        want = [i for i in np.argsort(((x - x[q]) ** 2).sum(1), kind="stable").tolist() if i != q][:4]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    assert v.where(search.matches_filter("meta", k="b")).count() == 150
    with pytest.raises(ValueError):
        search.hybrid(v, v, (0.5, 0.6))
    assert np.isclose(np.linalg.norm(spark.range(1).select(search.hashed_embedding(F.lit("some words here")).alias("e")).first().e), 1)


def test_ivf_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((8, 16))[rng.integers(0, 8, 800)] + 0.2 * rng.standard_normal((800, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, data array<double>")
    index, hit = vectors.Partitions(v, lists=8), 0
    for q in (1, 50, 700):
        exact = {r.vec_id for r in search.nearest(v, x[q].tolist(), 10, "l2").collect()}
        hit += len(exact & {r.vec_id for r in index.search(x[q].tolist(), 10, "l2", 3).collect()})
    assert hit >= 27


def test_codecs(spark):
    rows = [(1, [0.0, 1.0, -3.0, 0.5] * 6), (2, [7.0] * 24), (3, [1000.0 + i for i in range(24)]), (4, [0.0] * 23 + [5.0])]
    t = spark.createDataFrame(rows, "tensor_id long, data array<double>")
    for encode, decode in ((codecs.int8, codecs.from_int8), (codecs.sq8, codecs.from_sq8)):
        for r in t.withColumn("back", decode(encode("data"))).collect():
            assert np.abs(np.array(r.back) - r.data).max() <= (max(r.data) - min(r.data)) / 255 + 1e-9
    assert all(r.back == r.data for r in t.withColumn("back", codecs.from_sparse(codecs.sparse("data"), F.size("data"))).collect())
    assert all(r.back == r.data for r in t.withColumn("back", codecs.inflated(codecs.deflated("data"))).collect())
    assert t.select(codecs.float16("data").alias("h")).count() == 4
    assert {r.tensor_id: r.c for r in t.select("tensor_id", codecs.codec_choice("data", [4, 6]).alias("c")).collect()} == {1: "sq8", 2: "lowrank", 3: "lowrank", 4: "coo"}
    blocks = codecs.chunked(t, "tensor_id", 7)
    assert {r.tensor_id: r.data for r in codecs.rebuilt(blocks, "tensor_id").collect()} == dict(rows)
    assert {r.tensor_id: r.data for r in codecs.rebuilt(codecs.chunk_map(blocks, lambda x: x * 2), "tensor_id").collect()} == {i: [2 * x for x in d] for i, d in rows}
    with pytest.raises(PySparkException):
        codecs.rebuilt(blocks.where("chunk_index <> 1"), "tensor_id").collect()
    assert codecs.chunk_rows([1000, 256, 256], 4, 1) == 4 and codecs.chunk_settings(600) == (100, 6)


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.create("d", {"shape": [2, 2], "metadata": {"name": "str", "n": "int"}})
    ids = s.insert_tensors("d", [([[1, 2], [3, 4]], {"name": "a", "n": 1}), (np.eye(2), {"name": "b", "n": 2})])
    assert s.count("d") == 2 and s.datasets() == ["d"] and s.get("d", ids[0]).data == [1, 2, 3, 4]
    with pytest.raises(PySparkException):
        s.insert_tensors("d", [([1, 2, 3], {"name": "c", "n": 1})])
    with pytest.raises(PySparkException):
        s.insert_tensors("d", [(np.eye(2), {"name": "c"})])
    assert s.count("d") == 2
    with pytest.raises(store.DatasetError):
        s.create("d")
    s.update_metadata("d", ids[1], {"name": "z", "tags": ["p", "q"]})
    assert s.get("d", ids[1]).version == 2 and s.by_metadata("d", {"tags": "q"}).count() == 1 and s.by_metadata("d", {"gone": 1}).count() == 0
    assert s.query("d", lambda data, m: data[0] / (1 if m["name"] == "a" else 0) == 1).count() == 1
    s.snapshot("d", f"file://{tmp_path}/snap")
    s.delete("d", [ids[0]])
    with pytest.raises(store.DatasetError):
        s.get("d", ids[0])
    s.restore("d", f"file://{tmp_path}/snap")
    assert s.count("d") == 2 and s.page("d", 1, 1).count() == 1 and s.sample("d", 0).count() == 0 and s.sample("d", 9).count() == 2
    s.drop("d")
    assert s.datasets() == []
    with pytest.raises(store.DatasetError):
        s.read("d")
    with pytest.raises(store.DatasetError):
        store.flat([[1], [1, 2]])


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\nbad,3\n4.5,6\n")
    (tmp_path / "b.csv").write_text("x\nnope\n")
    rows = store.read_csv(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].shape == [2, 2] and rows[0].data == [1, 2, 4.5, 6]


def test_change_feed_stream(spark, tmp_path):
    schema = "seq long, op string, tensor_id long, record string"
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")

    def push(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)

    def run():
        feeds.replicate(feeds.watch_folder(spark, feed, schema, "parquet"), out, str(tmp_path / "cp")).awaitTermination(120)

    push([(1, "put", 1, "a"), (2, "put", 2, "b"), (3, "put", 1, "c")])
    run()
    push([(4, "delete", 2, None), (5, "put", 3, "d"), (3, "put", 1, "c")])
    run()
    run()
    assert {(r.tensor_id, r.record) for r in feeds.replica(spark, out, 1).collect()} == {(1, "c"), (3, "d")}
    assert feeds.head(spark.read.parquet(feed)).first().head == 5


def test_streams_of_events(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = feeds.tumbling(stream.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == events.count()


def test_series(spark):
    g = series.generated(spark, 60)
    assert g.count() == 60 and g.agg(F.min("close")).first()[0] >= 1
    rows = spark.createDataFrame([(1, [3], [1.0, 2.0, 3.0], '{"name":"s","dates":["2024-01-01","2024-01-02","2024-01-03"]}')], "seq long, shape array<bigint>, data array<double>, metadata string")
    assert [r.ts for r in series.loaded(rows, "s").orderBy("pos").collect()] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    best = series.random_search(spark, 200, lambda x: (x - 0.3) ** 2, {"x": (0.0, 1.0)}).first()
    assert abs(best.x - 0.3) < 0.05


def test_ancestors_of_all_parts(spark, sf):
    from tensorloom.queries import tables

    keys = {r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
    want = set()
    for k in keys:
        node, depth = k, 0
        while node > 1 and node in keys:
            node, depth = node // 2, depth + 1
            want.add((k, node, depth))
    rows = tables.lineage_ancestors(spark, sf).collect()
    assert len(rows) == len(want) and {(r.origin, r.node, r.depth) for r in rows} == want
    lines = [r.line for r in tables.lineage_dot(spark, sf).orderBy("part", "line").collect()]
    arrows = [f'"{k // 2}" -> "{k}" [' for k in keys if k > 1]
    assert lines[0] == "digraph lineage {" and lines[-1] == "}" and len(lines) == len(arrows) + 3
    assert all(any(a in line for line in lines) for a in arrows)


def test_covariance_and_correlation_of_all_positions(spark, sf):
    from tensorloom.queries import tensors

    x = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()], float)
    for run, name, want in ((tensors.cov_pairs, "cov", np.cov(x.T)), (tensors.corr_pairs, "corr", np.corrcoef(x.T))):
        rows = run(spark, sf).collect()
        assert {(r.a, r.b) for r in rows} == {(a, b) for b in range(64) for a in range(b + 1)} and len(rows) == 2080
        assert all(abs(r[name] - want[r.a, r.b]) < 2e-6 for r in rows)


def test_lineage_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i, "a") for i in range(70)], "child long, parent long, operation_id string").coalesce(1)
    end = spark.createDataFrame([(70,)], "node long")
    assert sorted(r.depth for r in lineage.ancestors(edges, end).collect()) == list(range(1, 71))
    assert lineage.recursive_closure(spark, edges, 70, depth=5).count() == 5
    assert lineage.shortest_path(spark, edges, 52, 70).first().nodes == list(range(52, 71))


def test_a_closure_deals_the_pairs_of_a_node(spark, monkeypatch):
    """A node that many ways pass through makes its pairs in several parts; the depths are those of the whole."""
    from tensorloom.operators import lineage

    monkeypatch.setattr(lineage, "PART", 40)
    monkeypatch.setattr(lineage, "ROWS", 500)
    chain = [(i, i + 1) for i in range(12)] + [(100 + i, 0) for i in range(90)] + [(12, 5), (3, 7)]
    edges = spark.createDataFrame(chain, "child long, parent long")
    first = spark.createDataFrame(chain, "origin long, _by long").where("_by = 0")
    rest = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (5, 6, 1)], "_by long, node long, _more int")
    joined, n = lineage._by_parts(first, rest)
    rows = joined.collect()
    assert n == len(rows) == len({(r.origin, r.node) for r in rows}) == 180 and len({r._part for r in rows}) > 2
    got = {(r.origin, r.node): r.depth for r in lineage.ancestors(edges, edges.select(F.col("child").alias("node")).distinct()).collect()}
    ways, want = {}, {}
    for c, p in chain:
        ways.setdefault(c, []).append(p)
    for origin in ways:
        level, depth, met = {origin}, 0, {origin}
        while level:
            depth += 1
            level = {p for c in level for p in ways.get(c, [])} - met
            met |= level
            want |= {(origin, p): depth for p in level}
    assert got == want
