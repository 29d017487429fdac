import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tensorloom.functions import codecs
from tensorloom.operators import named
from tensorloom.plans import tools
from tensorloom.sources import store as S


@pytest.fixture
def store(spark, tmp_path):
    out = S.Store(spark, f"file://{tmp_path}/store")
    for name in ("a", "b"):
        out.create(name)
        out.insert_tensors(name, [([1.0 + k, 2.0], {"record_id": f"{name}{k}", "k": k}) for k in range(4)])
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "tensor_id string, shape array<bigint>, data array<double>")


def gone(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "tensor_id string")


def values(store, name, **how):
    return {r.tensor_id: (r.data, r.version) for r in store.read(name, **how).collect()}


def test_batch_updates_write_few_rows(spark, store):
    store.batch_update("a", table(spark, [("a1", [2], [9.0, 9.0]), ("a3", [1], [7.0])]))
    assert values(store, "a") == {"a0": ([1.0, 2.0], 1), "a1": ([9.0, 9.0], 2), "a2": ([3.0, 2.0], 1), "a3": ([7.0], 2)}
    assert json.loads(store.get("a", "a1").metadata)["k"] == 1  # kept, as none was given
    with pytest.raises(PySparkException):
        store.batch_update("a", table(spark, [("nobody", [1], [1.0])]))
    store.delete("a", ["a0", "nobody"])
    store.delete("a", gone(spark, "a2"))
    assert set(values(store, "a")) == {"a1", "a3"}
    store.insert("a", table(spark, [("a0", [1], [5.0])]))  # an id may come again
    assert values(store, "a")["a0"] == ([5.0], 1)


def test_versions_and_compaction(spark, store):
    before = store.versions("a")[-1]
    store.delete("a", ["a0"])
    store.update_metadata("a", "a1", {"k": 11})
    store.compact("a")
    assert set(values(store, "a")) == {"a1", "a2", "a3"} and store.get("a", "a1").version == 2
    assert set(values(store, "a", version=before)) == {"a0", "a1", "a2", "a3"}
    with pytest.raises(S.DatasetError):
        store.read("a", version=99)


def test_a_transaction_is_seen_whole_or_not_at_all(spark, store):
    with store.transaction() as t:
        t.update("a", table(spark, [("a0", [1], [0.0])]))
        t.delete("b", gone(spark, "b0"))
        t.insert("b", table(spark, [("new", [1], [4.0])]))
        assert len(values(store, "b")) == 4  # nothing is seen before the end
    assert values(store, "a")["a0"] == ([0.0], 2) and set(values(store, "b")) == {"b1", "b2", "b3", "new"}
    with pytest.raises(RuntimeError):
        with store.transaction() as t:
            t.delete("a", gone(spark, "a0"))
            raise RuntimeError("changed my mind")
    with pytest.raises(PySparkException):
        with store.transaction() as t:
            t.delete("a", gone(spark, "a0"))
            t.insert("b", table(spark, [("bad", [3], [1.0])]))  # data and shape differ
    assert "a0" in values(store, "a") and len(values(store, "b")) == 4


def test_of_two_writers_one_wins(spark, store):
    first, second = store.transaction(), store.transaction()
    first.delete("a", gone(spark, "a0"))
    second.delete("a", gone(spark, "a1"))
    second.delete("b", gone(spark, "b1"))
    first.commit()
    with pytest.raises(S.Conflict):
        second.commit()
    assert set(values(store, "a")) == {"a1", "a2", "a3"} and "b1" in values(store, "b")
    other = S.Store(spark, store.root)
    pointer = other._pointer("a")
    number = other._number("a")
    new = other._changes("a", pointer, number, [("gone", gone(spark, "a1"))])
    store.delete("a", ["a2"])
    with pytest.raises(S.Conflict):
        other._point("a", number, new)
    assert set(values(store, "a")) == {"a1", "a3"}


def test_a_writer_that_died_blocks_nobody(spark, store):
    t = store.transaction()
    t.delete("a", gone(spark, "a0"))
    number = store._number("a")
    store._point("a", number, store._changes("a", t.base["a"], number, t.changes["a"]), t.id)  # and no decision
    assert len(values(store, "a")) == 4
    store.delete("a", ["a1"])
    assert set(values(store, "a")) == {"a0", "a2", "a3"} and store._decision(t.id) == "aborted"
    assert not store._create(f"{store.root}/_transactions/{t.id}", "committed")


@pytest.mark.parametrize("preset", list(codecs.PRESETS))
def test_presets(spark, tmp_path, preset):
    s = S.Store(spark, f"file://{tmp_path}/p")
    s.create("d", preset=preset)
    data = [float(k * k - 50) for k in range(20)]
    s.insert("d", table(spark, [("x", [20], data), ("none", [0], []), ("same", [3], [2.0] * 3), ("odd", [2], [float("nan"), 1.0])]))
    back = values(s, "d")
    step = {"int8": (max(data) - min(data)) / 255, "float16": 0.25}.get(codecs.preset(preset)[1], 0)
    assert max(abs(x - y) for x, y in zip(back["x"][0], data)) <= 1.5 * step and back["none"][0] == [] and back["same"][0] == [2.0] * 3 and back["odd"][0][1] == 1.0
    stats = s.compression_stats("d").first()
    assert stats.total == 4 and stats.original_bytes == 100 and (stats.ratio > 0) and (stats.compressed == 2) == (codecs.preset(preset)[1] == "int8")
    rows = spark.createDataFrame([("x", data, "float64"), ("none", [], "float64")], "id string, data array<double>, dtype string")
    packed = codecs.compressed(rows, preset)
    again = {r.id: r.data for r in codecs.decompressed(packed).collect()}
    assert max(abs(x - y) for x, y in zip(again["x"], data)) <= 1.5 * step + 1e-12 and not again["none"]
    assert all(r.original_bytes == 8 * len({"x": data, "none": []}[r.id]) for r in packed.collect())


def test_presets_by_name_and_stats_of_nothing(spark, tmp_path):
    with pytest.raises(ValueError):
        codecs.preset("tiny")
    s = S.Store(spark, f"file://{tmp_path}/p")
    with pytest.raises(S.DatasetError):
        s.create("d", preset="tiny")
    s.create("d")
    assert tuple(s.compression_stats("d").first()) == (0, 0, 0, 0, "", 1.0)


def test_tracked_operations_cache_and_audit(spark, store):
    t = named.Tracker(store, "ann")
    one = t.run("subtract", "a", [("a0", "a1")], "out")
    other = t.run("subtract", "a", [("a1", "a0")], "out")  # the order of the inputs matters
    assert store.get("out", one[0]).data == [-1.0, 0.0] and store.get("out", other[0]).data == [1.0, 0.0]
    assert t.run("subtract", "a", [("a0", "a1")], "out") == one and t.cache_stats()["hits"] == 1
    store.update_metadata("a", "a0", {})  # another version: asked anew
    assert t.run("subtract", "a", [("a0", "a1")], "out") != one
    with pytest.raises(S.DatasetError):
        t.run("norm", "a", [("a0",), ("nobody",)], "out")
    with pytest.raises(PySparkException):
        t.run("inverse", "a", [("a0",)], "out")
    with pytest.raises(named.OperationError):
        t.run("no such", "a", [("a0",)])
    log = {(r.operation_type, r.status): r.n for r in t.operations().groupBy("operation_type", "status").agg(F.count("*").alias("n")).collect()}
    assert log == {("subtract", "completed"): 3, ("norm", "failed"): 1, ("inverse", "failed"): 1, ("no such", "failed"): 1}
    assert {(r.child, r.parent) for r in t.edges().where(F.col("child") == one[0]).collect()} == {(one[0], "a0"), (one[0], "a1")}
    assert store.count("out") == 3 and json.loads(store.get("out", one[0]).metadata)["parents"] == ["a0", "a1"]
    t.log_event("delete", "a0", reason="test")
    assert [(r.user, r.action, r.tensor_id) for r in t.audit().collect()] == [("ann", "delete", "a0")]
    t.clear()
    assert t.cache_stats()["entries"] == 0 and t.benchmark("norm", "a", [("a1",), ("a2",)], 2)["iterations"] == 2


def test_operators_by_name(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], [2, 2], [2.0, 0.0, 0.0, 2.0], [2, 2])], "id int, data array<double>, shape array<bigint>, data2 array<double>, shape2 array<bigint>")
    one = rows.drop("data2", "shape2")

    def run(name, second=False, **p):
        r = named.apply(name, rows if second else one, second, **p).first()
        return r.data, r.shape

    assert run("matmul", True) == ([2.0, 4.0, 6.0, 8.0], [2, 2]) and run("transpose") == ([1.0, 3.0, 2.0, 4.0], [2, 2])
    assert run("add", value=1.0) == ([2.0, 3.0, 4.0, 5.0], [2, 2]) and run("divide", True)[0][0] == 0.5
    assert run("determinant")[0][0] == pytest.approx(-2) and run("sum") == ([10.0], []) and run("sum_dim", dim=0) == ([4.0, 6.0], [2])
    assert run("reshape", shape=[4]) == ([1.0, 2.0, 3.0, 4.0], [4]) and run("outer", True)[1] == [2, 2, 2, 2] and run("flatten")[1] == [4]
    assert run("concatenate", True)[1] == [4, 2] and run("stack", True, dim=2)[1] == [2, 2, 2] and run("einsum", True, equation="ij,jk->ik")[0] == [2.0, 4.0, 6.0, 8.0] and run("permute", dims=[1, 0])[0] == [1.0, 3.0, 2.0, 4.0]
    assert run("sum_dim", dim=5) == (None, None)  # a kernel that fails gives nothing
    for bad in (lambda: run("matmul"), lambda: run("sum", True), lambda: run("sum", axis=1), lambda: run("what")):
        with pytest.raises(named.OperationError):
            bad()


def test_workflows():
    functions = {"one": lambda: {"x": 1}, "plus": lambda a, b: {"x": a + b}, "all": lambda parts: sum(parts)}
    tasks = {"d": {"call": "all", "arguments": {"parts": ["$a.x", "$c.x"]}}, "c": {"call": "plus", "arguments": {"a": "$a.x", "b": 5}}, "a": {"call": "one"}, "e": {"call": "one", "needs": ["d"]}}
    assert named.rounds(tasks) == [["a"], ["c"], ["d"], ["e"]] and named.workflow(tasks, functions)["d"] == 7
    with pytest.raises(named.WorkflowError, match="deadlock"):
        named.rounds({"a": {"call": "one", "needs": ["b"]}, "b": {"call": "one", "needs": ["a"]}, "c": {"call": "one"}})
    with pytest.raises(named.WorkflowError, match="unknown tasks"):
        named.rounds({"a": {"call": "one", "needs": ["z"]}})
    with pytest.raises(named.WorkflowError):
        named.workflow({"a": {"call": "nothing"}}, functions)


def test_tensor_workflow_stops_where_a_step_fails(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], [2], 0.1), (2, [3.0, 4.0], [2], 0.9), (3, [5.0, 6.0], [2], 0.9)], "tensor_id long, data array<double>, shape array<bigint>, score double")
    steps, edges = named.tensor_workflow(rows, [("multiply", {"value": 2.0}), ("unheard of", {}), ("inverse", {}), ("sum", {})])
    assert [(r.operation, r.data) for r in steps.orderBy("step").collect()] == [("input", [3.0, 4.0]), ("multiply", [6.0, 8.0])]
    assert [tuple(r) for r in edges.collect()] == [("2:1", "2", "multiply")]


def test_tools_and_agents(store):
    kit = tools.toolset(store)
    assert json.loads(kit["list_datasets"].execute({})) == ["a", "b"] and len(json.loads(kit["scan"].execute({"dataset": "a", "limit": 2}))) == 2
    assert [r["tensor_id"] for r in json.loads(kit["property_search"].execute('{"dataset": "a", "field": "max", "op": ">", "value": 3}'))] == ["a3"]
    assert json.loads(kit["aggregate"].execute({"dataset": "a", "function": "count"})) == 4 and len(json.loads(kit["query"].execute({"text": "find tensors from b where k > 1"}))) == 2
    for bad in ({}, {"dataset": 5}, {"dataset": "a", "limit": "x"}, {"dataset": "a", "what": 1}):
        with pytest.raises(tools.ToolError):
            kit["scan"].execute(bad)

    def decide(task, steps):
        if not steps:
            return {"tool": "nothing"}
        if len(steps) == 1:
            return {"tool": "get", "arguments": {"dataset": "a", "tensor_id": "zzz"}}
        if len(steps) == 2:
            return {"tool": "aggregate", "arguments": {"dataset": "a", "function": "count"}}
        return {"answer": f"{task}: {steps[-1]['observation']}"}

    out = tools.react("how many", kit, decide)
    assert out["answer"] == "how many: 4.0" and out["steps"][0]["observation"].startswith("unknown tool") and out["steps"][1]["observation"].startswith("error")
    assert tools.react("never", kit, lambda task, steps: {"tool": "list_datasets"}, 2)["answer"] is None

    def broken(prompt):
        raise OSError("down")

    assert tools.routed([("dear", 9.0, str.upper), ("cheap", 1.0, broken), ("fair", 2.0, str.upper)], "hi", 5.0) == ("fair", "HI")
    with pytest.raises(tools.ToolError):
        tools.routed([("cheap", 1.0, broken), ("dear", 9.0, str.upper)], "hi", 5.0)
