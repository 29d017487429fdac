import numpy as np
import pytest

from tensorloom import model
from tensorloom.operators import indexes, linalg, series, vectors
from tensorloom.sources.store import Store
from tensorloom.streaming import feeds


def test_a_watched_folder_is_read_once(spark, tmp_path):
    source, target = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()

    def run():
        rows = feeds.watch_folder(spark, str(source), "id int, value double", header="true")
        good, _ = feeds.validated(rows, ["id", "value"])
        good.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start(target).awaitTermination()
        return sorted(r.id for r in spark.read.schema("id int, value double").parquet(target).collect())

    (source / "a.csv").write_text("id,value\n1,0.5\n2,\n")
    assert run() == [1]
    assert run() == [1]  # nothing new
    (source / "b.csv").write_text("id,value\n3,1\n")
    assert run() == [1, 3]


def test_compaction_waits_for_enough_rows(spark):
    base, delta = spark.createDataFrame([(1, "a"), (2, "b")], "vec_id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "vec_id int, v string")
    gone = spark.createDataFrame([(1,)], "vec_id int")
    same = feeds.compacted(base, delta, gone, capacity=10)
    assert same[0].count() == 2 and same[1].count() == 2
    after, rest, left = feeds.compacted(base, delta, gone, capacity=2)
    assert sorted(map(tuple, after.collect())) == [(2, "c"), (3, "d")] and rest.count() == left.count() == 0


def test_predictions_are_stored_with_their_provenance(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    forecasts = spark.createDataFrame([("x", 2, 2.0), ("x", 1, 1.0), ("y", 1, 5.0)], "name string, step int, value double")
    series.store_predictions(store, forecasts, "f", "sales", "ar", "name", p=2)
    row = store.get("f", "sales:ar:x")
    assert row.data == [1.0, 2.0] and '"parameters":"{\\"p\\": 2}"' in row.metadata


def test_sketches_give_the_direct_similarities(spark, tmp_path, sf):
    v = model.vectors(spark, sf)
    index = vectors.Sketches(spark, f"file://{tmp_path}/k", 2, "vec_id")
    index.insert(v, [8, 8])
    rows = {r.vec_id: np.array(r.data).reshape(8, 8) for r in v.collect()}
    got = {r.vec_id: r.score for r in index.search(rows[3], 200).collect()}
    assert all(np.isclose(s, linalg.contraction_similarity(rows[i], rows[3], 2)) for i, s in got.items()) and max(got, key=got.get) == 3
    with pytest.raises(ValueError):
        index.insert(v, [4, 4, 4])
    with pytest.raises(ValueError):
        index.search(np.ones((4, 4)))


def test_maintenance_writes_anew_when_there_is_much_to_skip(spark, tmp_path):
    index = indexes.RangeIndex(spark, f"file://{tmp_path}/r", "id", "x")
    index.insert(spark.range(20).selectExpr("id", "CAST(id AS DOUBLE) AS x"))
    assert indexes.maintained(index, f"file://{tmp_path}/new", 5) is index
    index.remove(spark.range(10))
    fresh = indexes.maintained(index, f"file://{tmp_path}/new", 5)
    assert fresh is not index and sorted(r.id for r in fresh.range(0, 12).collect()) == [10, 11, 12]
