import pytest
from pyspark.sql import functions as F

from tensorloom.functions import dense as D
from tensorloom.operators import indexes

ROWS = [(1, "red", 3, 2.5), (2, "red", None, 7.0), (3, None, 3, -1.0), (4, "blue", 3, 2.5), (5, "blue", 4, None), (6, "green", 4, 1e9)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "id bigint, colour string, size int, price double")


def ids(df):
    return sorted(r.id for r in df.collect())


def folder(tmp_path, name):
    return f"file://{tmp_path}/{name}"


def test_equality_with_nulls_and_removals(spark, rows, tmp_path):
    index = indexes.HashIndex(spark, folder(tmp_path, "h"), "id", {"colour": "string"}, 4)
    assert index.search(colour="red").count() == 0  # nothing inserted yet
    index.insert(rows)
    assert ids(index.search(colour="red")) == [1, 2] and ids(index.search(colour="none")) == []
    index.remove(rows.where("id = 2"))
    assert ids(index.search(colour="red")) == [1] and ids(index.rows()) == [1, 3, 4, 5, 6]
    index.insert(rows.where("id = 2").withColumn("colour", F.lit("blue")))  # what comes after a removal stays
    assert ids(index.search(colour="blue")) == [2, 4, 5] and ids(index.full_scan(colour="blue")) == [2, 4, 5]
    assert index.statistics().first().entries == 6 and ids(index.compacted(folder(tmp_path, "h2")).search(colour="blue")) == [2, 4, 5]


def test_a_lookup_reads_one_bucket(spark, rows, tmp_path):
    index = indexes.HashIndex(spark, folder(tmp_path, "h"), "id", {"colour": "string"}, 8)
    index.insert(rows)
    plan = index.search(colour="red")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and "PushedFilters: [IsNotNull(colour), EqualTo(colour,red)]" in plan


@pytest.mark.parametrize(("low", "high", "open_low", "want"), [(2.5, 7.0, False, [1, 2, 4]), (2.5, 7.0, True, [2]), (None, 0.0, False, [3]), (8.0, None, False, [6]), (5.0, 4.0, False, []), (None, None, False, [1, 2, 3, 4, 6])])
def test_intervals(spark, rows, tmp_path, low, high, open_low, want):
    index = indexes.RangeIndex(spark, folder(tmp_path, "r"), "id", "price")
    index.insert(rows.where("id <= 3"))
    index.insert(rows.where("id > 3"))
    assert ids(index.search(low=low, high=high, include_low=not open_low)) == want
    assert ids(index.lookup(2.5)) == [1, 4] and index.range_count(0, 10).first().n == 3


def test_an_interval_pushes_its_bounds_down(spark, rows, tmp_path):
    index = indexes.RangeIndex(spark, folder(tmp_path, "r"), "id", "price")
    index.insert(rows)
    plan = index.range(1.0, 3.0)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(price,1.0)" in plan and "LessThanOrEqual(price,3.0)" in plan


@pytest.mark.parametrize(("wanted", "want"), [({"colour": "red", "size": 3}, [1]), ({"colour": None, "size": 3}, [1, 3, 4]), ({"colour": "blue", "size": None}, [4, 5]), ({"colour": None, "size": None}, [1, 2, 3, 4, 5, 6])])
def test_none_stands_for_any_value(spark, rows, tmp_path, wanted, want):
    index = indexes.CompositeIndex(spark, folder(tmp_path, "c"), "id", {"colour": "string", "size": "int"})
    index.insert(rows)
    assert ids(index.search(**wanted)) == want


def test_shapes_and_properties(spark, tmp_path):
    shapes = [(1, [2, 3], [1.0] * 6), (2, [6], [2.0] * 6), (3, [], [5.0]), (4, [2, 3, 1], [0.0] * 6), (5, [3, 2], [-1.0] * 6)]
    rows = spark.createDataFrame(shapes, "id bigint, shape array<bigint>, data array<double>")
    index = indexes.SpatialIndex(spark, folder(tmp_path, "s"), "id")
    index.insert(rows)
    assert ids(index.search(shape=[2, 3])) == [1] and ids(index.search(shape=[])) == [3] and ids(index.search(ndim=2)) == [1, 5]
    assert ids(index.search(elements=(6, 6))) == [1, 2, 4, 5] and ids(index.search(aspect=(1.4, 1.6))) == [1, 5]
    sums = indexes.PropertyIndex(spark, folder(tmp_path, "p"), "id", "total", lambda data, shape: D.total(data))
    sums.insert(rows)
    assert ids(sums.range(0, 6)) == [1, 3, 4]


def test_builder_orders_conditions_and_intersects(spark, rows, tmp_path):
    colours = indexes.HashIndex(spark, folder(tmp_path, "h"), "id", {"colour": "string"})
    prices = indexes.RangeIndex(spark, folder(tmp_path, "r"), "id", "price")
    for index in (colours, prices):
        index.insert(rows)
    builder = indexes.QueryBuilder("id").given(prices, low=0.0, high=5.0).given(colours, colour="red")
    assert builder.plan() == ["HashIndex(colour)", "RangeIndex(low, high)"]
    assert ids(builder.execute()) == [1] and ids(builder.execute_any()) == [1, 2, 4]
    with pytest.raises(ValueError):
        indexes.QueryBuilder("id").execute()


def test_postings_are_dealt_and_sorted_once(spark, tmp_path, monkeypatch):
    """What an insert writes passes one exchange by ranges, not one more before it."""
    plans = []
    laid = indexes.PostingIndex.laid_out
    monkeypatch.setattr(indexes.PostingIndex, "laid_out", lambda self, entries: plans.append(laid(self, entries)) or plans[-1])
    index = indexes.PostingIndex(spark, f"file://{tmp_path}/words")
    index.insert(spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string"))
    plan = plans[0][0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("Sort [") == 1
    assert {(r.doc_id, round(r.score, 2)) for r in index.scores("b a").collect()} == {(1, 2.03), (2, 1.01)}
