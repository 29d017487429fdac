"""Indexes, the store, named operators, workflows, vector indexes, embeddings, metrics and tenants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tensorloom import model
from tensorloom.functions import codecs
from tensorloom.functions import dense as D
from tensorloom.operators import embeddings, indexes, lineage, metrics, named, search, vectors
from tensorloom.plans import tenancy
from tensorloom.queries import search as searching
from tensorloom.queries import tables
from tensorloom.queries import tensors as base
from tensorloom.sources.cut import written
from tensorloom.sources.store import Store
from tensorloom.streaming import feeds

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# indexes: two batches of parts, then every seventh is removed


def part(spark, sf):
    return model.read(spark, sf, "part")


def _filled(index, rows):
    index.insert(rows.where("p_partkey % 2 = 0"))
    index.insert(rows.where("p_partkey % 2 = 1"))
    index.remove(rows.where("p_partkey % 7 = 0").select("p_partkey"))
    return index


def _brands(spark, sf):
    return _filled(indexes.HashIndex(spark, indexes.folder_for(spark, "hash"), "p_partkey", {"p_brand": "string"}), part(spark, sf))


def _prices(spark, sf):
    return _filled(indexes.RangeIndex(spark, indexes.folder_for(spark, "range"), "p_partkey", "p_retailprice"), part(spark, sf))


def _pairs(spark, sf):
    return _filled(indexes.CompositeIndex(spark, indexes.folder_for(spark, "pairs"), "p_partkey", {"p_brand": "string", "p_size": "int"}), part(spark, sf))


def _shapes(spark, sf):
    rows = part(spark, sf).select("p_partkey", F.array(F.col("p_size").cast("bigint"), F.lit(4).cast("bigint")).alias("shape"))
    return _filled(indexes.SpatialIndex(spark, indexes.folder_for(spark, "shapes"), "p_partkey"), rows)


_LIVE = "SELECT * FROM part WHERE p_partkey % 7 <> 0"


@query(f"SELECT p_partkey, p_brand FROM ({_LIVE}) WHERE p_brand = 'Brand#11'")
def idx_hash(spark, sf):
    return _brands(spark, sf).search(p_brand="Brand#11")


@query(f"SELECT p_partkey, p_retailprice FROM ({_LIVE}) WHERE p_retailprice BETWEEN 910 AND 930")
def idx_range(spark, sf):
    return _prices(spark, sf).range(910.0, 930.0)


@query(f"SELECT CAST(count(*) AS BIGINT) AS n FROM ({_LIVE}) WHERE p_retailprice BETWEEN 950 AND 960.05")
def idx_range_count(spark, sf):
    return _prices(spark, sf).range_count(950.0, 960.05)


@query(f"SELECT p_partkey, p_retailprice FROM ({_LIVE}) WHERE p_retailprice = 925.5")
def idx_point(spark, sf):
    """After compaction: one batch, no tombstones."""
    return _prices(spark, sf).compacted(indexes.folder_for(spark, "range")).lookup(925.5)


@query(f"SELECT 'any brand' AS q, p_partkey FROM ({_LIVE}) WHERE p_size = 10 UNION ALL SELECT 'any size', p_partkey FROM ({_LIVE}) WHERE p_brand = 'Brand#12' UNION ALL SELECT 'both', p_partkey FROM ({_LIVE}) WHERE p_brand = 'Brand#12' AND p_size = 10")
def idx_composite(spark, sf):
    index = _pairs(spark, sf)
    asked = {"any brand": {"p_brand": None, "p_size": 10}, "any size": {"p_brand": "Brand#12", "p_size": None}, "both": {"p_brand": "Brand#12", "p_size": 10}}
    return reduce(lambda a, b: a.union(b), [index.search(**w).select(F.lit(q).alias("q"), "p_partkey") for q, w in asked.items()])


@query(f"SELECT p_partkey FROM ({_LIVE}) WHERE 4 * p_size BETWEEN 40 AND 120 AND greatest(p_size, 4) / least(p_size, 4) BETWEEN 3 AND 6")
def idx_shapes(spark, sf):
    return _shapes(spark, sf).search(ndim=2, elements=(40, 120), aspect=(3.0, 6.0)).select("p_partkey")


@query(f"SELECT p_partkey FROM ({_LIVE}) WHERE p_size = 12")
def idx_exact_shape(spark, sf):
    return _shapes(spark, sf).search(shape=[12, 4]).select("p_partkey")


@query(f"WITH {base.L1} SELECT vec_id FROM n WHERE l1 BETWEEN 6.3 AND 6.5")
def idx_property(spark, sf):
    v = model.vectors(spark, sf).withColumn("shape", F.array(F.lit(64).cast("bigint")))
    index = indexes.PropertyIndex(spark, indexes.folder_for(spark, "property"), "vec_id", "l1", lambda data, shape: D.l1_norm(data))
    index.insert(v)
    return index.range(6.3, 6.5).select("vec_id")


@query(f"WITH l AS ({_LIVE}) SELECT 'HashIndex' AS index, CAST(count(*) AS BIGINT) AS entries, CAST(count(DISTINCT p_partkey) AS BIGINT) AS keys, CAST(count(DISTINCT p_brand) AS BIGINT) AS values FROM l UNION ALL SELECT 'RangeIndex', count(*), count(DISTINCT p_partkey), count(DISTINCT p_retailprice) FROM l UNION ALL SELECT 'CompositeIndex', count(*), count(DISTINCT p_partkey), count(DISTINCT (p_brand, p_size)) FROM l")
def idx_statistics(spark, sf):
    return reduce(lambda a, b: a.union(b), [i(spark, sf).statistics().drop("lookups") for i in (_brands, _prices, _pairs)])


@query(f"SELECT p_partkey FROM ({_LIVE}) WHERE p_brand = 'Brand#11' AND p_retailprice < 960 AND p_size * 4 <= 100")
def query_builder(spark, sf):
    builder = indexes.QueryBuilder("p_partkey").given(_shapes(spark, sf), elements=(0, 100)).given(_prices(spark, sf), high=960.0, include_high=False).given(_brands(spark, sf), p_brand="Brand#11")
    return builder.execute()


@query(f"SELECT p_partkey FROM ({_LIVE}) WHERE p_brand = 'Brand#11' OR p_retailprice >= 990")
def query_builder_any(spark, sf):
    return indexes.QueryBuilder("p_partkey").given(_prices(spark, sf), low=990.0).given(_brands(spark, sf), p_brand="Brand#11").execute_any()


# the store


def _store(spark) -> Store:
    return Store(spark, indexes.folder_for(spark, "store"))


def _tensors(rows, key: str, data, shape):
    return rows.select(F.col(key).cast("string").alias("tensor_id"), data.alias("data"), F.array(*[F.lit(d).cast("bigint") for d in shape]).alias("shape"))


def _part_store(spark, sf) -> Store:
    """Parts as tensors of two elements, those of odd keys and those of even ones."""
    store = _store(spark)
    rows = part(spark, sf)
    for name, own in (("even", "p_partkey % 2 = 0"), ("odd", "p_partkey % 2 = 1")):
        store.create(name)
        store.insert(name, _tensors(rows.where(own), "p_partkey", F.array(F.col("p_size").cast("double"), "p_retailprice"), [2]))
    return store


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, CAST(p_partkey AS VARCHAR) AS tensor_id, CASE WHEN p_partkey % 2 = 0 AND p_size > 40 THEN -1.0 ELSE CAST(p_size AS DOUBLE) END AS first, CAST(CASE WHEN p_partkey % 2 = 0 AND p_size > 40 THEN 2 ELSE 1 END AS BIGINT) AS version FROM part WHERE p_partkey % 2 = 0 OR p_retailprice <= 950")
def batch_commit(spark, sf):
    """One transaction over two datasets: large even parts are replaced, dear odd ones removed."""
    store = _part_store(spark, sf)
    rows = part(spark, sf)
    with store.transaction() as t:
        t.update("even", _tensors(rows.where("p_partkey % 2 = 0 AND p_size > 40"), "p_partkey", F.array(F.lit(-1.0), F.lit(0.0)), [2]))
        t.delete("odd", rows.where("p_partkey % 2 = 1 AND p_retailprice > 950").select(F.col("p_partkey").alias("tensor_id")))
    return store.read("even").unionByName(store.read("odd")).select("dataset", "tensor_id", F.get("data", F.lit(0)).alias("first"), "version")


@query("SELECT 'before' AS at, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'after', count(*) FROM part WHERE p_partkey % 2 = 0 AND p_size <= 25 UNION ALL SELECT 'compacted', count(*) FROM part WHERE p_partkey % 2 = 0 AND p_size <= 25")
def store_versions(spark, sf):
    """Counts of an older version, after a removal, and after compaction."""
    store = _part_store(spark, sf)
    old = store.versions("even")[-1]
    store.delete("even", part(spark, sf).where("p_size > 25").select(F.col("p_partkey").alias("tensor_id")))
    after = store.read("even")
    store.compact("even")
    each = {"before": store.read("even", old), "after": after, "compacted": store.read("even")}
    return reduce(lambda a, b: a.union(b), [rows.agg(F.count("*").alias("n")).select(F.lit(at).alias("at"), "n") for at, rows in each.items()])


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS compressed, CAST(256 * count(*) AS BIGINT) AS original_bytes, CAST(88 * count(*) AS BIGINT) AS compressed_bytes, 'int8' AS algorithms, round(256 / 88, 6) AS ratio FROM embeddings")
def compression_stats(spark, sf):
    store = _store(spark)
    store.create("v", preset="int8_only")
    store.insert("v", _tensors(model.vectors(spark, sf), "vec_id", F.col("data"), [64]))
    return store.compression_stats("v").withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {base.CELLS}, r AS (SELECT vec_id, (max(v) - min(v)) / 255 AS s FROM c GROUP BY vec_id) SELECT vec_id, CAST(64 AS INTEGER) AS n, true AS within FROM r")
def decompress_on_read(spark, sf):
    """Stored as int8, read as numbers again: within half a step, and a little for the whole-numbered zero point."""
    store = _store(spark)
    store.create("v", preset="int8_only")
    v = model.vectors(spark, sf)
    store.insert("v", _tensors(v, "vec_id", F.col("data"), [64]))
    back = store.read("v").select(F.col("tensor_id").cast("long").alias("vec_id"), F.col("data").alias("back"))
    step = (F.array_max("data") - F.array_min("data")) / 255
    close = F.forall(F.zip_with("data", "back", lambda x, y: F.abs(x - y)), lambda e: e <= 1.5 * step + 1e-12)
    return v.join(back, "vec_id").select("vec_id", F.size("back").alias("n"), close.alias("within"))


@query("SELECT preset, CAST(n * each AS BIGINT) AS compressed_bytes FROM (SELECT count(*) AS n FROM embeddings), (VALUES ('none', 256), ('fp16_only', 128), ('int8_only', 88)) t(preset, each)")
def compression_presets(spark, sf):
    v = model.vectors(spark, sf).withColumn("dtype", F.lit("float32"))
    sizes = [codecs.compressed(v, name).agg(F.sum("compressed_bytes").alias("compressed_bytes")).select(F.lit(name).alias("preset"), "compressed_bytes") for name in ("none", "fp16_only", "int8_only")]
    return reduce(lambda a, b: a.union(b), sizes)


# operators by name


def _whole(spark, sf):
    return model.vectors(spark, sf).select("vec_id", "data", F.array(F.lit(8).cast("bigint"), F.lit(8).cast("bigint")).alias("shape"))


@query(f"WITH {base.CELLS} SELECT vec_id, u.o AS operation, round(CASE u.o WHEN 'sum' THEN sum(v) WHEN 'mean' THEN avg(v) WHEN 'min' THEN min(v) WHEN 'max' THEN max(v) WHEN 'norm' THEN sqrt(sum(v * v)) WHEN 'trace' THEN sum(v) FILTER (WHERE pos // 8 = pos % 8) END, 6) AS value FROM c, (SELECT unnest(['sum', 'mean', 'min', 'max', 'norm', 'trace']) AS o) u GROUP BY vec_id, u.o")
def op_by_name(spark, sf):
    rows = _whole(spark, sf)
    each = [named.apply(o, rows).select("vec_id", F.lit(o).alias("operation"), F.round(F.get("data", F.lit(0)), 6).alias("value")) for o in ("sum", "mean", "min", "max", "norm", "trace")]
    return reduce(lambda a, b: a.union(b), each)


@query("SELECT name, CAST(inputs AS INTEGER) AS inputs FROM (VALUES " + ", ".join(f"('{o.name}', {o.inputs})" for o in named.OPERATORS.values()) + ") t(name, inputs)")
def list_operations(spark, sf):
    return named.listed(spark).select("name", "inputs")


@query(f"WITH {base.CELLS} SELECT vec_id, 'norm' AS operation, round(sqrt(sum(v * v)), 6) AS value, CAST(1 AS BIGINT) AS parents FROM c GROUP BY vec_id")
def tracked_operation(spark, sf):
    """The norms of all stored vectors, run once and then answered by the cache, with their provenance and edges."""
    store = _store(spark)
    store.create("v")
    v = model.vectors(spark, sf)
    store.insert("v", _tensors(v, "vec_id", F.col("data"), [64]))
    tracker = named.Tracker(store)
    ids = [(r[0],) for r in store.read("v").select("tensor_id").collect()]
    tracker.run("norm", "v", ids, "norms")
    tracker.run("norm", "v", ids, "norms")
    made = store.read("norms").select("tensor_id", F.get_json_object("metadata", "$.operation").alias("operation"), F.round(F.get("data", F.lit(0)), 6).alias("value"))
    parents = tracker.edges().groupBy("child").agg(F.count("*").alias("parents"), F.max("parent").alias("parent"))
    return made.join(parents, F.col("child") == F.col("tensor_id")).select(F.col("parent").cast("long").alias("vec_id"), "operation", "value", "parents")


@query(f"WITH {base.CELLS} SELECT vec_id, round(3 * sqrt(sum(v * v)), 6) AS norm, round(3 * sum(v), 6) AS total FROM c GROUP BY vec_id")
def workflow_dag(spark, sf):
    """load, then scale, then norm and total beside each other, then a join of the two."""
    functions = {
        "load": lambda: {"rows": _whole(spark, sf)},
        "apply": lambda rows, name, **p: {"rows": named.apply(name, rows, **p)},
        "join": lambda a, b: a.select("vec_id", F.round(F.get("data", F.lit(0)), 6).alias("norm")).join(b.select("vec_id", F.round(F.get("data", F.lit(0)), 6).alias("total")), "vec_id"),
    }
    tasks = {
        "both": {"call": "join", "arguments": {"a": "$norm.rows", "b": "$total.rows"}},
        "norm": {"call": "apply", "arguments": {"rows": "$scaled.rows", "name": "norm"}},
        "total": {"call": "apply", "arguments": {"rows": "$scaled.rows", "name": "sum"}},
        "scaled": {"call": "apply", "arguments": {"rows": "$load.rows", "name": "multiply", "value": 3.0}},
        "load": {"call": "load"},
    }
    return named.workflow(tasks, functions)["both"]


@query(f"WITH {base.CELLS}, n AS (SELECT vec_id, sum(abs(v)) AS l1 FROM c GROUP BY vec_id), b AS (SELECT vec_id FROM n ORDER BY l1 DESC, vec_id LIMIT 1), t AS (SELECT sum(v) AS s FROM c WHERE vec_id = (SELECT vec_id FROM b)) SELECT k.step, k.operation, CASE WHEN k.step = 0 THEN CAST(vec_id AS VARCHAR) ELSE concat(vec_id, ':', k.step) END AS tensor_id, k.n, round(s * k.f, 6) AS total FROM b, t, (VALUES (0, 'input', 64, 1.0), (1, 'multiply', 64, 2.0), (2, 'add', 64, NULL), (3, 'sum', 1, NULL)) k(step, operation, n, f)")
def tensor_workflow(spark, sf):
    """The vector with the largest L1 norm, doubled, with 0.5 added, summed up; an unknown operation is passed over."""
    rows = _whole(spark, sf).withColumn("score", D.l1_norm("data"))
    steps, _ = named.tensor_workflow(rows, [("multiply", {"value": 2.0}), ("no such thing", {}), ("add", {"value": 0.5}), ("sum", {})], "vec_id")
    total = F.when(F.col("step") < 2, F.round(D.total("data"), 6))
    return steps.select("step", "operation", "tensor_id", F.size("data").alias("n"), total.alias("total"))


# lineage: the write side


@query(f"WITH RECURSIVE {tables._EDGES}, w(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT child, depth + 1 FROM w JOIN e ON parent = node) SELECT node, max(depth) AS depth FROM w GROUP BY node")
def lineage_record(spark, sf):
    """Depths after recording operations: every part is made of the one with half its key; the first 500 are known, the rest comes in at once."""
    own = tables.edges(spark, sf)
    known = lineage.with_depths(spark.createDataFrame([(1, 0)], "node long, depth int"), own.where("child <= 500").select("child", "parent"))
    return lineage.with_depths(known, own.where("child > 500").select("child", "parent"))


@query(f"WITH {tables._EDGES}, d AS (SELECT child, parent FROM e UNION SELECT child, parent + 1 FROM e WHERE parent + 1 < child), r AS (WITH RECURSIVE w(origin, node, depth) AS (SELECT child, parent, 1 FROM d UNION SELECT origin, parent, depth + 1 FROM w JOIN d ON child = node) SELECT origin, node, min(depth) AS depth FROM w GROUP BY ALL) SELECT origin, CAST(count(*) AS BIGINT) AS ancestors, max(depth) AS deepest FROM r GROUP BY origin")
def lineage_diamond(spark, sf):
    """Every part has two parents, so that ways meet again and again; the number of ancestors of each."""
    own = tables.edges(spark, sf).select("child", "parent")
    more = own.unionByName(own.where("parent + 1 < child").withColumn("parent", F.col("parent") + 1))
    out = lineage.ancestors(more, part(spark, sf).select(F.col("p_partkey").alias("node")))
    return out.groupBy("origin").agg(F.count("*").alias("ancestors"), F.max("depth").alias("deepest"))


@query("SELECT DISTINCT l_orderkey AS parent, l_partkey AS child FROM lineitem")
def lateral_unnest(spark, sf):
    """Child ids out of a JSON array in a text column."""
    rows = model.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_set("l_partkey")).alias("children"))
    return rows.select(F.col("l_orderkey").alias("parent"), F.explode(F.from_json("children", "array<bigint>")).alias("child"))


# vector indexes


def _sharded(spark, sf):
    return written(vectors.assigned_shards(model.vectors(spark, sf), "vec_id", 60), "shards")


@query("SELECT CAST((row_number() OVER (ORDER BY vec_id) - 1) // 60 AS INTEGER) AS shard, vec_id FROM embeddings")
def shard_assignment(spark, sf):
    return _sharded(spark, sf).select("shard", "vec_id")


@query(searching._top("ip / (nv * nw)"))
def shard_search(spark, sf):
    out = vectors.shard_search(_sharded(spark, sf), searching.first(spark, sf), 10)
    return out.select("vec_id", F.round("score", 6).alias("score"), "rank")


def _centroids(spark, sf) -> list[list[float]]:
    """The first eight vectors."""
    return [list(r.data) for r in model.vectors(spark, sf).where("vec_id < 8").orderBy("vec_id").select("data").collect()]


_LISTS = f"{base.CELLS}, z AS (SELECT a.vec_id, a.label, b.vec_id AS list, sum((a.v - b.v) * (a.v - b.v)) AS d FROM c a JOIN c b ON a.pos = b.pos AND b.vec_id < 8 GROUP BY ALL), near AS (SELECT vec_id, CAST(list AS INTEGER) AS list, row_number() OVER (PARTITION BY vec_id ORDER BY d, list) AS r FROM z)"


@query(f"WITH {_LISTS} SELECT vec_id, list FROM near WHERE r = 1")
def nearest_centroid(spark, sf):
    return vectors.Partitions(model.vectors(spark, sf), _centroids(spark, sf)).rows.select("vec_id", "list")


@query(f"WITH {_LISTS}, p AS (SELECT q.vec_id AS query_id, x.vec_id FROM near q JOIN near x ON x.list = q.list AND x.r = 1 AND q.r <= 2 AND q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id), s AS (SELECT query_id, p.vec_id, sum(a.v * b.v) / sqrt(sum(a.v * a.v)) / sqrt(sum(b.v * b.v)) AS sc FROM p JOIN c a ON a.vec_id = query_id JOIN c b ON b.vec_id = p.vec_id AND a.pos = b.pos GROUP BY ALL) SELECT query_id, vec_id, round(sc, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 3")
def ivf_probe(spark, sf):
    """Two of eight lists for each query: pruned by the lists' folders."""
    v = model.vectors(spark, sf)
    index = vectors.Partitions(v, _centroids(spark, sf)).saved(indexes.folder_for(spark, "lists"))
    out = index.knn_join(v.where("vec_id % 20 = 0"), 3, "cosine", 2)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def _graph(spark, sf):
    """The vectors in two batches, from which every eleventh is removed."""
    v = model.vectors(spark, sf)
    index = vectors.Graph(spark, indexes.folder_for(spark, "graph"))
    index.insert(v.where("vec_id % 3 <> 0"), "a")
    index.insert(v.where("vec_id % 3 = 0"), "b")
    index.remove(v.where("vec_id % 11 = 0"))
    return index


@query()
def graph_knn(spark, sf):
    v = model.vectors(spark, sf)
    out = _graph(spark, sf).search(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "data"), 10)
    return out.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 11 <> 0")
def graph_rebuild(spark, sf):
    """The live rows of a graph that is written anew."""
    return _graph(spark, sf).rebuilt(indexes.folder_for(spark, "graph")).rows().select("vec_id")


@query("SELECT CAST(count(*) AS BIGINT) AS vectors, CAST(count(*) FILTER (WHERE vec_id % 5 = 0) AS BIGINT) AS fresh, CAST(64 AS INTEGER) AS dimension, round(count(*) * 64 * 4 / 1048576, 6) AS megabytes FROM embeddings")
def vector_stats(spark, sf):
    v = model.vectors(spark, sf)
    return vectors.vector_stats(v.where("vec_id % 5 <> 0"), v.where("vec_id % 5 = 0")).withColumn("megabytes", F.round("megabytes", 6))


@query(searching._top("ip / (nv * nw)", 20, "vec_id % 5 = 0 AND label <> 3"))
def fresh_layer_search(spark, sf):
    fresh = model.vectors(spark, sf).where("vec_id % 5 = 0")
    out = vectors.fresh_search(fresh, searching.first(spark, sf), 10, F.col("label") != 3)
    return out.select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {searching.QV}, s AS (SELECT vec_id, ip / (nv * nw) AS sc FROM d WHERE label = 2) SELECT vec_id FROM s ORDER BY sc DESC, vec_id LIMIT 15 OFFSET 5")
def candidate_list(spark, sf):
    v = model.vectors(spark, sf)
    scores = v.where("label = 2").select("vec_id", D.cosine_similarity("data", search.literal(searching.first(spark, sf))).alias("score"))
    return vectors.candidates(scores, v, 5, 15, "vec_id")


# embeddings

_EMBEDDED = r"""w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM benchmark),
b AS (SELECT item_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS pos, count(*) AS n FROM w GROUP BY ALL),
m AS (SELECT item_id, sqrt(sum(n * n)) AS size FROM b GROUP BY item_id), x AS (SELECT item_id, pos, n / size AS v FROM b JOIN m USING (item_id))"""


def _benchmark(spark, sf):
    return model.read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")


@query(f"WITH {_EMBEDDED} SELECT item_id, pos, round(v, 6) AS value FROM x")
def embed_store(spark, sf):
    """The elements other than 0 of the stored embeddings."""
    rows = embeddings.embedded(_benchmark(spark, sf), embeddings.standard()).select(F.col("id").cast("long").alias("item_id"), F.posexplode("embedding").alias("pos", "value"))
    return rows.where("value <> 0").select("item_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query(f"WITH {_EMBEDDED}, q AS (SELECT pos, v AS w FROM x WHERE item_id = (SELECT min(item_id) FROM benchmark)) SELECT CAST(item_id AS VARCHAR) AS id, round(sum(v * w), 5) AS score FROM x JOIN q USING (pos) GROUP BY item_id ORDER BY sum(v * w) DESC, id LIMIT 10")
def embed_search(spark, sf):
    """The stored texts closest to the first one."""
    encoders, rows = embeddings.standard(), _benchmark(spark, sf)
    stored = embeddings.embedded(rows, encoders)
    text = rows.orderBy("id").first().text
    return embeddings.text_search(spark, stored, text, encoders, 10).select("id", F.round("score", 5).alias("score"))


@query("SELECT 'hashed' AS provider, model, namespace, 'default' AS tenant, CAST(count(*) AS BIGINT) AS embeddings, max(dim) AS dimension FROM (SELECT item_id, 'bag-64' AS model, 'all' AS namespace, 64 AS dim FROM benchmark UNION ALL SELECT item_id, 'bag-32', 'some', 32 FROM benchmark WHERE item_id % 2 = 0) GROUP BY ALL")
def embedding_stats(spark, sf):
    encoders, rows = embeddings.standard(), _benchmark(spark, sf)
    stored = embeddings.embedded(rows, encoders, model="bag-64", namespace="all").unionByName(embeddings.embedded(rows.where("id % 2 = 0"), encoders, model="bag-32", namespace="some"))
    return embeddings.statistics(stored)


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT text) AS BIGINT) AS cached FROM benchmark")
def embedding_cache(spark, sf):
    """A cache filled by half of the texts, then asked for all of them."""
    encoders, rows = embeddings.standard(), _benchmark(spark, sf)
    empty = spark.createDataFrame([], "cache_key string, embedding array<double>")
    _, half = embeddings.with_cache(rows.where("id % 2 = 0"), empty, encoders)
    found, every = embeddings.with_cache(rows, written(half, "cache"), encoders)
    return found.agg(F.count("*").alias("rows")).join(every.agg(F.count("*").alias("cached")))


@query("SELECT provider, model, dimension FROM (VALUES ('hashed', 'bag-128', 128), ('hashed', 'bag-32', 32), ('hashed', 'bag-64', 64)) t(provider, model, dimension)")
def model_registry(spark, sf):
    return embeddings.standard().listed(spark)


@query(searching.ORACLES["fulltext_score"])
def posting_search(spark, sf):
    """The full-text search over a written table of postings."""
    table = written(search.postings(model.read(spark, sf, "documents")), "postings")
    return search.posting_search(table, "The une").select("doc_id", F.round("score", 4).alias("score"))


# metrics

_KINDS = ("region", "nation", "supplier", "customer", "part", "orders")


@query(" UNION ALL ".join(f"SELECT '{t}' AS kind, CAST(count(*) AS BIGINT) AS n FROM {t}" for t in _KINDS))
def metadata_counts(spark, sf):
    return metrics.kind_counts(**{t: model.read(spark, sf, t) for t in _KINDS})


@query("WITH e AS (SELECT event_type AS dataset, ts, (SELECT max(ts) FROM events) AS now FROM events), a AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'error' WHEN c_custkey % 2 = 0 THEN 'running' ELSE 'stopped' END AS status FROM customer) SELECT CAST(count(DISTINCT dataset) AS BIGINT) AS datasets, CAST(count(*) AS BIGINT) AS records, round(count(*) FILTER (WHERE ts > now - INTERVAL 1 HOUR) / 3600, 6) AS ingest_rate, (SELECT CAST(count(*) AS BIGINT) FROM a) AS agents, (SELECT CAST(count(*) FILTER (WHERE status = 'running') AS BIGINT) FROM a) AS running, (SELECT CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) FROM a) AS failing FROM e")
def dashboard_metrics(spark, sf):
    events = model.read(spark, sf, "events").select(F.col("event_type").alias("dataset"), F.col("ts").alias("created_at"))
    now = F.lit(events.agg(F.max("created_at")).first()[0])
    status = F.when(F.col("c_custkey") % 10 == 0, "error").when(F.col("c_custkey") % 2 == 0, "running").otherwise("stopped")
    agents = model.read(spark, sf, "customer").select(status.alias("status"))
    return metrics.dashboard(events, agents, now, seconds=3600).withColumn("ingest_rate", F.round("ingest_rate", 6))


def _scoped(spark, sf):
    e = model.read(spark, sf, "events").select("event_id", "event_type", (F.col("user_id") % 10).alias("team"))
    name = F.when(F.col("team") == 0, F.col("event_type")).otherwise(tenancy.scoped(F.concat(F.lit("team-"), F.col("team").cast("string")), "event_type"))
    return e.select(F.col("event_id").alias("tensor_id"), name.alias("dataset"))


@query("SELECT CASE WHEN user_id % 10 = 0 THEN 'default' ELSE concat('team-', user_id % 10) END AS tenant, CAST(count(DISTINCT event_type) AS BIGINT) AS datasets, CAST(count(*) AS BIGINT) AS tensors FROM events GROUP BY tenant")
def tenant_usage(spark, sf):
    return metrics.tenant_usage(_scoped(spark, sf))


@query("SELECT CASE WHEN user_id % 10 = 0 THEN event_type ELSE concat('team-', user_id % 10, '.', event_type) END AS dataset, CAST(count(*) AS BIGINT) AS tensors FROM events WHERE event_id % 3 <> 0 GROUP BY dataset")
def service_counts(spark, sf):
    rows = _scoped(spark, sf)
    return metrics.service_counts(rows, rows.where("tensor_id % 3 = 0"))


@query("WITH u AS (SELECT CASE WHEN user_id % 10 = 0 THEN 'default' ELSE concat('team-', user_id % 10) END AS tenant, count(DISTINCT event_type) AS d, count(*) AS t FROM events GROUP BY tenant), r AS (SELECT tenant, d + 1 AS datasets, t + 10 AS tensors, CASE WHEN tenant = 'team-1' THEN t WHEN tenant = 'team-2' THEN t + 10 ELSE 0 END AS most FROM u) SELECT tenant, CAST(datasets AS BIGINT) AS datasets, CAST(tensors AS BIGINT) AS tensors, most = 0 OR tensors <= most AS allowed FROM r")
def tenant_quota(spark, sf):
    """Room for ten more tensors: team 1 has none left, team 2 just enough, the others no limit."""
    usage = metrics.tenant_usage(_scoped(spark, sf))
    quotas = usage.where("tenant IN ('team-1', 'team-2')").select("tenant", F.lit(0).alias("most_datasets"), F.when(F.col("tenant") == "team-1", F.col("tensors")).otherwise(F.col("tensors") + 10).alias("most_tensors"))
    return tenancy.within_quota(usage, quotas, usage.select("tenant", F.lit(1).alias("datasets"), F.lit(10).alias("tensors")))


@query("WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(lower(p_name), ' ', '-') WHEN 2 THEN concat('-', lower(p_brand)) ELSE repeat(lower(replace(p_name, ' ', '')), p_size) END AS slug FROM part) SELECT p_partkey, regexp_full_match(slug, '[a-z0-9][a-z0-9-]{0,62}') AS valid FROM s")
def slug_check(spark, sf):
    k = F.col("p_partkey") % 4
    slug = F.when(k == 0, F.col("p_name")).when(k == 1, F.replace(F.lower("p_name"), F.lit(" "), F.lit("-"))).when(k == 2, F.concat(F.lit("-"), F.lower("p_brand"))).otherwise(F.repeat(F.lower(F.replace("p_name", F.lit(" "), F.lit(""))), F.col("p_size")))
    return part(spark, sf).select("p_partkey", tenancy.valid_slug(slug).alias("valid"))


@query()
def token_bucket(spark, sf):
    requests = model.read(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("tenant"), "ts")
    return tenancy.token_bucket(requests, 3, 1 / 3600).select("request_id", "tenant", "allowed")


@query("WITH a AS (SELECT event_id AS seq, user_id, 100 + user_id % 50 AS bytes FROM events), r AS (SELECT *, sum(bytes) OVER (ORDER BY seq) AS upto FROM a), h AS (SELECT *, coalesce(upto - lag(upto) OVER (PARTITION BY user_id ORDER BY seq) <= 20000, false) AS hit FROM r), n AS (SELECT user_id, max(seq) AS newest, max(bytes) AS bytes FROM a GROUP BY user_id), k AS (SELECT bytes, sum(bytes) OVER (ORDER BY newest DESC) AS upto FROM n) SELECT CAST(count(*) AS BIGINT) AS accesses, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_rate, (SELECT CAST(count(*) AS BIGINT) FROM k WHERE upto <= 20000) AS hot_count, (SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM k WHERE upto <= 20000) AS hot_bytes FROM h")
def tier_stats(spark, sf):
    events = model.read(spark, sf, "events")
    sizes = events.select(F.col("user_id").alias("tensor_id")).distinct().withColumn("bytes", 100 + F.col("tensor_id") % 50)
    log = events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("tensor_id"))
    return metrics.tier_stats(log, sizes, 20_000).withColumn("hit_rate", F.round("hit_rate", 6))


def _chunks(spark, sf):
    return codecs.chunked(model.vectors(spark, sf), "vec_id", 10)


@query("SELECT CAST(count(*) AS BIGINT) AS tensors, CAST(7 * count(*) AS BIGINT) AS chunks, CAST(512 * count(*) AS BIGINT) AS bytes, 1.0::DOUBLE AS mean_ratio FROM embeddings")
def chunk_stats(spark, sf):
    rows = _chunks(spark, sf).select(F.col("vec_id").alias("tensor_id"), (8 * F.size("data")).alias("bytes"), F.lit(1.0).alias("ratio"))
    return metrics.chunk_stats(rows)


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def most_accessed(spark, sf):
    return metrics.most_accessed(model.read(spark, sf, "events"), "user_id")


@query("SELECT vec_id, round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda x: CAST(x AS DOUBLE))), lambda acc, x: acc * 0.5 + x), 6) AS value FROM embeddings")
def chunk_fold(spark, sf):
    """A fold whose order matters, over chunks."""
    return metrics.chunk_fold(_chunks(spark, sf), "vec_id", 0.0, lambda acc, x: acc * 0.5 + x).withColumn("value", F.round("value", 6))


@query(f"WITH {base.CELLS} SELECT vec_id, round(max(abs(v)), 6) AS value FROM c GROUP BY vec_id")
def chunk_reduce(spark, sf):
    return metrics.chunk_reduce(_chunks(spark, sf), "vec_id", D.linf_norm, F.max).withColumn("value", F.round("value", 6))


@query("SELECT vec_id, CAST(k AS INTEGER) AS chunk_index, CAST(least(10, 64 - 10 * k) AS INTEGER) AS n FROM embeddings, (SELECT unnest(range(0, 7)) AS k) u")
def chunk_stream(spark, sf):
    return _chunks(spark, sf).select("vec_id", "chunk_index", F.size("data").alias("n"))


@query("WITH b AS (SELECT unnest(['0.5', '1', '2.5', '5', '10', '25', '50', '100', '250', '500', '1000']) AS b) SELECT concat('latency_bucket{le=\"', b, '\"} ', (SELECT count(*) FROM events WHERE value <= CAST(b AS DOUBLE))) AS line FROM b UNION ALL SELECT concat('latency_bucket{le=\"+Inf\"} ', count(*)) FROM events UNION ALL SELECT concat('latency_count ', count(*)) FROM events")
def histogram_render(spark, sf):
    lines = metrics.histogram_lines(feeds.latency_histogram(model.read(spark, sf, "events"), "value"), "latency")
    return lines.where(~F.startswith("line", F.lit("latency_sum")))
