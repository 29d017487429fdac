"""The store's reads and writes, sources, codecs there and back, properties, versions and the frame of tensors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tensorloom import model, sdk
from tensorloom.functions import codecs, descriptor
from tensorloom.functions import dense as D
from tensorloom.operators import catalog, indexes, lineage, linalg, search, series, vectors
from tensorloom.plans import plan, tenancy
from tensorloom.queries import tables
from tensorloom.queries import tensors as base
from tensorloom.sources import store as S
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


# customers as tensors of one element, with metadata


def _customers(spark, sf) -> S.Store:
    store = S.Store(spark, indexes.folder_for(spark, "store"))
    store.create("customers", {"shape": [1], "metadata": {"segment": "str", "nation": "int"}})
    c = model.read(spark, sf, "customer").orderBy("c_custkey")
    about = F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")))
    store.insert("customers", c.select(F.col("c_custkey").cast("string").alias("tensor_id"), F.array(F.lit(1).cast("bigint")).alias("shape"), F.array("c_acctbal").alias("data"), about.alias("metadata")))
    return store


def _balance(rows):
    return rows.select(F.col("tensor_id").cast("long").alias("c_custkey"), F.round(F.get("data", F.lit(0)), 4).alias("balance"))


@query("SELECT c_custkey, round(c_acctbal, 4) AS balance FROM customer")
def store_scan(spark, sf):
    return _balance(_customers(spark, sf).read("customers"))


@query("SELECT c_custkey, round(c_acctbal, 4) AS balance FROM customer ORDER BY c_custkey LIMIT 30 OFFSET 45")
def store_page(spark, sf):
    return _balance(_customers(spark, sf).page("customers", 45, 30))


@query("SELECT c_custkey, round(c_acctbal, 4) AS balance FROM customer WHERE c_custkey = 77")
def store_point(spark, sf):
    row = _customers(spark, sf).get("customers", "77")
    return _balance(spark.createDataFrame([(row.tensor_id, row.data)], "tensor_id string, data array<double>"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM customer")
def store_count(spark, sf):
    return spark.createDataFrame([(_customers(spark, sf).count("customers"),)], "n long")


@query("SELECT c_custkey, round(c_acctbal, 4) AS balance FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def store_by_metadata(spark, sf):
    return _balance(_customers(spark, sf).by_metadata("customers", {"segment": "BUILDING", "nation": 7}))


@query("SELECT c_custkey, round(c_acctbal, 4) AS balance FROM customer WHERE c_acctbal > 5000 AND c_nationkey <> 0 AND 1 / c_nationkey < 0.2")
def store_lambda(spark, sf):
    """A function of elements and metadata; rows where it fails (a division by 0) don't pass."""
    return _balance(_customers(spark, sf).query("customers", lambda data, m: data[0] > 5000 and 1 / m["nation"] < 0.2))


@query("SELECT c_custkey, round(c_acctbal, 4) AS balance FROM customer WHERE c_custkey % 3 <> 0")
def store_delete(spark, sf):
    store = _customers(spark, sf)
    store.delete("customers", model.read(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("tensor_id")))
    return _balance(store.read("customers"))


@query("SELECT CASE WHEN c_custkey = 42 THEN 'NEW' ELSE c_mktsegment END AS segment, CAST(CASE WHEN c_custkey = 42 THEN 2 ELSE 1 END AS BIGINT) AS version, c_custkey FROM customer")
def store_update_metadata(spark, sf):
    store = _customers(spark, sf)
    store.update_metadata("customers", "42", {"segment": "NEW"})
    return store.read("customers").select(F.get_json_object("metadata", "$.segment").alias("segment"), "version", F.col("tensor_id").cast("long").alias("c_custkey"))


@query("SELECT c_custkey, round(c_acctbal, 4) AS balance FROM customer")
def store_restore(spark, sf):
    """A snapshot, a removal, and the snapshot again: what is there isn't doubled."""
    store = _customers(spark, sf)
    path = indexes.folder_for(spark, "snapshot")
    store.snapshot("customers", path)
    store.delete("customers", model.read(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("tensor_id")))
    store.restore("customers", path)
    return _balance(store.read("customers"))


@query("SELECT 'customers' AS dataset")
def store_datasets(spark, sf):
    return spark.createDataFrame([(n,) for n in _customers(spark, sf).datasets()], "dataset string")


# sources


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(2 AS BIGINT) AS columns, round(sum(p_size + p_retailprice), 2) AS total FROM part")
def csv_source(spark, sf):
    """A file of numbers as one matrix."""
    path = indexes.folder_for(spark, "csv")
    model.read(spark, sf, "part").select(F.col("p_size").cast("string").alias("size"), F.col("p_retailprice").cast("string").alias("price")).coalesce(1).write.option("header", True).csv(path)
    rows = S.read_csv(spark, path + "/*.csv")
    return rows.select(F.get("shape", F.lit(0)).alias("rows"), F.get("shape", F.lit(1)).alias("columns"), F.round(D.total("data"), 2).alias("total"))


@query("SELECT event_id, value > 20 AS good FROM events")
def ingest_validate(spark, sf):
    """Rows that lack a column go to quarantine."""
    rows = model.read(spark, sf, "events").select("event_id", F.when(F.col("value") > 20, F.col("value")).alias("value"))
    good, bad = feeds.validated(rows, ["event_id", "value"])
    return good.select("event_id", F.lit(True).alias("good")).union(bad.select("event_id", F.lit(False).alias("good")))


@query("SELECT max(event_id) AS head FROM events")
def replication_head(spark, sf):
    return feeds.head(model.read(spark, sf, "events").select(F.col("event_id").alias("seq")))


@query("SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def pack_fixed(spark, sf):
    return S.pack_fixed(model.vectors(spark, sf), "data", 64).select("vec_id")


# codecs there and back


def _back(name: str, column, sql: str = "v"):
    def run(spark, sf):
        return base.cells(column(model.vectors(spark, sf)).select("vec_id", "data"))

    run.__name__ = name
    query(f"WITH {base.CELLS} SELECT vec_id, pos, round({sql}, 6) + 0 AS value FROM c")(run)


_back("deflate_back", lambda v: v.withColumn("data", codecs.inflated(codecs.deflated("data"))))
_back("coo_back", lambda v: v.withColumn("data", codecs.from_sparse(codecs.sparse(F.transform("data", lambda x: F.when(F.abs(x) >= 0.2, x).otherwise(0.0))), 64)), "CASE WHEN abs(v) >= 0.2 THEN v ELSE 0 END")
_back("chunks_back", lambda v: codecs.rebuilt(codecs.chunk_map(codecs.chunked(v, "vec_id", 9), lambda x: 2 * x), "vec_id"), "2 * v")
_back("arrow_back", lambda v: sdk.TensorFrame.from_arrow(v.sparkSession, sdk.TensorFrame(v.withColumn("shape", F.array(F.lit(64).cast("bigint"))), "vec_id").to_arrow(), "vec_id").rows)


@query(f"WITH {base.GRID}, x AS (SELECT vec_id, i, sum(v) AS x FROM g GROUP BY ALL), y AS (SELECT vec_id, j, sum(v) AS y FROM g GROUP BY ALL) SELECT vec_id, i * 8 + j AS pos, round(x * y, 6) + 0 AS value FROM x JOIN y USING (vec_id)")
def lowrank_back(spark, sf):
    """The truncated SVD of a matrix of rank one, the product of row and column sums, keeps all of it."""
    outer = linalg.array_udf(lambda a: np.outer(a.sum(1), a.sum(0)), "data", shapes=[[8, 8]])
    return base.cells(model.vectors(spark, sf).select("vec_id", outer.alias("data")).select("vec_id", codecs.low_rank("data", 8, 8).alias("data")))


# modes


@query(f"WITH {base.CELLS} SELECT vec_id, (pos // 4 % 4) * 16 + (pos // 16) * 4 + pos % 4 AS pos, round(v, 6) + 0 AS value FROM c")
def unfold_mode_1(spark, sf):
    out = linalg.array_udf(lambda a: linalg.unfold(a, 1), "data", shapes=[[4, 4, 4]])
    return base.cells(model.vectors(spark, sf).select("vec_id", out.alias("data")))


@query(f"WITH {base.CELLS} SELECT vec_id, pos, round(v, 6) + 0 AS value FROM c")
def fold_back(spark, sf):
    out = linalg.array_udf(lambda a: linalg.fold(linalg.unfold(a, 2), 2, a.shape), "data", shapes=[[4, 4, 4]])
    return base.cells(model.vectors(spark, sf).select("vec_id", out.alias("data")))


@query(f"WITH {base.CELLS} SELECT vec_id, (pos // 16) * 8 + r * 4 + pos % 4 AS pos, round(sum(v * CASE WHEN r = 0 THEN 1 ELSE pos // 4 % 4 END), 6) + 0 AS value FROM c, (SELECT CAST(unnest(range(0, 2)) AS BIGINT) AS r) t GROUP BY vec_id, (pos // 16) * 8 + r * 4 + pos % 4")
def mode_product_1(spark, sf):
    """The product along the second dimension with a matrix of two rows, ones and 0 to 3."""
    matrix = np.stack([np.ones(4), np.arange(4.0)])
    out = linalg.array_udf(lambda a: linalg.mode_product(a, matrix, 1), "data", shapes=[[4, 4, 4]])
    return base.cells(model.vectors(spark, sf).select("vec_id", out.alias("data")))


def _positive(a: np.ndarray) -> np.ndarray:
    """The outer product of the absolute sums over all but one of the last three dimensions."""
    return np.einsum("...i,...j,...k->...ijk", *(np.abs(a.sum(d)) for d in ((-2, -1), (-3, -1), (-3, -2))))


for _name, (_udf, _kernel) in {
    "nn_cp_rank_one": (linalg.array_udf, lambda a: linalg.from_cp(linalg.cp(_positive(a), 1, 400, nonnegative=True))),
    "nn_tucker_rank_one": (linalg.stacked_udf, lambda a: linalg.from_tuckers(*linalg.tuckers(_positive(a), [1, 1, 1], 3, nonnegative=True))),
}.items():

    def _run(spark, sf, udf=_udf, kernel=_kernel):
        return base.cells(model.vectors(spark, sf).select("vec_id", udf(kernel, "data", shapes=[[4, 4, 4]]).alias("data")), digits=4)

    _run.__name__ = _name
    query(f"WITH {base.CELLS}, {tables._MARGINS} SELECT vec_id, i * 16 + j * 4 + k AS pos, round(abs(x) * abs(y) * abs(z), 4) AS value FROM x JOIN y USING (vec_id) JOIN z USING (vec_id)")(_run)


# properties of matrices: diagonal ones, whose facts are plain


def _diagonal(spark, sf):
    """Each vector on the diagonal of a 64 x 64 matrix, described."""
    matrix = linalg.array_udf(np.diag, "data", shapes=[[64]])
    v = model.vectors(spark, sf).select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.transform("data", lambda x: F.abs(x) + 0.01)).otherwise(F.col("data")).alias("data"))
    v = v.select("vec_id", matrix.alias("data"), F.array(F.lit(64).cast("bigint"), F.lit(64).cast("bigint")).alias("shape"))
    return descriptor.described(v, True)


_DIAGONAL = f"{base.CELLS}, f AS (SELECT vec_id, pos, CASE WHEN vec_id % 2 = 0 THEN abs(v) + 0.01 ELSE v END AS v FROM c)"


@query(f"WITH {_DIAGONAL} SELECT vec_id, CAST(count(*) FILTER (WHERE abs(v) > 1e-10) AS INTEGER) AS rank, round(max(abs(v)), 6) AS spectral_norm, round(sum(abs(v)), 6) AS nuclear_norm, round(sum(v), 6) + 0 AS trace, round(min(v), 6) + 0 AS eigen_min, round(max(v), 6) + 0 AS eigen_max, min(v) > 0 AS positive, true AS symmetric, true AS diagonal FROM f GROUP BY vec_id")
def diagonal_facts(spark, sf):
    f = _diagonal(spark, sf)
    return f.select("vec_id", "rank", *[(F.round(c, 6) + 0.0).alias(c) for c in ("spectral_norm", "nuclear_norm", "trace", "eigen_min", "eigen_max")], F.col("is_positive_definite").alias("positive"), F.col("is_symmetric").alias("symmetric"), F.col("is_diagonal").alias("diagonal"))


@query(f"WITH {_DIAGONAL}, m AS (SELECT vec_id, count(*) FILTER (WHERE abs(v) > 1e-10) AS rank, min(v) > 0 AS positive, sqrt(sum(v * v)) AS norm FROM f GROUP BY vec_id) SELECT vec_id FROM m WHERE rank = 64 AND positive AND norm >= 1.0")
def property_query(spark, sf):
    """Rank, definiteness and a bound of the norm at once."""
    return _diagonal(spark, sf).where(descriptor.property_query(min_norm=1.0, symmetric=True, positive_definite=True, rank=64)).select("vec_id")


@query(f"WITH {_DIAGONAL}, m AS (SELECT vec_id, min(v) > 0 AS positive FROM f GROUP BY vec_id) SELECT vec_id FROM m WHERE positive")
def cholesky_candidates(spark, sf):
    return _diagonal(spark, sf).where(descriptor.decomposition_candidate("cholesky") & descriptor.has_property("positive_definite") & descriptor.has_property("sparse")).select("vec_id")


@query("SELECT p_partkey, round(0.3 * least(p_size, 20) / greatest(p_size, 20) + 0.2 * (1 - abs(p_size / 50.0 - 0.5)) + CASE WHEN p_retailprice BETWEEN 920 AND 960 THEN 0.3 ELSE 0 END, 6) AS score FROM part")
def property_score(spark, sf):
    rows = model.read(spark, sf, "part").select("p_partkey", F.array(F.col("p_size").cast("bigint")).alias("shape"), (F.col("p_size") / 50).alias("sparsity"), F.col("p_retailprice").alias("frobenius_norm"))
    return rows.select("p_partkey", F.round(search.property_score([20], 0.5, None, (920.0, 960.0)), 6).alias("score"))


# catalog


@query("SELECT s_suppkey + 1000000 AS child, s_suppkey AS parent, 'new_version_of' AS relation, 'v2' AS version, s_name FROM supplier WHERE s_suppkey % 4 = 0")
def new_versions(spark, sf):
    s = model.read(spark, sf, "supplier")
    versions = s.where("s_suppkey % 4 = 0").select("s_suppkey", (F.col("s_suppkey") + 1000000).alias("new_id"), F.lit("v2").alias("version"))
    copies, edges = catalog.new_versions(s, versions, "s_suppkey")
    return edges.join(copies.select(F.col("s_suppkey").alias("child"), "s_name"), "child")


@query("SELECT 6::BIGINT AS node UNION ALL SELECT 12 UNION ALL SELECT 13")
def versions_of(spark, sf):
    """A tensor and its direct versions, not theirs."""
    edges = model.read(spark, sf, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).cast("long").alias("parent"), F.lit("new_version_of").alias("relation"))
    return catalog.versions_of(edges, 6).select(F.col("node").cast("long").alias("node"))


@query("SELECT user_id, CAST(count(*) AS INTEGER) AS frequency, max(ts) AS last FROM events GROUP BY user_id")
def usage_derived(spark, sf):
    history = model.read(spark, sf, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("ts").alias("accessed_at"), "event_id")).alias("access_history"))
    return catalog.derived_usage(history).select("user_id", F.col("usage_frequency").alias("frequency"), F.col("last_accessed_at").alias("last"))


@query("SELECT c_custkey, c_mktsegment AS name, CASE WHEN c_custkey % 6 = 0 THEN 'second' ELSE 'first' END AS note FROM customer WHERE c_custkey % 2 = 0")
def semantic_add(spark, sf):
    """A note for each tensor and name; a second one replaces the first."""
    c = model.read(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("name"))
    notes = catalog.attached(spark.createDataFrame([], "c_custkey bigint, name string, note string"), c.where("c_custkey % 2 = 0").withColumn("note", F.lit("first")), c, "c_custkey", "name")
    return catalog.attached(notes, c.where("c_custkey % 6 = 0").withColumn("note", F.lit("second")), c, "c_custkey", "name")


@query("SELECT 'tensors' AS kind, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey % 3 <> 0")
def cascade_delete(spark, sf):
    orders = model.read(spark, sf, "orders").select("o_orderkey")
    lines = model.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    left = catalog.cascaded(orders, orders.where("o_orderkey % 3 = 0"), "o_orderkey", lines=lines)
    return left["tensors"].agg(F.count("*").alias("n")).select(F.lit("tensors").alias("kind"), "n").union(left["lines"].agg(F.count("*").alias("n")).select(F.lit("lines").alias("kind"), "n"))


@query("SELECT l_orderkey, l_linenumber, CAST(epoch(CAST(l_shipdate AS TIMESTAMP)) - epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) * 1000 AS ms FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def operation_durations(spark, sf):
    o = model.read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("started"))
    rows = model.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("completed")).join(o, "l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", lineage.duration_ms("started", "completed").alias("ms"))


# vectors


@query(f"WITH {base.CELLS}, q AS (SELECT pos, v AS w FROM c WHERE vec_id = 0), d AS (SELECT vec_id, label, sum(v * w) / sqrt(sum(v * v)) / sqrt(sum(w * w)) AS sc FROM c JOIN q USING (pos) GROUP BY ALL) SELECT vec_id, round(sc, 6) AS score FROM d WHERE label = 2 OR vec_id % 5 = 0 ORDER BY sc DESC, vec_id LIMIT 10")
def vector_metadata_filter(spark, sf):
    """Equality with an entry of the metadata; rows that lack the entry pass."""
    v = model.vectors(spark, sf)
    tags = F.when(F.col("vec_id") % 5 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("label"), F.col("label").cast("string")))
    query_ = list(v.where("vec_id = 0").first().data)
    return search.nearest(v.withColumn("metadata", tags), query_, 10, "cosine", search.matches_filter("metadata", label="2")).select("vec_id", F.round("score", 6).alias("score"))


@query("WITH s AS (SELECT event_type AS field, count(*) AS n, avg(value) AS mean FROM events GROUP BY event_type), t AS (SELECT sum(n) AS total FROM s) SELECT field FROM s, t ORDER BY mean + 1.4 * sqrt(ln(total) / n) DESC, field LIMIT 1")
def ucb_suggestion(spark, sf):
    arms = {r.event_type: (r.n, r.mean) for r in model.read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).collect()}
    return spark.createDataFrame([(plan.ucb(arms),)], "field string")


@query(f"WITH {base.PAIRS} SELECT vec_id, CAST(i AS BIGINT) - 1 AS pos, round(((a[i] + b[i]) * 2 - a[i]) / 4 + a[i] * a[i], 6) + 0 AS value FROM p, (SELECT unnest(range(1, 65)) AS i) u")
def frame_arithmetic(spark, sf):
    """((a + b) * 2 - a) / 4 + a ** 2 on whole collections."""
    p = base.pairs(spark, sf).withColumn("shape", F.array(F.lit(64).cast("bigint")))
    a, b = sdk.TensorFrame(p.withColumn("data", F.col("a")), "vec_id"), sdk.TensorFrame(p.withColumn("data", F.col("b")), "vec_id")
    return base.cells((((a + b) * 2 - a) / 4 + a**2).rows)


# more of indexes, streams, series and tenants


@query(f"WITH {base.CELLS} SELECT vec_id, CAST(64 AS INTEGER) AS n, round(sqrt(sum(v * v)), 6) AS norm FROM c GROUP BY vec_id")
def descriptor_from_bytes(spark, sf):
    v = model.vectors(spark, sf).select("vec_id", codecs.float32_bytes("data").alias("raw"))
    v = v.select("vec_id", codecs.from_float32_bytes("raw").alias("data"))
    return v.select("vec_id", F.size("data").alias("n"), F.round(D.frobenius_norm("data"), 6).alias("norm"))


@query("WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat('The ', lang) ELSE text END AS text FROM documents WHERE doc_id % 9 <> 0), t AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x = 'the')) AS n FROM d) SELECT doc_id, round(CAST(1 + 0.01 * n AS DOUBLE), 4) AS score FROM t WHERE n > 0")
def posting_index(spark, sf):
    """Every fourth document comes again with another text, then every ninth goes."""
    docs = model.read(spark, sf, "documents").select("doc_id", "text", "lang")
    index = indexes.PostingIndex(spark, indexes.folder_for(spark, "words"))
    index.insert(docs)
    index.insert(docs.where("doc_id % 4 = 0").withColumn("text", F.concat(F.lit("The "), F.col("lang"))))
    index.remove(docs.where("doc_id % 9 = 0"))
    return index.scores("The").withColumn("score", F.round("score", 4))


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 920 AND 940 AND p_partkey % 5 <> 0")
def idx_backup(spark, sf):
    """Two backups, of which the last is kept and restored."""
    index = indexes.RangeIndex(spark, indexes.folder_for(spark, "range"), "p_partkey", "p_retailprice")
    rows = model.read(spark, sf, "part")
    folder = indexes.folder_for(spark, "backups")
    index.insert(rows)
    index.backup(folder, "one")
    index.remove(rows.where("p_partkey % 5 = 0").select("p_partkey"))
    index.backup(folder, "two")
    (last,) = indexes.prune(spark, folder, 1)
    return index.restored(folder, last, indexes.folder_for(spark, "range")).range(920.0, 940.0)


@query("SELECT label, CAST(count(*) AS BIGINT) AS n FROM embeddings WHERE vec_id % 7 <> 0 GROUP BY label")
def compaction(spark, sf):
    """A delta that is full enough is merged, and what is deleted goes."""
    v = model.read(spark, sf, "embeddings").select("vec_id", "label")
    after, delta, _ = feeds.compacted(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), v.where("vec_id % 7 = 0"), capacity=20)
    return after.unionByName(delta).groupBy("label").agg(F.count("*").alias("n"))


@query(tables.ORACLES["ts_ar1_forecast"])
def store_predictions(spark, sf):
    """Forecasts written as tensors with their provenance, and read again."""
    store = S.Store(spark, indexes.folder_for(spark, "store"))
    daily = model.read(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))
    series.store_predictions(store, series.forecast(daily, "event_type", "day", "y", 1, 0, 5), "forecasts", "events", "ar", "event_type", p=1, d=0)
    rows = store.read("forecasts").select(F.get_json_object("metadata", "$.series").alias("event_type"), F.posexplode("data").alias("step", "value"))
    return rows.select("event_type", (F.col("step") + 1).alias("step"), F.round("value", 3).alias("value"))


@query("SELECT CASE WHEN c_custkey % 4 = 0 THEN 'admin' ELSE 'viewer' END AS role, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE c_custkey % 4 = 0) AS BIGINT) AS editors FROM customer WHERE c_custkey % 3 <> 0 GROUP BY role")
def tenant_keys(spark, sf):
    """Requests with the key of each customer; every third key isn't known."""
    c = model.read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("key-"), F.col("c_custkey").cast("string")).alias("api_key"))
    known = c.where("c_custkey % 3 <> 0").select(F.sha2("api_key", 256).alias("key_hash"), F.lit("t").alias("tenant"), F.when(F.col("c_custkey") % 4 == 0, "admin").otherwise("viewer").alias("role"))
    return tenancy.resolved(c, known).groupBy("role").agg(F.count("*").alias("n"), F.count_if(tenancy.may("role", "editor")).alias("editors"))


@query("SELECT CASE WHEN vec_id = 0 THEN 1 ELSE 0 END AS itself, CAST(1 AS INTEGER) AS rank FROM embeddings WHERE vec_id = 0")
def sketch_search(spark, sf):
    """The tensor whose sketch is most like the first one's: itself."""
    index = vectors.Sketches(spark, indexes.folder_for(spark, "sketches"), 3, "vec_id")
    v = model.vectors(spark, sf)
    index.insert(v.where("vec_id % 2 = 0"), [4, 4, 4])
    index.insert(v.where("vec_id % 2 = 1"), [4, 4, 4])
    query_ = np.array(v.where("vec_id = 0").first().data).reshape(4, 4, 4)
    return index.search(query_, 1).select((F.col("vec_id") == 0).cast("int").alias("itself"), "rank")
