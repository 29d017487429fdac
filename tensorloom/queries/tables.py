"""Catalog, lineage, history, codecs, change feed, CRUD, linear algebra, series and stream extensions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tensorloom import model
from tensorloom.functions import codecs
from tensorloom.operators import catalog, lineage, linalg, series
from tensorloom.queries import tensors as base
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


# catalog


@query("SELECT coalesce(CAST(quality AS VARCHAR), 'N/A') AS key, round(coalesce(avg(n_chars), 0), 4) AS value FROM documents LEFT JOIN labels USING (doc_id) GROUP BY key")
def group_na_key(spark, sf):
    docs = model.read(spark, sf, "documents").join(model.read(spark, sf, "labels"), "doc_id", "left")
    return catalog.grouped(docs, "quality", "avg", "n_chars").select("key", F.round("value", 4).alias("value"))


_TAGS = "t AS (SELECT p_partkey, unnest(list_distinct(list_concat(string_split(p_name, ' '), [p_brand]))) AS tag FROM part)"


@query(f"WITH {_TAGS}, c AS (SELECT a.tag, b.tag AS partner, count(*) AS n FROM t a JOIN t b ON a.p_partkey = b.p_partkey AND a.tag <> b.tag GROUP BY ALL HAVING count(*) >= 2) SELECT tag, partner, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY tag ORDER BY n DESC, partner) AS INTEGER) AS rank FROM c QUALIFY rank <= 5")
def co_tags(spark, sf):
    part = model.read(spark, sf, "part").select(F.concat(F.split("p_name", " "), F.array("p_brand")).alias("tags"))
    return catalog.co_occurring(part, "tags", 2, 5)


@query("WITH o AS (SELECT o_orderkey, o_custkey, max(l_shipdate) AS shipped, any_value(o_orderdate) AS ordered FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o_orderkey, CAST(greatest(ordered, shipped) AS TIMESTAMP) AS touched FROM o WHERE greatest(ordered, shipped) < TIMESTAMP '1998-12-31' - INTERVAL 900 DAY ORDER BY touched, o_orderkey LIMIT 50")
def stale(spark, sf):
    shipped = model.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    orders = model.read(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("ordered")).join(shipped, "o_orderkey", "left")
    now = F.lit("1998-12-31").cast(orders.schema["ordered"].dataType)
    return catalog.stale(orders, now, 900, 50, "ordered", "shipped", "o_orderkey").select("o_orderkey", F.col("touched").cast("timestamp_ntz").alias("touched"))


@query("WITH o AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS parents, count(*) AS steps FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey FROM o WHERE parents >= 6 OR steps >= 7 ORDER BY l_orderkey LIMIT 100")
def complex_tensors(spark, sf):
    orders = model.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("parents"), F.count("*").alias("steps"))
    return catalog.complex_tensors(orders, "parents", "steps", "l_orderkey", 6, 7).select("l_orderkey")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND list_contains(string_split(p_name, ' '), string_split((SELECT min(p_name) FROM part), ' ')[1])")
def tags_contain_all(spark, sf):
    part = model.read(spark, sf, "part").withColumn("tags", F.split("p_name", " ")).withColumn("owner", F.col("p_brand"))
    tag = part.agg(F.min("p_name")).first()[0].split(" ")[0]
    return catalog.filtered(part, owner="Brand#11", tags=[tag]).select("p_partkey")


@query("SELECT p_partkey, CAST(count(l_orderkey) AS BIGINT) AS lines FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def export_assembly(spark, sf):
    lines = model.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber")
    return catalog.exported(model.read(spark, sf, "part").select("p_partkey"), "p_partkey", usage=lines).select("p_partkey", F.size("usage").cast("long").alias("lines"))


@query("SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'overwritten' ELSE 'imported' END AS action, CAST(count(*) AS BIGINT) AS n FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY action")
def import_summary(spark, sf):
    s = model.read(spark, sf, "supplier")
    return catalog.imported(s.where("s_suppkey % 3 = 0"), s.where("s_suppkey % 2 = 0"), "s_suppkey", "overwrite")[1]


@query("SELECT s_suppkey, round(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 ELSE s_acctbal END, 4) AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0")
def import_merge(spark, sf):
    s = model.read(spark, sf, "supplier")
    new = s.where("s_suppkey % 2 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1)
    merged, _ = catalog.imported(s.where("s_suppkey % 3 = 0"), new, "s_suppkey", "overwrite")
    return merged.select("s_suppkey", F.round("s_acctbal", 4).alias("s_acctbal"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 8 = 0)")
def delete_anti(spark, sf):
    """The customers that are left once those of every eighth order are gone."""
    gone = model.read(spark, sf, "orders").where("o_orderkey % 8 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return model.read(spark, sf, "customer").join(gone, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_meta(spark, sf):
    c = model.read(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return catalog.upserted(c, c.where("c_custkey % 5 = 0").withColumn("c_mktsegment", F.lit("NEW")), "c_custkey")


@query()
def sample_n(spark, sf):
    return feeds.sampled(model.read(spark, sf, "embeddings").select("vec_id", "label"), 25, "vec_id", 7)


# lineage: the parent of a part is its key div 2


def edges(spark, sf):
    return model.read(spark, sf, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent"), F.col("p_brand").alias("operation_id"))


_EDGES = "e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1)"


@query(f"WITH RECURSIVE {_EDGES}, w(origin, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT origin, parent, depth + 1 FROM w JOIN e ON child = node) SELECT origin, node, depth FROM w WHERE depth > 0")
def lineage_ancestors(spark, sf):
    """The ancestors of every part."""
    start = model.read(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    return lineage.ancestors(edges(spark, sf), start)


@query(f"WITH RECURSIVE {_EDGES}, w(node, depth) AS (SELECT CAST(3 AS BIGINT), 0 UNION ALL SELECT child, depth + 1 FROM w JOIN e ON parent = node) SELECT node, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY node")
def lineage_descendants(spark, sf):
    return lineage.recursive_closure(spark, edges(spark, sf), 3, up=False)


@query(f"WITH RECURSIVE {_EDGES}, w(node, depth) AS (SELECT CAST(199 AS BIGINT), 0 UNION ALL SELECT parent, depth + 1 FROM w JOIN e ON child = node WHERE depth < 5) SELECT node, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY node")
def lineage_depth(spark, sf):
    return lineage.recursive_closure(spark, edges(spark, sf), 199, depth=5)


@query(f"WITH RECURSIVE {_EDGES}, w(node, nodes) AS (SELECT CAST(187 AS BIGINT), [CAST(187 AS BIGINT)] UNION ALL SELECT parent, list_prepend(parent, nodes) FROM w JOIN e ON child = node), p AS (SELECT nodes FROM w WHERE node = 1) SELECT unnest(nodes) AS node, CAST(unnest(range(0, len(nodes))) AS BIGINT) AS at FROM p")
def lineage_path(spark, sf):
    out = lineage.shortest_path(spark, edges(spark, sf), 1, 187)
    return out.select(F.posexplode("nodes").alias("at", "node")).select("node", F.col("at").cast("long").alias("at"))


@query(f"WITH {_EDGES} SELECT child FROM e WHERE parent = 42")
def lineage_children(spark, sf):
    return lineage.children(edges(spark, sf), 42)


@query(f"WITH {_EDGES}, n AS (SELECT child AS node FROM e UNION SELECT parent FROM e) SELECT node, node NOT IN (SELECT child FROM e) AS is_root, node NOT IN (SELECT parent FROM e) AS is_leaf FROM n")
def lineage_roots_leaves(spark, sf):
    return lineage.roots_and_leaves(edges(spark, sf))


@query(
    f"WITH {_EDGES}, n AS (SELECT DISTINCT parent AS node FROM e WHERE parent NOT IN (SELECT child FROM e)) SELECT 0 AS part, 'digraph lineage {{' AS line UNION ALL SELECT 2, '}}' "
    "UNION ALL SELECT 1, concat('  \"', parent, '\" -> \"', child, '\" [label=\"', p_brand, '\"];') FROM e JOIN part ON p_partkey = child UNION ALL SELECT 1, concat('  \"', node, '\" [color=green];') FROM n"
)
def lineage_dot(spark, sf):
    """All edges, a row for each line."""
    own = edges(spark, sf)
    return lineage.dot_lines(own, own.select("operation_id", F.col("operation_id").alias("operation_type")).distinct())


# history: events as operations


def operations(spark, sf):
    status = F.when(F.col("user_id") % 10 == 0, "failed").otherwise("completed")
    return model.read(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("operation_type"), status.alias("status"), F.col("value").alias("ms"))


_OPS = "o AS (SELECT event_id, ts, event_type AS operation_type, user_id % 10 <> 0 AS ok, value AS ms FROM events)"


@query(f"WITH {_OPS} SELECT operation_type, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS completed, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed, round(count(*) FILTER (WHERE ok) / count(*), 6) AS rate, round(avg(ms) FILTER (WHERE ok), 4) AS mean_ms FROM o GROUP BY operation_type")
def op_stats(spark, sf):
    out = lineage.statistics(operations(spark, sf))
    return out.select("operation_type", "total", "completed", "failed", F.round("rate", 6).alias("rate"), F.round("mean_ms", 4).alias("mean_ms"))


@query(f"WITH {_OPS} SELECT event_id FROM o WHERE NOT ok ORDER BY ts DESC, event_id LIMIT 30")
def op_recent(spark, sf):
    return lineage.recent(operations(spark, sf), 30, F.col("status") == "failed", "ts", "event_id").select("event_id")


@query("SELECT event_type AS operation_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE user_id = 7 GROUP BY event_type")
def op_by_type(spark, sf):
    return model.read(spark, sf, "events").where("user_id = 7").groupBy(F.col("event_type").alias("operation_type")).agg(F.count("*").alias("n"))


@query("SELECT CAST(b.bound AS DOUBLE) AS bound, CAST(count(*) FILTER (WHERE value <= b.bound) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS count, round(sum(value), 2) AS total FROM events, (SELECT unnest([0.5, 1, 2.5, 5, 10, 25, 50, 100, 250, 500, 1000]) AS bound) b GROUP BY b.bound")
def latency_histogram(spark, sf):
    return feeds.latency_histogram(model.read(spark, sf, "events"), "value").select("bound", "n", "count", F.round("total", 2).alias("total"))


@query("WITH l AS (SELECT event_type AS field, value FROM events ORDER BY event_id DESC LIMIT 1024) SELECT field, CAST(count(*) AS BIGINT) AS n, round(avg(value), 5) AS mean_ms FROM l GROUP BY field")
def workload_profile(spark, sf):
    log = model.read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("field"), F.col("value").alias("latency_ms"))
    return feeds.profiler(log).select("field", "n", F.round("mean_ms", 5).alias("mean_ms"))


# change feed


def changes(spark, sf):
    e = model.read(spark, sf, "events")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "delete").otherwise("put").alias("op"), F.col("user_id").alias("tensor_id"), F.col("value").alias("record"))


_CHANGES = "c AS (SELECT event_id AS seq, CASE WHEN event_type = 'click' THEN 'delete' ELSE 'put' END AS op, user_id AS tensor_id, value AS record FROM events)"


@query(f"WITH {_CHANGES} SELECT tensor_id, max(seq) AS seq, arg_max(op, seq) AS op, round(arg_max(record, seq), 6) AS record FROM c GROUP BY tensor_id")
def changes_latest(spark, sf):
    return feeds.latest(changes(spark, sf)).select("tensor_id", "seq", "op", F.round("record", 6).alias("record"))


@query(f"WITH {_CHANGES} SELECT seq, op, tensor_id FROM c WHERE seq > 100 ORDER BY seq LIMIT 50")
def changes_since(spark, sf):
    return feeds.changes_since(changes(spark, sf), 100, 50).select("seq", "op", "tensor_id")


@query(f"WITH {_CHANGES}, l AS (SELECT tensor_id, arg_max(op, seq) AS op, arg_max(record, seq) AS record FROM c WHERE seq % 2 = 1 GROUP BY tensor_id), b AS (SELECT tensor_id, arg_max(op, seq) AS op, arg_max(record, seq) AS record FROM c WHERE seq % 2 = 0 GROUP BY tensor_id) SELECT tensor_id, round(record, 6) AS record FROM l WHERE op = 'put' UNION ALL SELECT tensor_id, round(record, 6) FROM b WHERE op = 'put' AND tensor_id NOT IN (SELECT tensor_id FROM l)")
def replica_apply(spark, sf):
    c = changes(spark, sf)
    now = feeds.latest(c.where("seq % 2 = 0")).where("op = 'put'").select("tensor_id", "record")
    return feeds.applied(now, c.where("seq % 2 = 1")).select("tensor_id", F.round("record", 6).alias("record"))


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 7 <> 0")
def fresh_merge(spark, sf):
    v = model.read(spark, sf, "embeddings").select("vec_id", "label")
    return feeds.merged(v.where("vec_id % 2 = 0 OR vec_id % 5 <> 0"), v.where("vec_id % 5 = 0").withColumn("label", F.col("label") + 100), v.where("vec_id % 7 = 0"))


# codecs


@query(f"WITH {base.CELLS}, r AS (SELECT vec_id, min(v) AS low, (max(v) - min(v)) / 255 AS s FROM c GROUP BY vec_id) SELECT vec_id, pos, CAST(greatest(least(round_even(v / s, 0) + trunc(-128 - low / s), 127), -128) AS INTEGER) AS q FROM c JOIN r USING (vec_id)")
def int8_quant(spark, sf):
    v = model.vectors(spark, sf).select("vec_id", codecs.int8("data")["values"].alias("q"))
    return v.select("vec_id", F.posexplode("q").alias("pos", "q")).select("vec_id", F.col("pos").cast("long").alias("pos"), "q")


@query(f"WITH {base.CELLS}, r AS (SELECT vec_id, min(v) AS low, (max(v) - min(v)) / 255 AS s FROM c GROUP BY vec_id) SELECT vec_id, CAST(sum(CAST(round((v - low) / s) AS INTEGER)) AS BIGINT) AS total, bool_and(abs(low + round((v - low) / s) * s - v) <= s / 2 + 1e-9) AS close FROM c JOIN r USING (vec_id) GROUP BY vec_id")
def sq8_quant(spark, sf):
    v = model.vectors(spark, sf).select("vec_id", "data", codecs.sq8("data").alias("code"))
    back = F.zip_with(codecs.from_sq8("code"), "data", lambda x, y: F.abs(x - y) <= F.col("code.scale") / 2 + 1e-9)
    return v.select("vec_id", F.aggregate("code.values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.forall(back, lambda b: b).alias("close"))


@query(f"WITH {base.CELLS} SELECT vec_id, pos AS idx, round(v, 6) AS val FROM c WHERE abs(v) >= 0.2")
def coo_encode(spark, sf):
    thin = F.transform("data", lambda x: F.when(F.abs(x) >= 0.2, x).otherwise(0.0))
    v = model.vectors(spark, sf).select("vec_id", F.explode(codecs.sparse(thin)).alias("p"))
    return v.select("vec_id", F.col("p.idx").cast("long").alias("idx"), F.round("p.val", 6).alias("val"))


@query(f"WITH {base.CELLS} SELECT vec_id, CAST(7 AS INTEGER) AS chunks, round(sum(v), 6) AS total, CAST(64 AS INTEGER) AS n FROM c GROUP BY vec_id")
def chunk_rebuild(spark, sf):
    blocks = codecs.chunked(model.vectors(spark, sf), "vec_id", 10)
    counts = blocks.groupBy("vec_id").agg(F.count("*").cast("int").alias("chunks"))
    back = codecs.rebuilt(blocks, "vec_id").select("vec_id", F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("data").alias("n"))
    return counts.join(back, "vec_id")


@query()
def codec_choice(spark, sf):
    thin = F.when(F.col("vec_id") % 3 == 0, F.transform("data", lambda x: F.when(F.abs(x) >= 0.25, x).otherwise(0.0))).otherwise(F.col("data"))
    return model.vectors(spark, sf).select("vec_id", codecs.codec_choice(thin, [8, 8]).alias("codec"))


# linear algebra: invariants that SQL can check


@query(f"WITH {base.CELLS} SELECT vec_id, round(sum(v * v), 5) AS energy FROM c GROUP BY vec_id")
def svd_values(spark, sf):
    """The squares of the singular values sum to the squared norm."""
    energy = linalg.scalar_udf(lambda a: (np.linalg.svd(a, compute_uv=False) ** 2).sum(), "data", shapes=[[8, 8]])
    return model.vectors(spark, sf).select("vec_id", F.round(energy, 5).alias("energy"))


@query(f"WITH {base.GRID} SELECT vec_id, round(sum(v) FILTER (WHERE i = j), 5) AS trace FROM g GROUP BY vec_id")
def eig_sym(spark, sf):
    """The eigenvalues of the symmetric part sum to the trace."""
    total = linalg.scalar_udf(lambda a: np.linalg.eigvalsh((a + a.T) / 2).sum(), "data", shapes=[[8, 8]])
    return model.vectors(spark, sf).select("vec_id", F.round(total, 5).alias("trace"))


@query("SELECT vec_id, CAST(k AS BIGINT) AS block, round(e[4 * k + 1] * e[4 * k + 4] - e[4 * k + 2] * e[4 * k + 3], 6) AS det FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), (SELECT unnest(range(0, 16)) AS k) u")
def det_2x2(spark, sf):
    """The determinants of the sixteen 2 x 2 blocks that each vector's elements form, one after the other."""
    dets = linalg.array_udf(np.linalg.det, "data", shapes=[[16, 2, 2]])
    v = model.vectors(spark, sf).select("vec_id", F.posexplode(dets).alias("block", "det"))
    return v.select("vec_id", F.col("block").cast("long").alias("block"), F.round("det", 6).alias("det"))


@query()
def det_8x8(spark, sf):
    return model.vectors(spark, sf).select("vec_id", linalg.scalar_udf(np.linalg.det, "data", shapes=[[8, 8]]).alias("det"))


# decompositions, multiplied out again: each element is compared, and facts of the factors beside it


def _again(kernel, sql: str = "v", shape=(4, 4, 4), size: int = 64, udf=linalg.array_udf):
    """A query of what the kernel makes of each vector, element by element, against an SQL expression of pos and v."""

    def run(spark, sf):
        return base.cells(model.vectors(spark, sf).select("vec_id", udf(kernel, "data", shapes=[list(shape)]).alias("data")))

    return run, sql


def _matrix(a):
    return a.reshape(8, 8)


def _lu(a):
    """P L U, with what lies outside the triangles added, and 1 less L's diagonal."""
    p, low, up = linalg.lu(_matrix(a))
    return p @ low @ up + np.abs(np.triu(low, 1)).sum() + np.abs(np.tril(up, -1)).sum() + np.abs(np.diag(low) - 1).sum()


def _qr(a):
    q, r = np.linalg.qr(_matrix(a))
    return q @ r + np.abs(np.tril(r, -1)).sum() + np.abs(q.T @ q - np.eye(8)).sum()


def _cholesky(a):
    m = _matrix(a) @ _matrix(a).T + np.eye(8)
    low = linalg.cholesky(m)
    return low @ low.T + np.abs(np.triu(low, 1)).sum()


def _t_svd(a):
    u, s, v = linalg.t_svd(a)
    return linalg.t_product(linalg.t_product(u, s), linalg.t_transpose(v))


def _inverse(a):
    """The inverse times twice the matrix: 2 on the diagonal."""
    m = _matrix(a) + 9 * np.eye(8)
    return np.linalg.inv(m) @ (2 * m)


def _orthonormal(factors) -> float:
    return sum(np.abs(f.T @ f - np.eye(f.shape[1])).sum() for f in factors if f is not None)


def _hosvd(a):
    core, factors = linalg.hosvd(a)
    return linalg.from_tucker(core, factors) + _orthonormal(factors)


def _tucker(a):
    core, factors = linalg.tucker(a, [4, 4, 4], 2)
    return linalg.from_tucker(core, factors) + _orthonormal(factors)


def _partial(a):
    core, factors = linalg.partial_tucker(a, [4, None, 4], 2)
    return linalg.from_partial_tucker(core, factors) + _orthonormal(factors)


def _rank_one(a):
    """The outer product of the tensor's sums over all but one of the last three dimensions: of rank one in every sense."""
    return np.einsum("...i,...j,...k->...ijk", a.sum((-2, -1)), a.sum((-3, -1)), a.sum((-3, -2)))


_MARGINS = "x AS (SELECT vec_id, pos // 16 AS i, sum(v) AS x FROM c GROUP BY ALL), y AS (SELECT vec_id, pos // 4 % 4 AS j, sum(v) AS y FROM c GROUP BY ALL), z AS (SELECT vec_id, pos % 4 AS k, sum(v) AS z FROM c GROUP BY ALL)"

for _name, (_run, _sql) in {
    "lu_recon": _again(_lu), "qr_recon": _again(_qr), "tsvd_recon": _again(_t_svd), "tucker_recon": _again(_tucker), "partial_tucker_recon": _again(_partial), "hosvd_recon": _again(_hosvd),
    "tt_recon": _again(lambda a: linalg.from_train(linalg.tensor_train(a, 16))), "ring_recon": _again(lambda a: linalg.from_train(linalg.tensor_ring(a, 16, 2))),
    "ht_recon": _again(lambda a: linalg.from_hierarchical(linalg.hierarchical_tucker(a, 16), a.shape)),
    "inverse_recon": _again(_inverse, "CASE WHEN pos // 8 = pos % 8 THEN 2.0 ELSE 0.0 END"),
    "cholesky_recon": _again(_cholesky, "list_sum(list_transform(range(1, 9), lambda k: e[pos // 8 * 8 + k] * e[pos % 8 * 8 + k])) + CASE WHEN pos // 8 = pos % 8 THEN 1 ELSE 0 END"),
}.items():
    _run.__name__ = _name
    # adding 0 turns a negative zero into a positive one
    query(f"WITH {base.CELLS}, e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, pos, round({_sql}, 6) + 0 AS value FROM c JOIN e USING (vec_id)")(_run)


# truncated ranks: what has rank one comes back whole from factors of rank one
for _name, _kernel in {
    "cp_rank_one": lambda a: linalg.from_cp(linalg.cp(_rank_one(a), 1)),
    "tucker_rank_one": lambda a: linalg.from_tuckers(*linalg.tuckers(_rank_one(a), [1, 1, 1], 2)),
    "tt_rank_one": lambda a: linalg.from_train(linalg.tensor_train(_rank_one(a), 1)),
    "ht_rank_one": lambda a: linalg.from_hierarchical(linalg.hierarchical_tucker(_rank_one(a), 1), a.shape),
    "block_terms_rank_one": lambda a: sum(linalg.from_tuckers(*t) for t in linalg.block_terms_of(_rank_one(a), [(1, 1, 1)])),
}.items():
    _run, _ = _again(_kernel, udf=linalg.stacked_udf if _name in ("tucker_rank_one", "block_terms_rank_one") else linalg.array_udf)
    _run.__name__ = _name
    query(f"WITH {base.CELLS}, {_MARGINS} SELECT vec_id, i * 16 + j * 4 + k AS pos, round(x * y * z, 6) + 0 AS value FROM x JOIN y USING (vec_id) JOIN z USING (vec_id)")(_run)


@query(f"WITH {base.GRID}, m AS (SELECT x.vec_id, x.j // 2 AS block, x.j % 2 AS i, y.j % 2 AS j, sum(x.v * y.v) AS w FROM g x JOIN g y ON x.vec_id = y.vec_id AND x.i = y.i AND x.j // 2 = y.j // 2 GROUP BY ALL), p AS (SELECT vec_id, block, sum(w) FILTER (WHERE i = 0 AND j = 0) AS a, sum(w) FILTER (WHERE i = 0 AND j = 1) AS b, sum(w) FILTER (WHERE i = 1 AND j = 1) AS d FROM m GROUP BY ALL) SELECT vec_id, block, round(sqrt((a + d + sqrt((a - d) * (a - d) + 4 * b * b)) / 2), 6) AS s1, round(sqrt(greatest(0, (a + d - sqrt((a - d) * (a - d) + 4 * b * b)) / 2)), 6) AS s2 FROM p")
def svd_two_columns(spark, sf):
    """The singular values of each two neighbouring columns of the matrices, against the roots of their 2 x 2 Gram matrices."""
    values = linalg.array_udf(lambda a: np.concatenate([np.linalg.svd(a[:, k : k + 2], compute_uv=False) for k in range(0, 8, 2)]), "data", shapes=[[8, 8]])
    rows = model.vectors(spark, sf).select("vec_id", F.posexplode(values).alias("pos", "s"))
    block = F.floor(F.col("pos") / 2).cast("long").alias("block")
    return rows.groupBy("vec_id", block).agg(F.round(F.max("s"), 6).alias("s1"), F.round(F.min("s"), 6).alias("s2"))


@query(f"WITH {base.CELLS}, q AS (SELECT vec_id, pos % 2 AS r, sum(v * v) AS n FROM c GROUP BY ALL) SELECT vec_id, round(sqrt(max(n)), 6) AS spectral, round(sum(sqrt(n)), 6) AS nuclear, CAST(count(*) FILTER (WHERE n > 1e-20) AS INTEGER) AS rank FROM q GROUP BY vec_id")
def norms_of_orthogonal_rows(spark, sf):
    """Spectral and nuclear norm and rank of a matrix of two orthogonal rows, the even and the odd elements."""

    def rows(a):
        out = np.zeros((2, 64))
        out[0, ::2], out[1, 1::2] = a[::2], a[1::2]
        return out

    facts = linalg.array_udf(lambda a: np.array([linalg.l2_norm(rows(a)), linalg.nuclear_norm(rows(a)), linalg.matrix_facts(rows(a))["rank"]]), "data", shapes=[[64]])
    v = model.vectors(spark, sf).select("vec_id", facts.alias("f"))
    return v.select("vec_id", F.round(F.get("f", F.lit(0)), 6).alias("spectral"), F.round(F.get("f", F.lit(1)), 6).alias("nuclear"), F.get("f", F.lit(2)).cast("int").alias("rank"))


@query()
def matrix_descriptor(spark, sf):
    out = base.described(spark, sf, matrices=True)
    return out.select("vec_id", "rank", *[F.round(c, 4).alias(c) for c in ("condition_number", "spectral_norm", "nuclear_norm", "trace", "determinant", "eigen_min", "eigen_max")], "is_symmetric", "is_orthogonal", "is_diagonal")


# series


@query(f"WITH {base.CELLS} SELECT pos, round(v, 6) AS value FROM c WHERE vec_id = 5")
def ts_load(spark, sf):
    v = model.vectors(spark, sf)
    rows = v.select(F.col("vec_id").alias("seq"), F.array(F.lit(64).cast("bigint")).alias("shape"), "data", F.to_json(F.struct(F.col("vec_id").cast("string").alias("name"))).alias("metadata"))
    return series.loaded(rows, "5").select(F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query(
    "WITH RECURSIVE y AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS y FROM events GROUP BY ALL), l AS (SELECT event_type, day, y, lag(y) OVER (PARTITION BY event_type ORDER BY day) AS x FROM y), "
    "f AS (SELECT event_type, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, arg_max(y, day) AS last FROM l GROUP BY event_type), "
    "s(event_type, step, value) AS (SELECT event_type, 1, a + b * last FROM f UNION ALL SELECT s.event_type, step + 1, a + b * value FROM s JOIN f USING (event_type) WHERE step < 5) SELECT event_type, CAST(step AS INTEGER) AS step, round(value, 3) AS value FROM s"
)
def ts_ar1_forecast(spark, sf):
    """An autoregression of one step, which least squares solve in closed form."""
    daily = model.read(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))
    return series.forecast(daily, "event_type", "day", "y", 1, 0, 5).select("event_type", "step", F.round("value", 3).alias("value"))


@query()
def ts_ar_forecast(spark, sf):
    daily = model.read(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))
    return series.forecast(daily, "event_type", "day", "y", 2, 1, 5)


# extensions


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling(spark, sf):
    out = feeds.tumbling(model.read(spark, sf, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k")
def ext_session(spark, sf):
    return feeds.sessions(model.read(spark, sf, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
