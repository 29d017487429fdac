"""Similarity, vector and text search, hybrid ranking, the query language and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tensorloom import model
from tensorloom.functions import dense as D
from tensorloom.operators import search, vectors
from tensorloom.plans import nql, plan
from tensorloom.queries import tensors as base

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def first(spark, sf, vec_id: int = 0) -> list[float]:
    """A query vector: one row of the table."""
    return model.vectors(spark, sf).where(F.col("vec_id") == vec_id).first().data


QV = f"{base.CELLS}, q AS (SELECT pos, v AS w FROM c WHERE vec_id = 0), d AS (SELECT vec_id, label, sum((v - w) * (v - w)) AS d2, sum(v * w) AS ip, sqrt(sum(v * v)) AS nv, sqrt(sum(w * w)) AS nw, sum(abs(v)) AS l1 FROM c JOIN q USING (pos) GROUP BY ALL)"


def _top(expr, k=10, where="true"):
    return f"WITH {QV}, s AS (SELECT *, {expr} AS sc FROM d WHERE {where}) SELECT vec_id, round(sc, 6) AS score, CAST(row_number() OVER (ORDER BY sc DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= {k}"


def _similar(spark, sf, metric):
    return search.find_similar(model.vectors(spark, sf), first(spark, sf), metric, 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(_top("1 / (1 + sqrt(d2))"))
def sim_frobenius(spark, sf):
    return _similar(spark, sf, "frobenius")


@query(_top("ip / (nv * nw)"))
def sim_cosine(spark, sf):
    return _similar(spark, sf, "cosine")


@query(_top("1 / (1 + sqrt(d2) / nw)"))
def sim_relative(spark, sf):
    return _similar(spark, sf, "relative")


@query()
def sim_spectral(spark, sf):
    return _similar(spark, sf, "spectral")


@query(_top("ip / (nv * nw)", 10, "label = 3"))
def knn_filtered(spark, sf):
    out = search.nearest(model.vectors(spark, sf), first(spark, sf), 10, "cosine", F.col("label") == 3)
    return out.select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(_top("1 / (1 + d2)"))
def knn_l2(spark, sf):
    out = search.nearest(model.vectors(spark, sf), first(spark, sf), 10, "l2")
    return out.select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {QV}, s AS (SELECT vec_id, ip / (nv * nw) AS sc, row_number() OVER (ORDER BY ip / (nv * nw) DESC, vec_id) AS r FROM d) SELECT vec_id, round(sc, 6) AS score FROM s WHERE r <= 20 AND sc >= 0.2")
def knn_threshold(spark, sf):
    out = search.nearest(model.vectors(spark, sf), first(spark, sf), 20, "cosine", least_score=0.2)
    return out.select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {base.CELLS}, p AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.v * b.v) / sqrt(sum(a.v * a.v)) / sqrt(sum(b.v * b.v)) AS sc FROM c a JOIN c b ON a.pos = b.pos AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY ALL) SELECT query_id, vec_id, round(sc, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, vec_id) AS INTEGER) AS rank FROM p QUALIFY rank <= 3")
def knn_join_top3(spark, sf):
    """The three nearest of every row whose id is divisible by 20, among all rows."""
    v = model.vectors(spark, sf)
    out = search.knn_join(v.where("vec_id % 20 = 0"), v, 3)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query()
def ivf_search(spark, sf):
    """The ten nearest of every row whose id is divisible by 20, in ten of sixteen lists that k-means finds."""
    v = model.vectors(spark, sf)
    out = vectors.Partitions(v, lists=16).knn_join(v.where("vec_id % 20 = 0"), 10, "cosine", 10)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query()
def contraction_topk(spark, sf):
    out = search.contraction_search(model.vectors(spark, sf), first(spark, sf), [8, 8], 10, 3, "vec_id")
    return out.select("vec_id", F.round("score", 5).alias("score"), "rank")


@query(f"WITH {QV}, s AS (SELECT vec_id, ip / (nv * nw) AS s, row_number() OVER (ORDER BY ip / (nv * nw) DESC, vec_id) AS r FROM d), t AS (SELECT vec_id, l1 / 10 AS c FROM d WHERE l1 > 6.4), h AS (SELECT vec_id, coalesce(s, 0) AS s, coalesce(c, 0) AS c FROM (SELECT vec_id, s FROM s WHERE r <= 20) FULL JOIN t USING (vec_id)) SELECT vec_id, round(s, 6) AS semantic, round(c, 6) AS computational, round(0.7 * s + 0.3 * c, 6) AS hybrid, CAST(row_number() OVER (ORDER BY 0.7 * s + 0.3 * c DESC, vec_id) AS INTEGER) AS rank FROM h WHERE s <> 0 OR c <> 0 QUALIFY rank BETWEEN 6 AND 15")
def hybrid_rank(spark, sf):
    semantic = search.nearest(model.vectors(spark, sf), first(spark, sf), 20).select("vec_id", F.col("score").alias("semantic"))
    computational = base.described(spark, sf).where("l1_norm > 6.4").select("vec_id", (F.col("l1_norm") / 10).alias("computational"))
    out = search.hybrid(semantic, computational, k=10, offset=5, key="vec_id")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("semantic", "computational", "hybrid")], "rank")


@query("SELECT p_partkey, round((least(p_size, 20)::DOUBLE / greatest(p_size, 20) + 1) / 2, 6) AS score FROM part")
def shape_score(spark, sf):
    shape = F.array(F.col("p_size").cast("bigint"), F.lit(4).cast("bigint"))
    return model.read(spark, sf, "part").select("p_partkey", F.round(search.shape_similarity(shape, [20, 4]), 6).alias("score"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 4 = 2 THEN 0.8 ELSE 0.1 END AS DOUBLE) AS svd, CAST(CASE WHEN p_size % 4 >= 3 THEN 0.9 ELSE 0.1 END AS DOUBLE) AS tucker, CAST(CASE WHEN p_size % 4 >= 3 THEN 0.7 ELSE 0.1 END AS DOUBLE) AS conv, CAST(0.5 AS DOUBLE) AS normalize, CAST(0.1 AS DOUBLE) AS other FROM part")
def op_compat(spark, sf):
    n = F.col("p_size") % 4
    names = {"svd": "svd", "tucker": "tucker", "conv": "conv2d", "normalize": "normalize", "other": "sort"}
    return model.read(spark, sf, "part").select("p_partkey", *[search.operation_score(op, n).cast("double").alias(c) for c, op in names.items()])


# text

_TOKENS = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')"


@query(f"WITH t AS (SELECT doc_id, len(list_filter({_TOKENS}, lambda x: x = 'the')) AS a, len(list_filter({_TOKENS}, lambda x: x = 'une')) AS b FROM documents), s AS (SELECT doc_id, CASE WHEN a > 0 THEN 1 + 0.01 * a ELSE 0 END + CASE WHEN b > 0 THEN 1 + 0.01 * b ELSE 0 END AS s FROM t) SELECT doc_id, round(CAST(s AS DOUBLE), 4) AS score FROM s WHERE s > 0")
def fulltext_score(spark, sf):
    return search.full_text(model.read(spark, sf, "documents"), "The une").select("doc_id", F.round("score", 4).alias("score"))


@query("SELECT CAST(p_size AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_size > 10 GROUP BY p_size")
def facet_counts(spark, sf):
    return search.facets(model.read(spark, sf, "part").withColumn("p_size", F.when(F.col("p_size") > 10, F.col("p_size"))), "p_size")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_brand), 'an')")
def substr_search(spark, sf):
    from tensorloom.operators import catalog

    part = model.read(spark, sf, "part").withColumn("tags", F.split("p_name", " "))
    return part.where(catalog.contains_any("AN", ["p_brand"], ["tags"])).select("p_partkey")


@query("SELECT doc_id, CAST(len(list_filter(" + _TOKENS + ", lambda x: x <> '')) AS BIGINT) AS n FROM documents")
def tokenise_count(spark, sf):
    return model.read(spark, sf, "documents").select("doc_id", F.size(search.tokens("text")).cast("long").alias("n"))


# the query language over parts as tensors of two elements


def parts(spark, sf):
    p = model.read(spark, sf, "part")
    meta = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_size").cast("string").alias("code"), F.col("p_retailprice").alias("price"), (F.col("p_size") > 25).alias("large")))
    data = F.array(F.col("p_size").cast("double"), F.col("p_retailprice"))
    return p.select(F.lit("parts").alias("dataset"), F.col("p_partkey").alias("tensor_id"), F.col("p_partkey").alias("seq"), F.array(F.lit(2).cast("bigint")).alias("shape"), data.alias("data"), meta.alias("metadata"))


@query("SELECT CAST(count(*) AS BIGINT) AS count FROM part")
def nql_count(spark, sf):
    return nql.run(parts(spark, sf), "count records in parts")


def _nql(name, text, sql):
    def run(spark, sf):
        return nql.run(parts(spark, sf), text).select(F.col("tensor_id").alias("p_partkey"))

    run.__name__ = name
    query(f"SELECT p_partkey FROM part WHERE {sql}")(run)


_nql("nql_get_all", "get all records from parts", "true")
_nql("nql_meta_eq", "find records from parts where brand is 'Brand#11'", "p_brand = 'Brand#11'")
_nql("nql_meta_range", "find records from parts where size >= 40", "p_size >= 40")
_nql("nql_tensor_idx", "find tensors from parts where tensor[1] > 910.5", "p_retailprice > 910.5")
_nql("nql_string_vs_num", "find records from parts where code = 7", "p_size = 7")
_nql("nql_string_range", "find records from parts where code > 7", "false")
_nql("nql_bool_text", "find records from parts where large = 'True'", "p_size > 25")


@query("SELECT p_partkey FROM part WHERE (p_size > 45 OR p_size < 3) AND p_retailprice < 1500")
def nql_tree(spark, sf):
    parsed = {"filters": [{"joiner": "OR", "conditions": [{"key": "size", "operator": ">", "value": 45}, {"key": "size", "operator": "<", "value": 3}, {"key": "size", "operator": "~", "value": 0}]}, {"joiner": "AND", "conditions": [{"key": "tensor[1]", "operator": "<", "value": 1500}]}]}
    return parts(spark, sf).where(nql.tree(parsed)).select(F.col("tensor_id").alias("p_partkey"))


# plans


def planned(spark, sf):
    return base.described(spark, sf).select(F.lit("v").alias("dataset"), F.col("vec_id").alias("tensor_id"), F.col("vec_id").alias("seq"), "*")


@query("SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 100 OFFSET 20")
def plan_scan(spark, sf):
    return plan.compiled({"op": "scan", "dataset": "v", "offset": 20}, planned(spark, sf)).select("vec_id")


@query(f"WITH {base.L1} SELECT vec_id FROM n WHERE l1 > 6.5 AND mean < 0 ORDER BY vec_id LIMIT 40")
def plan_index_lookup(spark, sf):
    p = {"op": "index_lookup", "dataset": "v", "limit": 40, "predicates": [{"field": "l1_norm", "op": "gt", "value": 6.5}, {"field": "mean", "op": "lt", "value": 0}, {"field": "is_square", "op": "eq", "value": True}]}
    return plan.compiled(p, planned(spark, sf)).select("vec_id")


@query(_top("ip / (nv * nw)", 7))
def plan_vector(spark, sf):
    p = plan.VectorSearch("v", tuple(first(spark, sf)), 7)
    return plan.compiled(p, planned(spark, sf)).select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {base.L1} SELECT round(max(l1), 6) AS value FROM n WHERE mean < 0")
def plan_aggregate(spark, sf):
    p = {"op": "aggregate", "dataset": "v", "function": "max", "field": "l1_norm", "predicates": [{"field": "mean", "op": "<", "value": 0}]}
    return plan.compiled(p, planned(spark, sf)).select(F.round("value", 6).alias("value"))


@query("SELECT event_type AS field, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type ORDER BY n DESC, field LIMIT 3")
def hot_fields(spark, sf):
    log = model.read(spark, sf, "events").select(F.col("event_type").alias("field"), F.col("value").alias("latency_ms"))
    return plan.index_advice(log, 3).select("field", "n")


def flagship(spark, sf):
    rows = base.described(spark, sf).where("l1_norm BETWEEN 6.2 AND 6.6")
    out = search.ranked(rows.withColumn("score", D.cosine_similarity("data", search.literal(first(spark, sf)))), 10, tie="vec_id")
    return out.select("vec_id", "label", F.round("l1_norm", 6).alias("l1_norm"), F.round("score", 6).alias("score"), "rank")


flagship.__name__ = "flagship"
query(f"WITH {QV} SELECT vec_id, label, round(l1, 6) AS l1_norm, round(ip / (nv * nw), 6) AS score, CAST(row_number() OVER (ORDER BY ip / (nv * nw) DESC, vec_id) AS INTEGER) AS rank FROM d WHERE l1 BETWEEN 6.2 AND 6.6 QUALIFY rank <= 10")(flagship)
