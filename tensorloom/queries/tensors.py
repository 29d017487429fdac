"""Element-wise operators, shapes, products, reductions, norms, statistics and descriptors on ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom import model
from tensorloom.functions import dense as D
from tensorloom.functions import descriptor, dual
from tensorloom.operators import elements as E
from tensorloom.operators import linalg

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Each vector and, beside it, the vector with the next id.
PAIRS = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), p AS (SELECT x.vec_id, x.a, y.a AS b FROM e x JOIN e y ON y.vec_id = x.vec_id + 1)"
CELLS = "c AS (SELECT vec_id, label, CAST(u.i AS BIGINT) - 1 AS pos, CAST(embedding[u.i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u)"
GRID = f"{CELLS}, g AS (SELECT vec_id, label, pos // 8 AS i, pos % 8 AS j, v FROM c)"


def pairs(spark, sf) -> DataFrame:
    v = model.vectors(spark, sf).select("vec_id", F.col("data").alias("a"))
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


def cells(df: DataFrame, column: str = "data", digits: int = 6) -> DataFrame:
    out = model.elements(df, "vec_id", column)
    return out.select("vec_id", "pos", (F.round("value", digits) + 0.0).alias("value"))


def _binary(name, op, sql):
    def run(spark, sf):
        return cells(pairs(spark, sf).select("vec_id", op().alias("data")))

    run.__name__ = name
    query(f"WITH {PAIRS} SELECT vec_id, CAST(i AS BIGINT) - 1 AS pos, round({sql}, 6) AS value FROM p, (SELECT unnest(range(1, 65)) AS i) u")(run)


_binary("ew_add", lambda: D.add("a", "b"), "a[i] + b[i]")
_binary("ew_sub", lambda: D.subtract("a", "b"), "a[i] - b[i]")
_binary("ew_mul", lambda: D.multiply(D.multiply("a", 1000.0), "b"), "a[i] * 1000 * b[i]")
_binary("ew_div", lambda: D.divide("a", D.add("b", 10.0)), "a[i] / (b[i] + 10)")
_binary("ew_pow", lambda: D.power("a", 2.0), "pow(a[i], 2)")
_binary("ew_log", lambda: D.log(D.add("a", 2.0)), "ln(a[i] + 2)")


@query(f"WITH {PAIRS} SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i])), 6) AS dot FROM p")
def dot_neighbours(spark, sf):
    return pairs(spark, sf).select("vec_id", F.round(D.dot("a", "b"), 6).alias("dot"))


@query(f"WITH {PAIRS} SELECT vec_id, CAST(i AS BIGINT) - 1 AS pos, round(a[i] * list_sum(b), 6) + 0 AS total, round(a[i] * b[i], 6) + 0 AS diagonal FROM p, (SELECT unnest(range(1, 65)) AS i) u")
def outer_rows(spark, sf):
    """The 64 x 64 outer products of neighbours, by row: its sum and its element on the diagonal."""
    v = pairs(spark, sf).select("vec_id", D.outer("a", "b").alias("o"))
    rows = v.select("vec_id", F.posexplode(model.nested("o", [64, 64])).alias("pos", "row"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round(D.total("row"), 6) + 0.0).alias("total"), (F.round(F.get("row", F.col("pos")), 6) + 0.0).alias("diagonal"))


@query(f"WITH {PAIRS} SELECT vec_id, CAST(i AS BIGINT) - 1 AS pos, round(a[i + 1] * b[i + 2] - a[i + 2] * b[i + 1], 6) AS x, round(a[i + 2] * b[i] - a[i] * b[i + 2], 6) AS y, round(a[i] * b[i + 1] - a[i + 1] * b[i], 6) AS z FROM p, (SELECT unnest(range(1, 63)) AS i) u")
def cross_windows(spark, sf):
    """The cross product of each three consecutive elements of neighbours."""
    at = F.explode(F.sequence(F.lit(0), F.lit(61))).alias("pos")
    w = pairs(spark, sf).select("vec_id", at, "a", "b").select("vec_id", "pos", D.cross(F.slice("a", F.col("pos") + 1, F.lit(3)), F.slice("b", F.col("pos") + 1, F.lit(3))).alias("c"))
    return w.select("vec_id", F.col("pos").cast("long").alias("pos"), *[F.round(F.get("c", F.lit(i)), 6).alias(n) for i, n in enumerate("xyz")])


@query(f"WITH {GRID} SELECT x.vec_id, x.i, y.j, round(sum(x.v * y.v), 6) AS value FROM g x JOIN g y ON x.vec_id = y.vec_id AND x.j = y.i GROUP BY ALL")
def matmul_8x8(spark, sf):
    """Each matrix times itself: dense rows, no shuffle."""
    square = linalg.matmul_udf("data", "data", [8, 8], [8, 8])
    v = model.vectors(spark, sf).select("vec_id", F.posexplode(square).alias("pos", "value"))
    return v.select("vec_id", F.floor(F.col("pos") / 8).cast("long").alias("i"), (F.col("pos") % 8).cast("long").alias("j"), F.round("value", 6).alias("value"))


@query(f"WITH {GRID} SELECT x.vec_id, x.i, y.j, round(sum(x.v * y.v), 6) AS value FROM g x JOIN g y ON x.vec_id = y.vec_id AND x.j = y.i GROUP BY ALL")
def matmul_elements(spark, sf):
    """The same in the element form, which large or sparse matrices need."""
    m = model.matrices(spark, sf)
    return E.matmul(m, m, "vec_id").select("vec_id", "i", "j", F.round("value", 6).alias("value"))


@query(f"WITH {GRID} SELECT x.vec_id, x.i, y.i AS j, round(sum(x.v * y.v), 6) AS value FROM g x JOIN g y ON x.vec_id = y.vec_id AND x.j = y.j GROUP BY ALL")
def gram_einsum(spark, sf):
    """einsum bik,bjk->bij."""
    m = model.matrices(spark, sf).select(F.col("vec_id").alias("i0"), F.col("i").alias("i1"), F.col("j").alias("i2"), "value")
    out = E.einsum("bik,bjk->bij", m, m)
    return out.select(F.col("i0").alias("vec_id"), F.col("i1").alias("i"), F.col("i2").alias("j"), F.round("value", 6).alias("value"))


@query(f"WITH {GRID}, w AS (SELECT i, j, sum(v) AS v FROM g GROUP BY ALL) SELECT x.vec_id, w.j AS k, round(sum(x.v * w.v * y.v), 4) AS value FROM g x JOIN w ON w.i = x.j JOIN g y ON y.vec_id = x.vec_id AND y.i = x.i AND y.j = w.j GROUP BY ALL")
def einsum_three_operands(spark, sf):
    m = model.matrices(spark, sf)
    three = m.select(F.col("vec_id").alias("i0"), F.col("i").alias("i1"), F.col("j").alias("i2"), "value")
    two = E.summed(m, "i", "j").select(F.col("i").alias("i0"), F.col("j").alias("i1"), "value")
    out = E.einsum("bij,jk,bik->bk", three, two, three, sizes={"b": 10_000})
    return out.select(F.col("i0").alias("vec_id"), F.col("i1").alias("k"), F.round("value", 4).alias("value"))


@query(f"WITH {GRID} SELECT vec_id, j * 8 + i AS pos, round(v, 6) AS value FROM g")
def transpose_8x8(spark, sf):
    return cells(model.vectors(spark, sf).select("vec_id", D.transpose("data", 8, 8).alias("data")))


@query(f"WITH {CELLS} SELECT vec_id, (pos % 4) * 16 + (pos // 16) * 4 + (pos // 4) % 4 AS pos, round(v, 6) AS value FROM c")
def permute_444(spark, sf):
    return cells(model.vectors(spark, sf).select("vec_id", D.permute("data", [4, 4, 4], [2, 0, 1]).alias("data")))


@query("SELECT vec_id, CAST(2 AS BIGINT) AS d0, CAST(32 AS BIGINT) AS d1, 2 AS squeezed, 4 AS unsqueezed, CAST(64 AS BIGINT) AS flat FROM embeddings")
def reshape_64(spark, sf):
    v = model.vectors(spark, sf).withColumn("shape", F.array(*[F.lit(d).cast("bigint") for d in (1, 8, 8)]))
    to = D.reshape("shape", [2, 32])
    return v.select("vec_id", to[0].alias("d0"), to[1].alias("d1"), F.size(D.squeeze_shape("shape")).alias("squeezed"), F.size(D.unsqueeze_shape("shape", 0)).alias("unsqueezed"), D.flatten_shape("shape")[0].alias("flat"))


@query(f"WITH {PAIRS} SELECT vec_id, CAST(i AS BIGINT) - 1 AS pos, round(list_concat(a, b)[i], 6) AS value FROM p, (SELECT unnest(range(1, 129)) AS i) u")
def concat_vec(spark, sf):
    return cells(pairs(spark, sf).select("vec_id", F.concat("a", "b").alias("data")))


@query("WITH s AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, embedding FROM embeddings) SELECT label, CAST(k * 64 + i - 1 AS BIGINT) AS pos, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM s, (SELECT unnest(range(1, 65)) AS i) u")
def stack_label(spark, sf):
    """The n vectors of each label as one tensor of shape (n, 64), in element form."""
    at = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    v = model.vectors(spark, sf).withColumn("at", at)
    e = v.select("label", "at", F.posexplode("data").alias("pos", "value"))
    return e.select("label", (F.col("at") * 64 + F.col("pos")).cast("long").alias("pos"), F.round("value", 6).alias("value"))


_REDUCED = "round(sum(v), 6) AS sum, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(var_pop(v), 6) AS var, round(stddev_pop(v), 6) AS std"


def _reduced(spark, sf, kept, over):
    out = E.reduced(model.matrices(spark, sf), ["vec_id", kept], over)
    return out.select("vec_id", kept, *[F.round(c, 6).alias(c) for c in ("sum", "mean", "min", "max", "var", "std")])


@query(f"WITH {GRID} SELECT vec_id, j, {_REDUCED} FROM g GROUP BY ALL")
def reduce_dim0(spark, sf):
    return _reduced(spark, sf, "j", "i")


@query(f"WITH {GRID} SELECT vec_id, i, {_REDUCED} FROM g GROUP BY ALL")
def reduce_dim1(spark, sf):
    return _reduced(spark, sf, "i", "j")


@query(f"WITH {GRID} SELECT vec_id, i, arg_min(j, (v, j)) AS argmin, arg_max(j, (v, -j)) AS argmax FROM g GROUP BY ALL")
def argmax_dim(spark, sf):
    return E.reduced(model.matrices(spark, sf), ["vec_id", "i"], "j").select("vec_id", "i", "argmin", "argmax")


@query(f"WITH {CELLS} SELECT vec_id, round(sum(v), 6) AS total, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS var, round(var_samp(v), 6) AS var_samp, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high FROM c GROUP BY vec_id")
def reduce_all(spark, sf):
    d = "data"
    return model.vectors(spark, sf).select("vec_id", *[F.round(x, 6).alias(n) for n, x in (("total", D.total(d)), ("mean", D.mean(d)), ("var", D.variance(d)), ("var_samp", D.variance(d, True)), ("std", D.std(d)), ("low", F.array_min(d)), ("high", F.array_max(d)))])


@query(f"WITH {CELLS} SELECT vec_id, round(sum(abs(v)), 6) AS l1, round(sqrt(sum(v * v)), 6) AS frobenius, round(max(abs(v)), 6) AS linf, round(pow(sum(pow(abs(v), 3)), 1.0 / 3), 6) AS p3 FROM c GROUP BY vec_id")
def desc_norms(spark, sf):
    return model.vectors(spark, sf).select("vec_id", *[F.round(x, 6).alias(n) for n, x in (("l1", D.l1_norm("data")), ("frobenius", D.frobenius_norm("data")), ("linf", D.linf_norm("data")), ("p3", D.p_norm("data", 3)))])


def described(spark, sf, matrices: bool = False) -> DataFrame:
    v = model.vectors(spark, sf).withColumn("shape", F.array(F.lit(8).cast("bigint"), F.lit(8).cast("bigint")))
    return descriptor.described(v, matrices)


@query(f"WITH {CELLS} SELECT vec_id, CAST(count(*) AS BIGINT) AS num_elements, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, CAST(count(*) FILTER (WHERE v = 0) AS DOUBLE) / 64 AS sparsity, true AS is_square FROM c GROUP BY vec_id")
def desc_stats(spark, sf):
    return described(spark, sf).select("vec_id", "num_elements", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "sparsity", "is_square")


@query(f"WITH {GRID} SELECT x.vec_id, round(sum(x.v) FILTER (WHERE x.i = x.j), 6) AS trace, bool_and(abs(x.v - y.v) <= 1e-8 + 1e-5 * abs(y.v)) AS symmetric FROM g x JOIN g y ON x.vec_id = y.vec_id AND x.i = y.j AND x.j = y.i GROUP BY x.vec_id")
def desc_trace(spark, sf):
    return model.vectors(spark, sf).select("vec_id", F.round(D.trace("data", 8), 6).alias("trace"), D.is_symmetric("data", 8).alias("symmetric"))


@query(f"WITH {GRID} SELECT vec_id, round(sum(v), 6) AS value FROM g WHERE i = j GROUP BY vec_id")
def trace_elements(spark, sf):
    return E.trace(model.matrices(spark, sf), "i", "j", "vec_id").select("vec_id", F.round("value", 6).alias("value"))


L1 = f"{CELLS}, n AS (SELECT vec_id, label, sum(abs(v)) AS l1, avg(v) AS mean FROM c GROUP BY ALL)"


@query(f"WITH {L1} SELECT vec_id, round(l1, 6) AS l1_norm FROM n WHERE l1 BETWEEN 6.2 AND 6.6")
def norm_range(spark, sf):
    return described(spark, sf).where(descriptor.norm_between(6.2, 6.6, "l1")).select("vec_id", F.round("l1_norm", 6).alias("l1_norm"))


@query("SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND vec_id % 2 = 0")
def shape_filter(spark, sf):
    even = F.array(F.lit(8).cast("bigint"), F.lit(8).cast("bigint"))
    v = model.vectors(spark, sf).withColumn("shape", F.when(F.col("vec_id") % 2 == 0, even).otherwise(F.array(F.lit(64).cast("bigint"))))
    return v.where(descriptor.shape_is([8, 8]) & descriptor.shape_where(ndim=2, size=(64, 64), aspect=(1.0, 1.0)) & descriptor.matmul_compatible([3, 8]) & descriptor.decomposition_candidate("svd", 8)).select("vec_id")


@query(f"WITH {L1} SELECT vec_id, round(l1, 6) AS l1_norm, CAST(row_number() OVER (ORDER BY l1 DESC, vec_id) AS INTEGER) AS rank FROM n QUALIFY rank <= 20")
def rank_norms_topk(spark, sf):
    from tensorloom.operators import search

    return search.ranked(described(spark, sf), 20, "l1_norm", "vec_id").select("vec_id", F.round("l1_norm", 6).alias("l1_norm"), "rank")


@query(f"WITH {L1} SELECT CAST(label AS VARCHAR) AS key, round(avg(l1), 5) AS value FROM n GROUP BY label")
def agg_norm_by_label(spark, sf):
    from tensorloom.operators import catalog

    return catalog.grouped(described(spark, sf), "label", "avg", "l1_norm").select("key", F.round("value", 5).alias("value"))


for _f, _sql in (("count", "CAST(count(*) AS DOUBLE)"), ("sum", "sum(l1)"), ("avg", "avg(l1)"), ("min", "min(l1)"), ("max", "max(l1)")):

    def _run(spark, sf, f=_f):
        return descriptor.aggregate(described(spark, sf), f, "l1_norm").select(F.round("value", 4).alias("value"))

    _run.__name__ = f"v1_aggregate_{_f}"
    query(f"WITH {L1} SELECT round({_sql}, 4) AS value FROM n")(_run)


@query("WITH n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS f FROM embeddings) SELECT CAST(count(*) AS BIGINT) AS count, CAST(1 AS BIGINT) AS shapes, round(avg(f), 5) AS avg_norm, CAST(0 AS BIGINT) AS sparse_count, CAST(count(*) AS BIGINT) AS square_count FROM n")
def index_statistics(spark, sf):
    out = descriptor.index_statistics(described(spark, sf).withColumn("is_symmetric", F.lit(False)))
    return out.select("count", "shapes", F.round("avg_norm", 5).alias("avg_norm"), "sparse_count", "square_count")


@query(f"WITH {CELLS} SELECT x.pos AS a, y.pos AS b, round(covar_samp(x.v, y.v), 6) AS cov FROM c x JOIN c y USING (vec_id) WHERE x.pos <= y.pos GROUP BY ALL")
def cov_pairs(spark, sf):
    """All pairs of the 64 positions."""
    e = model.elements(model.vectors(spark, sf), "vec_id")
    return E.covariance(e, "pos", "vec_id").select("a", "b", F.round("cov", 6).alias("cov"))


@query(f"WITH {CELLS} SELECT x.pos AS a, y.pos AS b, round(corr(x.v, y.v), 6) AS corr FROM c x JOIN c y USING (vec_id) WHERE x.pos <= y.pos GROUP BY ALL")
def corr_pairs(spark, sf):
    """All pairs of the 64 positions."""
    e = model.elements(model.vectors(spark, sf), "vec_id")
    return E.covariance(e, "pos", "vec_id").select("a", "b", F.round("corr", 6).alias("corr"))


@query(f"WITH {CELLS}, k AS (SELECT * FROM (VALUES (0, 1.0), (1, -2.0), (2, 0.5)) t(m, w)) SELECT vec_id, pos + m - 2 AS pos, round(sum(v * w), 6) AS value FROM c, k WHERE pos + m BETWEEN 2 AND 63 GROUP BY ALL")
def conv1d_valid(spark, sf):
    e = model.elements(model.vectors(spark, sf), "vec_id")
    return E.convolve(e, [1.0, -2.0, 0.5], "vec_id", "pos", 64).select("vec_id", "pos", F.round("value", 6).alias("value"))


def _conv_sql(offsets: list[tuple[list[int], float]], shape: list[int], size: list[int], index: list[str]) -> str:
    """A sum over the kernel's elements; index: names of the output's positions from 0."""
    strides = [1] * len(shape)
    for k in range(len(shape) - 2, -1, -1):
        strides[k] = strides[k + 1] * shape[k + 1]
    terms = []
    for at, w in offsets:
        pos = " + ".join(f"({n} + {s - 1 - a}) * {t}" for n, a, s, t in zip(index, at, size, strides))
        terms.append(f"{w} * CAST(embedding[{pos} + 1] AS DOUBLE)")
    return " + ".join(terms)


_K2 = [([0, 0], 1.0), ([0, 1], -2.0), ([1, 0], 0.5), ([1, 1], 3.0)]
_K3 = [([0, 0, 0], 1.0), ([0, 1, 1], -1.5), ([1, 0, 1], 0.25), ([1, 1, 0], 2.0)]


@query(f"SELECT vec_id, i * 7 + j AS pos, round({_conv_sql(_K2, [8, 8], [2, 2], ['i', 'j'])}, 6) AS value FROM embeddings, (SELECT CAST(unnest(range(0, 7)) AS BIGINT) AS i) a, (SELECT CAST(unnest(range(0, 7)) AS BIGINT) AS j) b")
def conv2d_valid(spark, sf):
    kernel = linalg.array_of(_K2, [2, 2])
    out = linalg.array_udf(lambda a: linalg.convolve(a, kernel), "data", shapes=[[8, 8]])
    return cells(model.vectors(spark, sf).select("vec_id", out.alias("data")))


@query(f"SELECT vec_id, (i * 3 + j) * 3 + k AS pos, round({_conv_sql(_K3, [4, 4, 4], [2, 2, 2], ['i', 'j', 'k'])}, 6) AS value FROM embeddings, (SELECT CAST(unnest(range(0, 3)) AS BIGINT) AS i) a, (SELECT CAST(unnest(range(0, 3)) AS BIGINT) AS j) b, (SELECT CAST(unnest(range(0, 3)) AS BIGINT) AS k) c")
def conv3d_valid(spark, sf):
    kernel = linalg.array_of(_K3, [2, 2, 2])
    out = linalg.array_udf(lambda a: linalg.convolve(a, kernel), "data", shapes=[[4, 4, 4]])
    return cells(model.vectors(spark, sf).select("vec_id", out.alias("data")))


@query("SELECT vec_id, CAST(i AS BIGINT) - 1 AS pos, round(3 * CAST(embedding[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE) + exp(CAST(embedding[i] AS DOUBLE)) - 2, 6) AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u")
def gradient_exact(spark, sf):
    """The gradient of the sum of x^3 + exp(x) - 2 x, by dual numbers."""
    out = linalg.array_udf(lambda a: linalg.gradient(lambda x: (x**3 + dual.exp(x) - 2 * x).sum(), a), "data", shapes=[[64]])
    return cells(model.vectors(spark, sf).select("vec_id", out.alias("data")))


@query("SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, round(CASE WHEN j = i THEN CAST(embedding[k] AS DOUBLE) ELSE CAST(embedding[i] AS DOUBLE) END, 6) AS value, CAST(j - 1 AS BIGINT) AS wrt FROM embeddings, (SELECT unnest(range(1, 64)) AS i) u, LATERAL (SELECT unnest([i, i + 1]) AS j, unnest([i + 1, i]) AS k) w")
def jacobian_exact(spark, sf):
    """The Jacobian of the products of neighbouring elements: its entries other than 0."""
    out = linalg.array_udf(lambda a: linalg.jacobian(lambda x: x[:-1] * x[1:], a), "data", shapes=[[64]])
    rows = model.vectors(spark, sf).select("vec_id", F.posexplode(out).alias("at", "value"))
    rows = rows.select("vec_id", F.floor(F.col("at") / 64).cast("long").alias("pos"), (F.col("at") % 64).cast("long").alias("wrt"), "value")
    return rows.where("wrt = pos OR wrt = pos + 1").select("vec_id", "pos", "wrt", F.round("value", 6).alias("value"))


SPARSE = "s AS (SELECT l_orderkey AS i, CAST(l_linenumber AS BIGINT) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def sparse(spark, sf) -> DataFrame:
    return E.summed(model.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").cast("long").alias("j"), F.col("l_quantity").alias("value")), "i", "j")


@query(f"WITH {SPARSE} SELECT j, round(sum(v), 4) AS value FROM s GROUP BY j")
def sparse_lineitem_rowsum(spark, sf):
    return E.summed(sparse(spark, sf), "j").select("j", F.round("value", 4).alias("value"))


@query(f"WITH {SPARSE} SELECT x.j AS i, y.j, round(sum(x.v * y.v), 4) AS value FROM s x JOIN s y ON x.i = y.i GROUP BY ALL")
def sparse_matmul(spark, sf):
    """The transposed sparse matrix times itself."""
    s = sparse(spark, sf)
    return E.matmul(s.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"), s).select("i", "j", F.round("value", 4).alias("value"))


@query(f"WITH {SPARSE} SELECT i, j, round(v + coalesce(t.w, 0), 4) AS value FROM s LEFT JOIN (SELECT i AS ti, j AS tj, v AS w FROM s WHERE v > 50) t ON i = ti AND j = tj")
def sparse_add(spark, sf):
    s = sparse(spark, sf)
    return E.elementwise(s, s.where("value > 50"), ["i", "j"], "add").select("i", "j", F.round("value", 4).alias("value"))
