"""Similarity and vector search: exact scans with a bounded top-k, an IVF index, hybrid ranking, text search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

from tensorloom.functions import dense as D
from tensorloom.operators import linalg

#: Queries of a block, and rows of a group that MEETING blocks meet in one task where there are several; scores held at once.
QUERY_BLOCK, GROUP_ROWS, MEETING, SCORES = 1024, 20_000, 16, 1 << 20


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def ranked(scored: DataFrame, k: int, score: str = "score", tie: str = "tensor_id", descending: bool = True) -> DataFrame:
    """The best k rows with rank 1..k: a top-k in every task, merged once."""
    order = [F.desc(score) if descending else F.asc(score), F.asc(tie)]
    top = scored.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))  # over k rows


def find_similar(tensors: DataFrame, query: list[float], metric: str = "cosine", k: int = 10, tie: str = "tensor_id", data: str = "data") -> DataFrame:
    q = literal(query)
    if metric == "spectral":
        score = linalg.scalar_udf(lambda a: linalg.spectral_similarity(a, np.asarray(query, float)), data, shapes=[[-1]])
    else:
        score = {"cosine": D.cosine_similarity, "frobenius": D.frobenius_similarity, "relative": D.relative_similarity}[metric](data, q)
    return ranked(tensors.withColumn("score", score), k, tie=tie)


def nearest(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", where: Column | None = None, least_score: float | None = None, tie: str = "vec_id", data: str = "data") -> DataFrame:
    """Exact nearest neighbours; filters come before the top k, a threshold on the score after it."""
    found = vectors if where is None else vectors.where(where)
    sized = found.where(F.size(data) == len(query))
    out = ranked(sized.withColumn("distance", D.metric_distance(data, literal(query), metric)), k, "distance", tie, descending=False)
    out = out.withColumn("score", D.score_of(F.col("distance"), metric))
    return out if least_score is None else out.where(F.col("score") >= least_score)


def matches_filter(metadata: str, **wanted: str) -> Column:
    """Equality with metadata entries; a key that a row lacks doesn't reject it."""
    out = F.lit(True)
    for key, value in wanted.items():
        out &= F.coalesce(F.try_element_at(F.col(metadata), F.lit(key)) == value, F.lit(True))
    return out


def _matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as the rows of a matrix."""
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = own.value_lengths()
    if own.null_count or len(lengths.unique()) > 1:
        raise ValueError("the vectors differ in size")
    return own.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(own), lengths[0].as_py() if len(own) else 0)


def _names(column) -> np.ndarray:
    return column.to_numpy() if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist())


def _near(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """How near each row of q is to the same row of x, more being nearer. A pair has one value wherever its rows stand, so that copies tie."""
    if metric == "l2":
        return -((q - x) ** 2).sum(1)
    product = (q * x).sum(1)
    if metric == "dot":
        return product
    a, b = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    return np.where((a < 1e-10) | (b < 1e-10), 0.0, product / np.maximum(a * b, 1e-300))


class _Best:
    """The k nearest rows of each query of a block, equal ones by id; a query doesn't find itself.

    A product of matrices leaves out the rows that are surely farther than k others; the rest are compared pair by
    pair. Rows are met in pieces, so that at most about SCORES values are held at once.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str):
        self.ids, self.q, self.k, self.metric = ids, q, k, metric
        self.size = np.sqrt((q * q).sum(1))
        self.at, self.names, self.near = np.zeros(0, int), None, np.zeros(0)
        self.least = np.full(len(ids), -np.inf)

    def add(self, names: np.ndarray, x: np.ndarray) -> None:
        step = max(1, SCORES // max(1, len(self.ids)))
        for part in range(0, len(x) if len(self.ids) else 0, step):
            self._add(names[part : part + step], x[part : part + step])

    def _add(self, names: np.ndarray, x: np.ndarray) -> None:
        size, near = np.sqrt((x * x).sum(1)), self.q @ x.T
        if self.metric == "cosine":
            for s, axis in ((self.size, 1), (size, 0)):
                near *= np.expand_dims(np.where(s < 1e-10, 0.0, 1 / np.maximum(s, 1e-10)), axis)
            slack = 1e-9
        elif self.metric == "l2":
            near *= 2
            near -= self.size[:, None] ** 2
            near -= size**2
            slack = 1e-10 * (self.size.max() ** 2 + size.max() ** 2)
        else:
            slack = 1e-10 * self.size.max() * size.max()
        if not np.isfinite(near.sum()):
            near[~np.isfinite(near)], slack = -np.inf, np.nan_to_num(slack)
        near[self.ids[:, None] == names] = -np.inf
        hits = near >= (self.least - slack)[:, None]
        if near.shape[1] > self.k and np.count_nonzero(hits) > 4 * self.k * len(self.ids):
            hits &= near >= (np.partition(near, -self.k, axis=1)[:, -self.k] - slack)[:, None]
        i, j = np.nonzero(hits)
        exact = np.concatenate([np.zeros(0), *[_near(self.q[i[n : n + 16384]], x[j[n : n + 16384]], self.metric) for n in range(0, len(i), 16384)]])
        ok = np.isfinite(exact) & np.isfinite(near[i, j])
        at, near = np.append(self.at, i[ok]), np.append(self.near, exact[ok])
        names = names[j[ok]] if self.names is None else np.append(self.names, names[j[ok]])
        order = np.lexsort((names, -near, at))
        rank = np.arange(len(at)) - np.searchsorted(at[order], np.arange(len(self.ids)))[at[order]]
        keep = order[rank < self.k]
        self.at, self.names, self.near = at[keep], names[keep], near[keep]
        last = order[rank == self.k - 1]
        self.least[at[last]] = near[last]

    def table(self, schema: pa.Schema) -> pa.Table:
        names = [] if self.names is None else self.names
        score = 1 / (1 - self.near) if self.metric == "l2" else self.near
        return pa.table([pa.array(c, t) for c, t in zip((self.ids[self.at], names, score), schema.types)], schema=schema)


def _answer(queries: DataFrame, corpus: DataFrame, query_id: str, key: str) -> tuple[StructType, pa.Schema]:
    schema = StructType().add("query_id", queries.schema[query_id].dataType).add(key, corpus.schema[key].dataType).add("score", DoubleType())
    return schema, to_arrow_schema(schema)


def met(queries: DataFrame, rows: DataFrame, by: list[str], k: int, metric: str, key: str) -> DataFrame:
    """(query_id, key, score) of the k nearest rows (key, _x) of each query (query_id, _q) in its group; one task a group, which is to be bounded."""
    schema, arrow = _answer(queries, rows, "query_id", key)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            ids, q, names, x = _names(left["query_id"]), _matrix(left["_q"]), _names(right[key]), _matrix(right["_x"])
            for part in range(0, len(ids), QUERY_BLOCK):
                best = _Best(ids[part : part + QUERY_BLOCK], q[part : part + QUERY_BLOCK], k, metric)
                best.add(names, x)
                out.append(best.table(arrow))
        return pa.concat_tables([arrow.empty_table(), *out])

    return queries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(meet, schema)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", data: str = "data") -> DataFrame:
    """(query id, id, score, rank) of the k nearest of each query, itself excluded; ``queries`` is a stated query set.

    A block of at most QUERY_BLOCK queries (which bounds its bytes) goes to all tasks of one scan. More queries are
    dealt to blocks of MEETING times as many, and each block meets each group of some GROUP_ROWS rows in a task of
    its own, without the driver. Each task keeps k rows for a query, so only those are shuffled on.
    """
    n = queries.count()
    if n <= QUERY_BLOCK:
        schema, arrow = _answer(queries, corpus, key, key)
        held = queries.select(key, data).toArrow()
        ids, q = _names(held[key]), _matrix(held[data])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(ids, q, k, metric)
            for batch in batches:
                if len(ids):
                    best.add(_names(batch[key]), _matrix(batch[data]))
            yield from best.table(arrow).to_batches()

        out = corpus.select(key, data).mapInArrow(run, schema)
    else:
        blocks, groups = -(-n // (MEETING * QUERY_BLOCK)), max(1, -(-corpus.count() // GROUP_ROWS))
        asked = queries.select(F.col(key).alias("query_id"), F.col(data).alias("_q"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"))
        rows = corpus.select(key, F.col(data).alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(groups)).cast("int").alias("_g"))
        out = met(asked, rows, ["_b", "_g"], k, metric, key)
    return best_of_each(out, k, key)


def best_of_each(found: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """The k rows of each query with the best scores, equal ones by id, and their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# contraction similarity


def contraction_search(tensors: DataFrame, query: list[float], shape: list[int], k: int = 10, rank: int = 4, tie: str = "tensor_id", data: str = "data") -> DataFrame:
    q = np.asarray(query, float).reshape(shape)
    score = linalg.scalar_udf(lambda a: linalg.contraction_similarity(a, q, rank), data, shapes=[shape])
    return ranked(tensors.where(F.size(data) == q.size).withColumn("score", score), k, tie=tie)


# hybrid


def shape_similarity(shape, wanted: list[int]) -> Column:
    """Mean over the dimensions of the smaller by the larger size; 0 where the numbers of dimensions differ."""
    s = F.col(shape) if isinstance(shape, str) else shape
    want = F.array(*[F.lit(d).cast("bigint") for d in wanted])
    each = F.zip_with(s, want, lambda a, b: F.try_divide(F.least(a, b), F.greatest(a, b)))
    return F.when(F.size(s) == len(wanted), F.try_divide(D.total(each), F.size(s))).otherwise(F.lit(0.0))


def operation_score(operation: str, ndim) -> Column:
    """How well a tensor of ``ndim`` dimensions suits an operation, by the first rule that fits its name."""
    n = F.col(ndim) if isinstance(ndim, str) else ndim
    name = operation.lower()
    rules = [(("svd",), n == 2, 0.8), (("cp", "tucker", "tt"), n >= 3, 0.9), (("eigenvalue", "qr", "cholesky"), n == 2, 0.8), (("conv",), n >= 3, 0.7), (("add", "multiply", "normalize"), F.lit(True), 0.5)]
    out = F.lit(0.1)
    for words, fits, score in reversed(rules):
        if any(w in name for w in words):
            out = F.when(fits, F.lit(score)).otherwise(out)
    return out


def property_score(shape=None, sparsity: float | None = None, rank: int | None = None, norm: tuple[float, float] | None = None) -> Column:
    out = F.lit(0.0)
    if shape is not None:
        out += 0.3 * shape_similarity("shape", shape)
    if sparsity is not None:
        out += 0.2 * (1 - F.abs(F.col("sparsity") - sparsity))
    if rank is not None:
        out += F.coalesce(0.2 * (1 - F.try_divide(F.abs(F.col("rank") - rank), F.array_max("shape"))), F.lit(0.0))
    if norm is not None:
        out += F.when(F.col("frobenius_norm").between(*norm), 0.3).otherwise(0.0)
    return F.least(out, F.lit(1.0))


def hybrid(semantic: DataFrame, computational: DataFrame, weights: tuple[float, float] = (0.7, 0.3), k: int = 10, offset: int = 0, key: str = "tensor_id") -> DataFrame:
    """Weighted sum of (key, semantic) and (key, computational); a missing score is 0, rows with neither go; rank counts from the first row of all."""
    if abs(sum(weights) - 1) > 1e-9:
        raise ValueError("the weights must sum to 1")
    s, c = F.coalesce("semantic", F.lit(0.0)), F.coalesce("computational", F.lit(0.0))
    both = semantic.join(computational, key, "full_outer").select(key, s.alias("semantic"), c.alias("computational")).where("semantic <> 0 OR computational <> 0")
    scored = both.withColumn("hybrid", weights[0] * F.col("semantic") + weights[1] * F.col("computational"))
    return ranked(scored, k + offset, "hybrid", key).where(F.col("rank") > offset)


# text


def tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_tokens(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))


def full_text(documents: DataFrame, query: str, text: str = "text", key: str = "doc_id", k: int = 0) -> DataFrame:
    """(key, score): for each distinct query token that a row has, 1 plus a hundredth of how often it has it; the best k, or all in no order.

    A text is split into tokens once, and only if it holds one of the query's as a substring.
    """
    wanted = query_tokens(query)
    low = F.lower(text)
    some = F.lit(False)
    for t in wanted:
        some |= F.contains(low, F.lit(t))

    def counted(own: Column) -> Column:
        score = F.lit(0.0)
        for t in wanted:
            n = F.size(F.array_remove(own, t))
            score += F.when(n < F.size(own), 1.0 + 0.01 * (F.size(own) - n)).otherwise(0.0)
        return score

    out = documents.where(some).select(key, D.bound(F.split(low, r"[^\p{L}\p{N}]+"), counted).alias("score")).where("score > 0")
    return out.orderBy(F.desc("score"), key).limit(k) if k else out


def postings(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(token, key, n), to be written sorted by token: a search then reads the row groups of its tokens."""
    return counted_tokens(documents, text, key).repartitionByRange("token", key).sortWithinPartitions("token", key)


def counted_tokens(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(token, key, n) in no order."""
    return documents.select(key, F.explode(tokens(text)).alias("token")).groupBy("token", key).agg(F.count("*").alias("n"))


def posting_search(table: DataFrame, query: str, key: str = "doc_id", k: int = 0) -> DataFrame:
    """``full_text`` over a table of postings."""
    found = table.where(F.col("token").isin(query_tokens(query))).groupBy(key).agg(F.sum(1.0 + 0.01 * F.col("n")).alias("score"))
    return found.orderBy(F.desc("score"), key).limit(k) if k else found


def facets(documents: DataFrame, field: str) -> DataFrame:
    return documents.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count("*").alias("n"))


def hashed_embedding(text: str, size: int = 64) -> Column:
    """An offline stand-in for a text encoder: counts of token hashes (the first 32 bits of their MD5), normalised."""
    codes = F.transform(tokens(text), lambda t: F.pmod(F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int"))

    def counts(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(own, lambda c: c == i)).cast("double"))

    def normalised(raw: Column) -> Column:
        return D.bound(D.frobenius_norm(raw), lambda n: F.transform(raw, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))

    return D.bound(D.bound(codes, counts), normalised)
