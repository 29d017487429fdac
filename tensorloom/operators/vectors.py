"""Vector indexes as tables: shards, partitions around centroids, a neighbour graph, a delta of fresh rows.

All of them hold (key, data) rows and answer the k nearest of stated queries. Shards and exact partitions are
searched whole and merged; inverted lists visit the lists whose centroids are closest; the graph is built and
searched inside bounded groups of rows, one task a group, and its edges are stored as Parquet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.functions import dense as D
from tensorloom.operators import linalg, prefix, search
from tensorloom.sources.cut import written

#: Rows of a shard and of a group of the graph, neighbours of a node, candidates of its building and searching, and slack of its pruning.
SHARD_ROWS, GROUP_ROWS = 100_000, 4_000
DEGREE, BEAM, ALPHA = 16, 64, 1.2
#: Rows that are linked, and queries that are walked, at once.
BLOCK = 256


def sized(vectors: DataFrame, dim: int | None, data: str = "data") -> DataFrame:
    """The rows of the dimension that the index is locked to; others are left out."""
    return vectors if dim is None else vectors.where(F.size(data) == dim)


def dimension(vectors: DataFrame, order: str, data: str = "data") -> int | None:
    """The dimension that the first vector inserted locks."""
    row = vectors.orderBy(order).select(F.size(data).alias("d")).first()
    return None if row is None else row.d


def assigned_shards(vectors: DataFrame, order: str, capacity: int = SHARD_ROWS, key: str = "vec_id") -> DataFrame:
    """Adds ``shard``: rows fill the first shard with room, in the order given."""
    return prefix.ranked(vectors, list(dict.fromkeys([order, key])), "_r").withColumn("shard", F.floor((F.col("_r") - 1) / capacity).cast("int")).drop("_r")


def shard_search(sharded: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", key: str = "vec_id", data: str = "data") -> DataFrame:
    """The k nearest of every shard, merged: the same as over all rows."""
    scored = sharded.where(F.size(data) == len(query)).withColumn("distance", D.metric_distance(data, search.literal(query), metric))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy("distance", key))
    best = scored.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
    return search.ranked(best, k, "distance", key, descending=False).withColumn("score", D.score_of(F.col("distance"), metric))


def shard_stats(sharded: DataFrame, capacity: int = SHARD_ROWS) -> DataFrame:
    """(shard, vectors, load) of each shard."""
    return sharded.groupBy("shard").agg(F.count("*").alias("vectors")).withColumn("load", F.col("vectors") / capacity)


# partitions


def nearest_centroid(data, centroids: list[list[float]]) -> Column:
    """The index of the closest centroid by Euclidean distance, the smallest of equals; null for another dimension."""
    d = F.col(data) if isinstance(data, str) else data
    distances = F.array(*[D.distance2(d, search.literal(c)) for c in centroids])
    return F.when(F.size(d) == len(centroids[0]), D.bound(distances, lambda own: (F.array_position(own, F.array_min(own)) - 1).cast("int")))


def _fits(data: str, dim: int) -> Column:
    return (F.size(data) == dim) & ~F.exists(data, F.isnull)


class Partitions:
    """Inverted lists around given centroids, or ones that k-means finds; stored by list, so that a probe reads its lists alone."""

    def __init__(self, vectors: DataFrame, centroids: list[list[float]] | None = None, lists: int = 16, seed: int = 42, key: str = "vec_id", data: str = "data"):
        self.key, self.data = key, data
        if centroids is None:
            from pyspark.ml.clustering import KMeans
            from pyspark.ml.functions import array_to_vector

            model = KMeans(k=lists, seed=seed, featuresCol="_v", predictionCol="cluster").fit(vectors.select(array_to_vector(F.col(data).cast("array<double>")).alias("_v")))
            centroids = [[float(x) for x in c] for c in model.clusterCenters()]
        self.centroids = centroids
        self.stored = False
        # the size, not the list, decides, so that the distances are computed once a row
        self.rows = vectors.where(_fits(data, len(centroids[0]))).withColumn("list", nearest_centroid(data, centroids))

    def saved(self, path: str) -> Partitions:
        """The rows written by list under a shared folder; searches then prune folders."""
        self.rows.repartition("list", F.pmod(F.xxhash64(self.key), F.lit(4))).write.partitionBy("list").parquet(path)
        out = object.__new__(Partitions)
        out.__dict__.update(self.__dict__)
        out.rows, out.stored = self.rows.sparkSession.read.parquet(path), True
        return out

    def statistics(self) -> DataFrame:
        return self.rows.groupBy("list").agg(F.count("*").alias("vectors"))

    def probes(self, query, n: int) -> Column:
        """The n lists whose centroids are closest to a query vector (an array column or list)."""
        q = search.literal(query) if isinstance(query, list) else query
        each = F.array(*[F.struct(D.distance2(q, search.literal(c)).alias("d"), F.lit(i).alias("list")) for i, c in enumerate(self.centroids)])
        return F.transform(F.slice(F.array_sort(each), 1, n), lambda s: s["list"])

    def search(self, query: list[float], k: int = 10, metric: str = "cosine", probes: int = 4) -> DataFrame:
        c = np.asarray(self.centroids)
        order = np.lexsort((np.arange(len(c)), ((c - np.asarray(query)) ** 2).sum(1)))[:probes]
        return search.nearest(self.rows.where(F.col("list").isin([int(i) for i in order])), query, k, metric, tie=self.key, data=self.data)

    def knn_join(self, queries: DataFrame, k: int = 10, metric: str = "cosine", probes: int = 4) -> DataFrame:
        """(query_id, key, score, rank) of the k nearest in each query's closest lists, itself excluded; queries of another dimension find nothing.

        Blocks of a list's queries and groups of its rows meet in tasks of bounded size, as many as the list needs, and
        each task keeps k rows for a query.
        """
        q = queries.where(_fits(self.data, len(self.centroids[0])))
        q = q.select(F.col(self.key).alias("query_id"), F.col(self.data).alias("_q"), F.explode(self.probes(F.col(self.data), probes)).alias("list"))
        rows = self.rows.select(self.key, F.col(self.data).alias("_x"), "list")
        rows = rows if self.stored else written(rows, "lists")
        parts = [F.ceil(F.count("*") / n).cast("int").alias(c) for c, n in (("_blocks", search.MEETING * search.QUERY_BLOCK), ("_groups", search.GROUP_ROWS))]
        # as many rows as there are lists
        parts = F.broadcast(q.groupBy("list").agg(parts[0]).join(rows.groupBy("list").agg(parts[1]), "list"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = q.join(parts, "list").select("query_id", "_q", "list", F.pmod(F.xxhash64("query_id"), "_blocks").cast("int").alias("_b"), every("_groups").alias("_g"))
        rows = rows.join(parts, "list").select(self.key, "_x", "list", every("_blocks").alias("_b"), F.pmod(F.xxhash64(self.key, F.lit(1)), "_groups").cast("int").alias("_g"))
        return search.best_of_each(search.met(q, rows, ["list", "_b", "_g"], k, metric, self.key), k, self.key)


# a neighbour graph


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return ((x - q) ** 2).sum(-1)
    product = x @ q
    if metric == "unit":
        return 1 - product
    return -product if metric == "dot" else 1 - product / np.maximum(np.linalg.norm(x, axis=-1) * np.linalg.norm(q), 1e-300)


def _unit(x: np.ndarray, metric: str) -> tuple[np.ndarray, str]:
    """For cosine, rows of length 1 (or 0), whose distance is one product."""
    return (x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-150), "unit") if metric == "cosine" else (x, metric)


def _all_distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    product = q @ x.T
    return (q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * product if metric == "l2" else -product if metric == "dot" else 1 - product


def beam(x: np.ndarray, edges: list[np.ndarray], start: int, q: np.ndarray, width: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search from a start node: the ``width`` closest nodes met and their distances."""
    seen = {start}
    pool, far = np.array([start]), _distances(x[[start]], q, metric)
    open_ = {start}
    while open_:
        at = next(int(i) for i in pool if int(i) in open_)
        open_.discard(at)
        new = np.array([int(n) for n in edges[at] if int(n) not in seen], int)
        if len(new):
            seen.update(new.tolist())
            open_.update(new.tolist())
            pool, far = np.append(pool, new), np.append(far, _distances(x[new], q, metric))
            order = np.lexsort((pool, far))[:width]
            pool, far = pool[order], far[order]
        open_ &= set(pool.tolist())
    return pool, far


def pruned(x: np.ndarray, node: int, candidates: np.ndarray, far: np.ndarray, degree: int, alpha: float, metric: str) -> np.ndarray:
    """The closest candidates, without those that a kept one is closer to by the factor alpha."""
    order = np.lexsort((candidates, far))
    candidates, far = candidates[order], far[order]
    keep = candidates != node
    candidates, far = candidates[keep], far[keep]
    out: list[int] = []
    alive = np.ones(len(candidates), bool)
    for i in range(len(candidates)):
        if not alive[i]:
            continue
        out.append(int(candidates[i]))
        if len(out) == degree:
            break
        # metrics other than l2 may be negative; shifted, they compare as lengths do
        between = _distances(x[candidates], x[candidates[i]], metric)
        low = min(0.0, float(between.min()), float(far.min()))
        alive &= alpha * (between - low) > far - low
    return np.array(out, int)


def graph_of(x: np.ndarray, degree: int = DEGREE, width: int = BEAM, alpha: float = ALPHA, metric: str = "cosine", seed: int = 0) -> tuple[list[np.ndarray], int]:
    """Neighbours of each row and the start node (the one closest to the mean).

    Rows come in in a random order: each is linked with some of the ``width`` closest of those before it, and these
    with it. The closest are found by products of matrices, for a block of rows at once.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    start = int(np.argmin(_distances(x, x.mean(0), "l2")))
    x, metric = _unit(x, metric)
    order = rng.permutation(n)
    order = np.append(start, order[order != start])
    edges: list[np.ndarray] = [np.zeros(0, int) for _ in range(n)]
    back: list[list[int]] = [[] for _ in range(n)]
    for low in range(1, n, BLOCK):
        high = min(low + BLOCK, n)
        far = _all_distances(x[order[low:high]], x[order[:high]], metric)
        far[np.arange(high) >= np.arange(low, high)[:, None]] = np.inf
        near = np.argpartition(far, width - 1, axis=1)[:, :width] if high > width else np.broadcast_to(np.arange(high), far.shape)
        for row, own in enumerate(near):
            node, own = int(order[low + row]), own[np.isfinite(far[row, own])]
            edges[node] = pruned(x, node, order[own], far[row, own], degree, alpha, metric)
            for other in edges[node].tolist():
                back[other].append(node)
    for node in range(n):
        own = np.append(edges[node], np.array(back[node], int))
        edges[node] = own if len(own) <= degree else pruned(x, node, own, _distances(x[own], x[node], metric), degree, alpha, metric)
    return edges, start


def beams(x: np.ndarray, edges: list, start: int, q: np.ndarray, width: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """``beam`` for each row of q, all a step at a time: nodes and distances, filled up with len(x) and infinity."""
    n, (q, metric), x = len(x), _unit(q, metric), _unit(x, metric)[0]
    table = np.full((n + 1, max(1, max(len(e) for e in edges))), n)
    for node, own in enumerate(edges):
        table[node, : len(own)] = own
    x = np.vstack([x, np.zeros((1, x.shape[1]))])
    pool, far, open_ = np.full((len(q), width), n), np.full((len(q), width), np.inf), np.zeros((len(q), width), bool)
    pool[:, 0], far[:, 0], open_[:, 0] = start, _distances(q, x[start], metric), True
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, [start, n]] = True
    active = np.arange(len(q))
    while len(active):
        first = open_[active].argmax(1)
        left = open_[active, first]
        active, first = active[left], first[left]
        open_[active, first] = False
        new = table[pool[active, first]]
        fresh = ~seen[active[:, None], new]
        seen[active[:, None], new] = True
        some = fresh.any(1)
        own, new, fresh = active[some], new[some], fresh[some]
        d = _distances(x[new], q[own][:, None], metric) if metric == "l2" else np.matmul(x[new], q[own][:, :, None])[:, :, 0]
        d = d if metric == "l2" else -d if metric == "dot" else 1 - d
        nodes, d = np.hstack([pool[own], np.where(fresh, new, n)]), np.hstack([far[own], np.where(fresh, d, np.inf)])
        order = np.lexsort((nodes, d), axis=1)[:, :width]
        pool[own], far[own] = np.take_along_axis(nodes, order, 1), np.take_along_axis(d, order, 1)
        open_[own] = np.take_along_axis(np.hstack([open_[own], fresh]), order, 1)
    return pool, far


def _groups_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one group after the other, from batches in order of the group."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for name, rows in batch.groupby("grp", sort=False):
            if held and held[0]["grp"].iloc[0] != name:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(rows)
    if held:
        yield pd.concat(held, ignore_index=True)


class Graph:
    """A neighbour graph over groups of at most about ``group_rows`` rows, stored as (group, key, data, neighbours, start).

    Inserted rows form groups of their own, so nothing that is written changes; removed rows stay as way points and
    are taken out of the answers. ``rebuilt`` writes the live rows anew.
    """

    SCHEMA = "grp string, {key} {kind}, data array<double>, neighbours array<int>, at int, start int"

    def __init__(self, spark: SparkSession, folder: str, key: str = "vec_id", kind: str = "bigint", metric: str = "cosine", group_rows: int = GROUP_ROWS):
        self.spark, self.folder, self.key, self.kind, self.metric, self.group_rows = spark, folder.rstrip("/"), key, kind, metric, group_rows
        self.schema = self.SCHEMA.format(key=f"`{key}`", kind=kind)

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def insert(self, vectors: DataFrame, batch: str = "0") -> None:
        """Builds the groups of the rows, one task a group. Each batch needs a name of its own."""
        n = vectors.count()
        groups = max(1, -(-n // self.group_rows))
        key, metric = self.key, self.metric
        dealt = vectors.select(key, F.col("data").cast("array<double>").alias("data")).withColumn("grp", F.concat(F.lit(f"{batch}-"), F.pmod(F.xxhash64(key), F.lit(groups)).cast("string")))

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(key, ignore_index=True)
            edges, start = graph_of(np.stack(rows["data"].to_numpy()), metric=metric)
            return rows.assign(neighbours=[e.tolist() for e in edges], at=np.arange(len(rows), dtype=np.int32), start=np.int32(start))[["grp", key, "data", "neighbours", "at", "start"]]

        dealt.groupBy("grp").applyInPandas(build, self.schema).write.mode("append").partitionBy("grp").parquet(f"{self.folder}/graph")

    def remove(self, keys: DataFrame) -> None:
        keys.select(self.key).write.mode("append").parquet(f"{self.folder}/gone")

    def rows(self) -> DataFrame:
        """The live rows."""
        out = self.spark.read.schema(self.schema).parquet(f"{self.folder}/graph").select(self.key, "data")
        return out.join(self.spark.read.parquet(f"{self.folder}/gone"), self.key, "left_anti") if self._exists("gone") else out

    def search(self, queries: DataFrame, k: int = 10, width: int = BEAM) -> DataFrame:
        """(query_id, key, distance, rank) of about the k nearest live rows of each query (query_id, data), a bounded stated set.

        Every group finds its ``width`` closest; of these, a task keeps the k best that aren't removed, over all its groups.
        """
        found = queries.select("query_id", F.col("data").cast("array<double>")).toPandas()
        key, metric = self.key, self.metric
        sizes = found["data"].map(len).to_numpy() if len(found) else np.zeros(0, int)
        asked = {int(d): (np.flatnonzero(sizes == d), np.stack(found["data"][sizes == d].to_numpy()).astype(float)) for d in np.unique(sizes)}
        ids = found["query_id"].to_numpy()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best, names = {d: np.full((len(q), k), np.inf) for d, (_, q) in asked.items()}, {}
            for rows in _groups_of(batches):
                x, edges, own = np.stack(rows["data"].to_numpy()), rows["neighbours"].tolist(), np.append(rows[key].to_numpy(), rows[key].iloc[0])
                d, dead = x.shape[1], np.append(rows["_gone"].to_numpy(bool), True)
                if d not in asked:
                    continue
                q = asked[d][1]
                kept = names.setdefault(d, np.full((len(q), k), own[0]))
                for low in range(0, len(q), BLOCK):
                    near, far = beams(x, edges, int(rows["start"].iloc[0]), q[low : low + BLOCK], width, metric)
                    part = slice(low, low + BLOCK)
                    every, who = np.hstack([best[d][part], np.where(dead[near], np.inf, far)]), np.hstack([kept[part], own[near]])
                    order = np.lexsort((who, every), axis=1)[:, :k]
                    best[d][part], kept[part] = np.take_along_axis(every, order, 1), np.take_along_axis(who, order, 1)
            for d, kept in names.items():
                ok = np.isfinite(best[d])
                yield pd.DataFrame({"query_id": np.repeat(ids[asked[d][0]], ok.sum(1)), key: kept[ok], "distance": best[d][ok]})

        graph = self.spark.read.schema(self.schema).parquet(f"{self.folder}/graph")
        if self._exists("gone"):
            gone = self.spark.read.parquet(f"{self.folder}/gone").distinct().withColumn("_gone", F.lit(True))
            graph = graph.join(gone, key, "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
        else:
            graph = graph.withColumn("_gone", F.lit(False))
        hits = graph.repartition("grp").sortWithinPartitions("grp", "at").mapInPandas(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{key}` {self.kind}, distance double")
        order = Window.partitionBy("query_id").orderBy("distance", key)
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def rebuilt(self, folder: str) -> Graph:
        out = Graph(self.spark, folder, self.key, self.kind, self.metric, self.group_rows)
        out.insert(self.rows())
        return out


# sketches of tensors


def _unpacked(flat: np.ndarray, shape: list[int], rank: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Core and factors of a stored sketch."""
    ranks = [max(1, min(rank, d, int(np.prod(shape)) // d)) for d in shape]
    sizes = [int(np.prod(ranks)), *[d * r for d, r in zip(shape, ranks)]]
    pieces = np.split(flat, np.cumsum(sizes)[:-1])
    return pieces[0].reshape(ranks), [p.reshape(d, r) for p, d, r in zip(pieces[1:], shape, ranks)]


class Sketches:
    """Stored sketches (core and leading singular vectors of each mode) of tensors of one shape, which the first insert locks."""

    def __init__(self, spark: SparkSession, folder: str, rank: int = 4, key: str = "tensor_id", kind: str = "bigint"):
        self.spark, self.folder, self.rank, self.key, self.kind = spark, folder.rstrip("/"), rank, key, kind
        self.shape: list[int] | None = None

    def insert(self, tensors: DataFrame, shape: list[int]) -> None:
        """Adds (key, data) rows of the shape; another shape than the first one is an error."""
        if self.shape is not None and self.shape != shape:
            raise ValueError(f"the index holds tensors of shape {self.shape}, not {shape}")
        self.shape = shape
        rank = self.rank

        def kernel(a: np.ndarray) -> np.ndarray:
            core, factors = linalg.sketch(a, rank)
            return np.concatenate([core.ravel(), *[f.ravel() for f in factors]])

        size = 1
        for d in shape:
            size *= d
        fit = tensors.where(F.size("data") == size)
        fit.select(self.key, linalg.array_udf(kernel, "data", shapes=[shape]).alias("sketch")).write.mode("append").parquet(f"{self.folder}/sketches")

    def search(self, query: np.ndarray, k: int = 10) -> DataFrame:
        """(key, score, rank) of the most similar tensors, from their sketches alone."""
        if self.shape is None or list(np.shape(query)) != self.shape:
            raise ValueError(f"the index holds tensors of shape {self.shape}")
        own, shape, rank = linalg.sketch(np.asarray(query, float), self.rank), self.shape, self.rank

        @F.pandas_udf("double")
        def score(column: pd.Series) -> pd.Series:
            return column.map(lambda v: linalg.sketch_similarity(_unpacked(np.asarray(v), shape, rank), own))

        rows = self.spark.read.parquet(f"{self.folder}/sketches").withColumn("score", score("sketch"))
        return search.ranked(rows.select(self.key, "score"), k, tie=self.key)


# statistics


def vector_stats(base: DataFrame, fresh: DataFrame | None = None, data: str = "data") -> DataFrame:
    """(vectors, fresh, dimension, megabytes) of an index and its delta, at four bytes an element."""
    rows = base.select(F.size(data).alias("d"), F.lit(0).alias("f"))
    if fresh is not None:
        rows = rows.unionByName(fresh.select(F.size(data).alias("d"), F.lit(1).alias("f")))
    size = F.coalesce(F.sum(F.col("d").cast("double")), F.lit(0.0)) * 4 / (1 << 20)
    return rows.agg(F.count("*").alias("vectors"), F.coalesce(F.sum("f"), F.lit(0)).alias("fresh"), F.max("d").alias("dimension"), size.alias("megabytes"))


def fresh_search(fresh: DataFrame, query: list[float], k: int, where: Column | None = None, metric: str = "cosine", key: str = "vec_id") -> DataFrame:
    """The 2 k nearest rows of the delta, filters first: what a merge with the base's nearest needs at most, with some to spare."""
    return search.nearest(fresh, query, 2 * k, metric, where, tie=key)


def candidates(semantic: DataFrame | None, every: DataFrame, offset: int = 0, limit: int | None = None, key: str = "tensor_id") -> DataFrame:
    """Keys by descending semantic score, or all of them in order if there are no scores; then offset and limit."""
    if semantic is None or semantic.isEmpty():
        out = every.select(key).orderBy(key)
    else:
        out = semantic.orderBy(F.desc("score"), key).select(key)
    out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def batched(rows: DataFrame, function, schema: str) -> DataFrame:
    """A vectorised function over Arrow batches of a table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return rows.mapInPandas(run, schema)
