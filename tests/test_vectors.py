import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom import model
from tensorloom.operators import embeddings, lineage, prefix, search, vectors
from tensorloom.plans import tenancy
from tensorloom.queries import engine, tables

RNG = np.random.default_rng(5)


def clustered(n, d=16, centres=12):
    c = RNG.standard_normal((centres, d)) * 2
    return c[RNG.integers(centres, size=n)] + RNG.standard_normal((n, d)) * 0.6


def exact(x, q, k, metric, alive):
    far = vectors._distances(x, q, metric)
    return [i for i in np.lexsort((np.arange(len(x)), far)) if i in alive][:k]


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_graph_recall_against_brute_force(spark, tmp_path, metric):
    x = clustered(900)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, data array<double>")
    graph = vectors.Graph(spark, f"file://{tmp_path}/g", metric=metric, group_rows=250)
    graph.insert(df.where("vec_id < 700"), "first")
    graph.insert(df.where("vec_id >= 700"), "second")
    graph.remove(df.where("vec_id % 10 = 1"))
    alive = {i for i in range(900) if i % 10 != 1}
    queries = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = {}
    for r in vectors.Graph(spark, f"file://{tmp_path}/g", metric=metric).search(queries, 10).collect():  # read from what is stored
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = sum(len(set(found[i]) & set(exact(x, x[i], 10, metric, alive))) for i in found)
    assert len(found) == 45 and all(set(v) <= alive and len(v) == 10 for v in found.values())
    assert hits >= 0.9 * 450
    assert graph.rebuilt(f"file://{tmp_path}/again").rows().count() == len(alive)


def test_graph_of_one_and_equal_points():
    assert [len(e) for e in vectors.graph_of(np.ones((1, 3)))[0]] == [0]
    edges, start = vectors.graph_of(np.ones((50, 3)), degree=4, metric="l2")
    pool, far = vectors.beam(np.ones((50, 3)), edges, start, np.ones(3), 10, "l2")
    assert np.allclose(far, 0) and max(len(e) for e in edges) <= 4


def test_registered_graph_recall(spark, sf):
    v = {r.vec_id: np.array(r.data) for r in model.vectors(spark, sf).collect()}
    ids = np.array(sorted(v))
    x = np.stack([v[i] for i in ids])
    alive = {k for k, i in enumerate(ids) if i % 11}
    found = {}
    for r in engine.graph_knn(spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(found[q] & {int(ids[k]) for k in exact(x, v[q], 10, "cosine", alive)}) for q in found)
    assert hits >= 0.9 * 10 * len(found) and set(found) == {int(i) for i in ids if i % 20 == 0}


def test_registered_lists_recall(spark, sf):
    from tensorloom.queries import search as searching

    sf = sf.replace("sf0.001", "sf0.01")
    v = model.vectors(spark, sf)
    want, got = {}, {}
    for r in search.knn_join(v.where("vec_id % 20 = 0"), v, 10).collect():
        want.setdefault(r.query_id, set()).add(r.vec_id)
    for r in searching.ivf_search(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(want) and sum(len(got[q] & want[q]) for q in want) >= 0.9 * 10 * len(want)


def test_partitions_recall_and_folders(spark, tmp_path):
    x = clustered(800)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, [1.0])], "vec_id bigint, data array<double>")
    index = vectors.Partitions(df.where("vec_id < 9000"), lists=12).saved(f"file://{tmp_path}/lists")
    assert index.statistics().agg(F.sum("vectors")).first()[0] == 800
    found = {}
    for r in index.knn_join(df.where("vec_id % 20 = 0 AND vec_id < 9000"), 5, "l2", 3).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(found[i] & set(exact(x, x[i], 5, "l2", set(range(800)) - {i}))) for i in found)
    assert hits >= 0.9 * 5 * len(found)
    plan = index.search(x[0].tolist(), 5, "l2", 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan
    assert vectors.Partitions(df, [x[0].tolist(), x[1].tolist()]).rows.count() == 800  # the dimension is locked


def test_shards_fill_in_order(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(95)], "vec_id bigint, data array<double>").repartition(7)
    out = {r.vec_id: r.shard for r in vectors.assigned_shards(df, "vec_id", 20).collect()}
    assert out == {i: i // 20 for i in range(95)}
    stats = {r.shard: (r.vectors, r.load) for r in vectors.shard_stats(vectors.assigned_shards(df, "vec_id", 20), 20).collect()}
    assert stats[4] == (15, 0.75) and vectors.dimension(df, "vec_id") == 2 and vectors.sized(df, 3).count() == 0


def test_running_sums_over_ranges(spark):
    values = RNG.integers(1, 100, 300).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").repartition(11)
    out = {r.i: r.upto for r in prefix.running(df, ["i"], F.col("v")).collect()}
    assert out == {i: sum(values[: i + 1]) for i in range(300)}
    assert prefix.ranked(df.limit(0), ["i"]).count() == 0


def test_empty_indexes(spark):
    none = spark.createDataFrame([], "vec_id bigint, data array<double>")
    assert vectors.vector_stats(none).first().vectors == 0 and vectors.assigned_shards(none, "vec_id").count() == 0
    assert vectors.candidates(None, spark.range(5).withColumnRenamed("id", "tensor_id"), 1, 2).collect() == [(1,), (2,)]


def test_embedding_cache_encodes_each_text_once(spark):
    encoders = embeddings.standard()
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], "id long, text string")
    empty = spark.createDataFrame([], "cache_key string, embedding array<double>")
    found, cache = embeddings.with_cache(rows, empty, encoders)
    assert found.count() == 4 and cache.count() == 3
    again, same = embeddings.with_cache(rows, cache, encoders)
    assert same.count() == 3 and {r.id: r.embedding for r in again.collect()} == {r.id: r.embedding for r in found.collect()}
    with pytest.raises(ValueError):
        encoders.encoded(F.lit("x"), "nobody", "none")
    stored = embeddings.embedded(rows, encoders, namespace="n", tenant="t")
    assert [r.id for r in embeddings.text_search(spark, stored, "b a", encoders, 2).collect()] == ["1", "2"]
    assert embeddings.text_search(spark, stored, "b a", encoders, 2, namespace="other").count() == 0


def test_postings_give_the_scores_of_texts(spark):
    docs = spark.createDataFrame([(1, "The cat, the DOG"), (2, "other thecat"), (3, None), (4, "dog-cat dog")], "doc_id long, text string")
    want = {1: 1.01 + 1.01, 4: 1.01 + 1.02}
    for out in (search.full_text(docs, "cat Dog cat"), search.posting_search(search.postings(docs), "cat Dog cat")):
        assert {r.doc_id: round(r.score, 6) for r in out.collect()} == {k: round(v, 6) for k, v in want.items()}
    assert [r.doc_id for r in search.full_text(docs, "cat dog", k=1).collect()] == [4] and search.full_text(docs, "").count() == 0


def test_token_bucket_by_brute_force(spark, sf):
    events = model.read(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("tenant"), "ts")
    want, level, last = {}, {}, {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.request_id)):
        t = r.ts.replace(tzinfo=datetime.timezone.utc).timestamp()
        now = min(3, level.get(r.tenant, 3) + (t - last.get(r.tenant, t)) / 3600)
        want[r.request_id] = now >= 1
        level[r.tenant], last[r.tenant] = now - (now >= 1), t
    got = {r.request_id: r.allowed for r in tenancy.token_bucket(events, 3, 1 / 3600).collect()}
    assert sum(got[k] != want[k] for k in want) <= len(want) // 1000 and len(got) == len(want)  # times in floats may tie


def test_keys_and_roles(spark):
    principals = spark.createDataFrame([(tenancy.hashed_key("secret"), "t1", "editor")], "key_hash string, tenant string, role string")
    requests = spark.createDataFrame([(1, "secret"), (2, "guess"), (3, None)], "id int, api_key string")
    out = tenancy.resolved(requests, principals).withColumn("ok", tenancy.may("role", "viewer") & ~tenancy.may("role", "admin")).collect()
    assert [(r.id, r.tenant, r.ok) for r in out] == [(1, "t1", True)]
    slugs = spark.createDataFrame([("a",), ("a-1",), ("-a",), ("A",), ("",), ("a" * 64,), ("a\n",), (None,)], "s string")
    assert [r.v for r in slugs.select(tenancy.valid_slug("s").alias("v")).collect()] == [True, True, False, False, False, False, False, False]


def test_recorded_operations_and_depths(spark):
    log = spark.createDataFrame([("o1", "add")], "operation_id string, operation_type string")
    edges = spark.createDataFrame([], "child long, parent long, operation_id string")
    new = spark.createDataFrame([("o1", "again"), ("o2", "mul"), ("o3", "load"), ("o2", "mul")], "operation_id string, operation_type string")
    inputs = spark.createDataFrame([("o2", 1), ("o2", 2), ("o1", 9)], "operation_id string, tensor long")
    outputs = spark.createDataFrame([("o2", 5), ("o2", 6), ("o3", 7), ("o1", 8)], "operation_id string, tensor long")
    log2, edges2 = lineage.recorded(log, edges, new, inputs, outputs)
    assert sorted(r.operation_id for r in log2.collect()) == ["o1", "o2", "o3"]
    assert sorted(((r.child, r.parent) for r in edges2.collect()), key=str) == sorted([(5, 1), (5, 2), (6, 1), (6, 2), (7, None)], key=str)
    known = spark.createDataFrame([(1, 3)], "node long, depth int")
    assert {r.node: r.depth for r in lineage.with_depths(known, edges2).collect()} == {1: 3, 5: 4, 6: 4, 7: 0}
    with pytest.raises(ValueError):
        lineage.with_depths(known, spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long"))


@pytest.mark.parametrize("depth", [None, 1, 2, 3, 5, 40])
def test_doubling_equals_steps_on_cyclic_graphs(spark, depth):
    rng = np.random.default_rng(depth or 0)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (70, 2))} | {(k, k + 1) for k in range(40, 54)})
    edges = spark.createDataFrame(pairs, "child long, parent long")
    nodes = sorted({n for p in pairs for n in p})
    want = {}
    for s in nodes:
        seen, front, step = {s}, {s}, 0
        while front and (depth is None or step < depth):
            step += 1
            front = {b for a, b in pairs if a in front} - seen
            seen |= front
            want |= {(s, n): step for n in front}
    got = {(r.origin, r.node): r.depth for r in lineage.ancestors(edges, spark.createDataFrame([(n,) for n in nodes], "node long"), depth).collect()}
    assert got == want
    few = {(r.origin, r.node): r.depth for r in lineage.ancestors(edges, spark.createDataFrame([(3,), (41,)], "node long"), depth).collect()}
    assert few == {k: v for k, v in want.items() if k[0] in (3, 41)}


def test_determinants_codecs_and_contractions_by_brute_force(spark, sf):
    from tensorloom.queries import search as searching

    v = {r.vec_id: np.array(r.data) for r in model.vectors(spark, sf).collect()}
    for r in tables.det_8x8(spark, sf).collect():
        a = v[r.vec_id].reshape(8, 8)
        sign, log = np.linalg.slogdet(a)
        assert math.isclose(r.det, sign * math.exp(log), rel_tol=1e-9)
    for r in tables.codec_choice(spark, sf).collect():
        a = np.where(np.abs(v[r.vec_id]) >= 0.25, v[r.vec_id], 0) if r.vec_id % 3 == 0 else v[r.vec_id]
        s = np.linalg.svd(a.reshape(8, 8), compute_uv=False) ** 2
        assert r.codec == ("coo" if (a == 0).mean() > 0.8 else "lowrank" if s[:2].sum() / max(s.sum(), 1e-300) > 0.99 else "sq8")
    top = [r.vec_id for r in searching.sim_spectral(spark, sf).orderBy("rank").collect()]
    values = {i: np.linalg.svd(a.reshape(8, 8), compute_uv=False) for i, a in v.items()}
    assert top == sorted(v, key=lambda i: (np.linalg.norm(values[i] - values[0]), i))[:10]
    assert searching.contraction_topk(spark, sf).orderBy("rank").first().vec_id == 0


def test_descriptors_samples_and_forecasts_by_brute_force(spark, sf):
    from tensorloom.queries import search as searching

    v = {r.vec_id: np.array(r.data).reshape(8, 8) for r in model.vectors(spark, sf).collect()}
    for r in tables.matrix_descriptor(spark, sf).collect():
        a = v[r.vec_id]
        s = np.sqrt(np.maximum(np.linalg.eigvalsh(a.T @ a), 0))
        assert r.rank == np.linalg.matrix_rank(a) and np.allclose([r.spectral_norm, r.nuclear_norm, r.trace], [s.max(), s.sum(), sum(a[k, k] for k in range(8))], atol=1e-3)
        assert not (r.is_symmetric or r.is_orthogonal or r.is_diagonal)
    one, again = ([tuple(r) for r in tables.sample_n(spark, sf).orderBy("vec_id").collect()] for _ in range(2))
    assert one == again and len({i for i, _ in one}) == 25 and {i for i, _ in one} <= set(v)
    daily = {}
    for r in model.read(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "value").collect():
        daily.setdefault(r.event_type, {}).setdefault(r.day, []).append(r.value)
    got = {(r.event_type, r.step): r.value for r in tables.ts_ar_forecast(spark, sf).collect()}
    for kind, days in daily.items():
        level = [math.fsum(days[d]) for d in sorted(days)]
        x = [b - a for a, b in zip(level, level[1:])]
        p = min(2, (len(x) - 1) // 2)
        rows = [[1.0, *[x[t - k - 1] for k in range(p)]] for t in range(p, len(x))]
        weights = np.linalg.pinv(np.array(rows)) @ np.array(x[p:])
        last = level[-1]
        for step in range(1, 6):
            x.append(float(weights @ np.array([1.0, *[x[-k - 1] for k in range(p)]])))
            last += x[-1]
            assert math.isclose(got[kind, step], last, rel_tol=1e-6, abs_tol=1e-6)

    def frames(a):
        return [np.linalg.svd(m)[0][:, :3] for m in (a, a.T)]

    def similarity(a, b):
        """Principal angles by the singular values of products of frames; cores turned by the polar factors."""
        fa, fb = frames(a), frames(b)
        angles = [np.sqrt((np.arccos(np.clip(np.linalg.svd(p.T @ q, compute_uv=False), -1, 1)) ** 2).sum()) for p, q in zip(fa, fb)]
        turns = [(lambda u, s, w: u @ w)(*np.linalg.svd(p.T @ q)) for p, q in zip(fa, fb)]
        ca, cb = fa[0].T @ a @ fa[1], fb[0].T @ b @ fb[1]
        return math.exp(-(0.6 * np.mean(angles) + 0.4 * np.linalg.norm(ca - turns[0] @ cb @ turns[1].T)))

    want = sorted(((round(similarity(a, v[0]), 5), -i) for i, a in v.items()), reverse=True)[:10]
    found = [(r.score, -r.vec_id) for r in searching.contraction_topk(spark, sf).orderBy("rank").collect()]
    assert np.allclose([s for s, _ in found], [s for s, _ in want], atol=1e-4) and found[0][1] == 0


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_lists_meet_in_blocks_and_copies_tie_by_id(spark, monkeypatch, metric):
    """Many blocks, groups and pieces give what brute force over the probed lists gives; copies have one score, whatever their place."""
    x = np.repeat(clustered(120), 5, 0)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (9000, [1.0]), (9001, None)], "vec_id bigint, data array<double>")
    for name, value in {"QUERY_BLOCK": 7, "MEETING": 2, "GROUP_ROWS": 50, "SCORES": 100}.items():
        monkeypatch.setattr(search, name, value)
    index = vectors.Partitions(df, x[:30:5].tolist())
    got, c = {}, x[:30:5]
    for r in index.knn_join(df.where("vec_id % 4 = 0"), 7, metric, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    own = ((x[:, None] - c) ** 2).sum(2).argmin(1)
    first = np.arange(len(x)) // 5 * 5  # one of the copies, so that brute force has ties too
    for i in range(0, 600, 4):
        lists = set(np.argsort(((c - x[i]) ** 2).sum(1))[:3].tolist())
        far = vectors._distances(x, x[i], metric)[first]
        alive = {k for k in range(600) if own[k] in lists and k != i}
        assert got[i] == [k for k in np.lexsort((np.arange(600), far)).tolist() if k in alive][:7]
    assert set(got) == set(range(0, 600, 4))


def test_lists_do_not_pair_rows_in_the_plan(spark, tmp_path):
    """The search has no join of queries with rows, whose output would be all pairs."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(50))], "vec_id bigint, data array<double>")
    plan = vectors.Partitions(df, lists=2).knn_join(df, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "_part" not in plan


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_nearest_rows_hold_a_bounded_number_of_values(metric):
    """A block of queries holds some bytes a score, however many rows come at once, copies of one vector among them."""
    import tracemalloc

    x = clustered(6000, 8)
    x[1000:3000] = x[1000]
    best = search._Best(np.arange(1000), x[:1000], 3, metric)
    tracemalloc.start()
    best.add(np.arange(6000), x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 8 * search.SCORES
    for i in (0, 7, 999):
        far = vectors._distances(x, x[i], metric)
        far[i] = np.inf
        assert np.allclose(np.sort(far)[:3], np.sort(far[best.names[best.at == i]])) and len(set(best.names[best.at == i])) == 3


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_walks_of_many_queries_equal_single_ones(metric):
    x = clustered(400)
    edges, start = vectors.graph_of(x, metric=metric)
    assert max(len(e) for e in edges) <= vectors.DEGREE and all(len(set(e.tolist())) == len(e) and i not in e for i, e in enumerate(edges))
    pool, far = vectors.beams(x, edges, start, x[:70], 40, metric)
    for i in range(70):
        nodes, d = vectors.beam(x, edges, start, x[i], 40, metric)
        assert np.allclose(far[i][: len(d)], d) and len(set(pool[i].tolist()) & set(nodes.tolist())) >= len(nodes) - 1


def test_a_task_of_the_graph_search_answers_once_for_a_query(spark, tmp_path, monkeypatch):
    """What goes to the merge grows with the tasks, not with the groups."""
    x = clustered(600)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, data array<double>")
    graph = vectors.Graph(spark, f"file://{tmp_path}/g", group_rows=50)
    graph.insert(df)
    graph.remove(df.where("vec_id % 2 = 0"))
    frames = []
    real = type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, *a, **b: frames.append(real(self, *a, **b)) or frames[-1])
    graph.search(df.where("vec_id < 30").withColumnRenamed("vec_id", "query_id"), 5)
    hits = frames[0].withColumn("p", F.spark_partition_id()).collect()
    per = {}
    for r in hits:
        per[r.p, r.query_id] = per.get((r.p, r.query_id), 0) + 1
        assert r.vec_id % 2 == 1
    assert max(per.values()) == 5 and len({q for _, q in per}) == 30
