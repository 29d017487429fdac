import random
import re

import pytest

from tensorloom.llm import common, neardup


def brute(rows, width, percent):
    sets, component = {}, {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        component[i] = i
    ids = sorted(sets)

    def top(i):
        while component[i] != i:
            i = component[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and top(a) != top(b) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                component[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def found(spark, rows, width, percent=80):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(df, width=width, percent=percent).collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_against_brute_force(spark, width):
    rnd = random.Random(width)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(6):
        first = [rnd.choice(words) for _ in range(rnd.choice([8, 40, 120]))]
        for _ in range(rnd.choice([1, 5, 30])):
            copy = list(first)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " \t ", "one", "ONE", "One two", "one\ttwo", "é", "É", "x " * 5000, "x " * 4000])]
    assert found(spark, rows, width) == brute(rows, width, 80)


def test_large_buckets_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rnd = random.Random(5)
    first = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(60):
        copy = list(first)
        for _ in range(rnd.choice([0, 2, 4, 5])):
            copy[rnd.randrange(len(copy))] = f"u{rnd.randrange(9)}"
        rows.append((i, " ".join(copy)))
    assert found(spark, rows, 2) == brute(rows, 2, 80)


@pytest.mark.parametrize("hot, most", [(3, 200_000), (3, 4)])
def test_frequent_keys_are_dealt_to_several_tasks(spark, monkeypatch, hot, most):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(common, "MOST_HOT", most)
    monkeypatch.setattr(neardup, "ONE_TASK", 0)
    monkeypatch.setattr(neardup, "SMALL", 8)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rnd = random.Random(7)
    first = [f"v{i}" for i in range(50)]
    rows = [(i, " ".join(first)) for i in range(40)] + [(40 + i, None) for i in range(20)]
    for i in range(60, 140):
        copy = list(first)
        for _ in range(rnd.choice([1, 2, 4, 5])):
            copy[rnd.randrange(len(copy))] = f"u{rnd.randrange(30)}"
        rows.append((i, " ".join(copy)))
    assert found(spark, rows, 2) == brute(rows, 2, 80)


def test_large_groups_of_exact_and_near_copies(spark):
    rnd = random.Random(9)
    first = [f"v{i}" for i in range(200)]
    rows = [(i, "the same few words for all") for i in range(5000)]
    for i in range(5000, 9000):
        copy = list(first)
        copy[rnd.randrange(200)] = f"u{rnd.randrange(5000)}"
        rows.append((i, " ".join(copy)))
    out = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    assert {(r.component_id, r.n) for r in out.groupBy("component_id").agg({"*": "count"}).toDF("component_id", "n").collect()} == {(0, 5000), (5000, 4000)}


def test_joins_and_components_do_not_depend_on_partitions(spark):
    rnd = random.Random(11)
    first = [f"v{i}" for i in range(40)]
    rows = []
    for i in range(120):
        copy = list(first)
        for _ in range(rnd.choice([0, 2, 5])):
            copy[rnd.randrange(len(copy))] = f"u{rnd.randrange(20)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 5, 80)
    for n in (1, 7):
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(df.repartition(n)).collect()} == want


def test_an_id_with_several_texts_links_what_any_of_them_links(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(1, a), (5, a + " more"), (5, a + " more"), (5, b), (8, b + " end"), (9, "alone")]
    out = {(r.doc_id, r.component_id) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert out == {(1, 1), (5, 1), (8, 1), (9, 9)}


def test_empty_table_null_ids_repeated_rows_and_clashing_columns(spark):
    assert neardup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c", 1, "x"), (3, "a b c", 1, "x"), (3, "a b c", 1, "x"), (7, "a b c", 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, component_id string")
    out = sorted((tuple(r) for r in neardup.classes(df, width=2).collect()), key=repr)
    assert out == sorted([(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (7, 2, 3, False)], key=repr)


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_paths_and_stars(spark, monkeypatch, one_task):
    monkeypatch.setattr(neardup, "ONE_TASK", one_task)
    rnd = random.Random(1)
    path = rnd.sample(range(1000, 2000), 40)
    edges = list(zip(path, path[1:])) + [(5, k) for k in range(6, 30)] + [(7, 7), (3000, 3001), (3001, 3000)]
    got = {r.u: r.root for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {k: min(path) for k in path if k != min(path)} | {k: 5 for k in range(6, 30)} | {3001: 3000}
    assert got == want


def test_thresholds_that_would_lose_links_are_refused(spark):
    for percent in (50, 79, 101):
        with pytest.raises(ValueError):
            found(spark, [(1, "a b c")], 2, percent)
