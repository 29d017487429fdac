import random

import numpy as np
import pytest

from tensorloom.llm import decontamination as d


def distance(p, t):
    """Fewest edits between p and any stretch of t."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rnd, text, n):
    text = list(text)
    for _ in range(n):
        at = rnd.randrange(len(text))
        match rnd.randrange(3):
            case 0:
                text[at] = rnd.choice("xyz")
            case 1:
                text.insert(at, rnd.choice("xyz"))
            case _:
                del text[at]
    return "".join(text)


@pytest.mark.parametrize("seed", range(4))
def test_against_edit_distance(seed):
    rnd = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "tdnr" for b in "aeo" for c in ("nd", "rs", "l")]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.choice([4, 9, 20, 45]))) for _ in range(12)]
    index = d.Index([(i, p.encode()) for i, p in enumerate(passages)])
    for _ in range(25):
        i = rnd.randrange(len(passages))
        body = edited(rnd, passages[i], rnd.randrange(0, 4 + len(passages[i]) // 20))
        text = " ".join([*(rnd.choice(words) for _ in range(rnd.randrange(30))), body, *(rnd.choice(words) for _ in range(rnd.randrange(30)))])
        found = {m[0]: m for m in index.matches(text)}
        for k, p in enumerate(passages):
            best = distance(p, text)
            assert (k in found) == (best <= index.edits[k]), (k, best)
            if k in found:
                assert found[k][3] == best
                assert distance(p.encode(), text.encode()[found[k][1] : found[k][2]]) == best


def test_query_on_fixture(spark, tmp_path):
    passage = "The quick brown fox jumps over the lazy dog while seven wizards boil a pot of quartz soup in the yard."
    docs = [(1, passage), (2, "x " * 30000 + passage.upper() + " y" * 30000), (3, passage[:50]), (4, None), (5, ""), (6, passage.replace(" ", "\n\n")), (7, "before " + passage.replace("wizards", "wizzards") + " after"), (7, "before " + passage.replace("wizards", "wizzards") + " after"), (None, passage), (9, "short one")]
    spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item int, edits int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10, passage), (11, None), (12, ""), (13, "short one"), (10, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in d.query(spark, str(tmp_path)).collect()), key=repr)
    assert sorted({g for g in got}, key=repr) == sorted([(1, 10, 0), (2, 10, 0), (6, 10, 0), (7, 10, 1), (None, 10, 0), (9, 13, 0)], key=repr)
    kept = d.clean(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "benchmark.parquet")))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5] and len(kept.columns) == 4


def test_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 100)
    rnd = random.Random(9)
    passages = [(i, " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(12))) for i in range(9)]
    bench = spark.createDataFrame(passages, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so {p} it is") for i, p in passages], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()) == [(i, i) for i in range(9)]
    assert d.contaminated(docs.limit(0), bench).count() == 0 and d.contaminated(docs, bench.limit(0)).count() == 0


def test_long_texts_of_one_gram():
    index = d.Index([(1, b"na" * 60)])
    assert index.matches("na" * 50000)[0][3] == 0 and index.matches("nanx" * 9000) == []
    assert np.all(index.bound >= 1)


@pytest.mark.parametrize("small", [1, 40, 700])
def test_slices_of_shared_grams_change_nothing(monkeypatch, small):
    rnd = random.Random(small)
    common = "the same beginning of all of the passages "
    passages = [common + " ".join("".join(rnd.choice("abcde") for _ in range(4)) for _ in range(10)) for _ in range(12)]
    index = d.Index([(str(i), p.encode()) for i, p in enumerate(passages)])
    texts = [common * 3 + edited(rnd, p, k % 4) + " " + common + passages[0] for k, p in enumerate(passages)]
    want = [index.matches(t) for t in texts]
    monkeypatch.setattr(d, "SLICE", small)
    assert [index.matches(t) for t in texts] == want and all(any(m[0] == "0" for m in w) for w in want)


def test_ids_of_other_types(spark):
    passage = "Nine small boats went down the wide river in the grey light of a cold morning in March."
    bench = spark.createDataFrame([("item-a", passage, 5), (None, "another passage that is long enough to be looked for in texts", 6)], "item_id string, text string, doc_id int")
    docs = spark.createDataFrame([("x", passage), (None, passage), ("y", "so another passage that is long enough to be looked for in texts")], "doc_id string, text string")
    got = sorted(((r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()), key=repr)
    assert got == sorted([("x", "item-a"), (None, "item-a"), ("y", None)], key=repr)
