import collections
import random
import zlib

from tensorloom.llm import sharding


def run(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, slot int, size string").write.parquet(str(tmp_path / "documents.parquet"))
    return sharding.query(spark, str(tmp_path)).collect()


def test_near_equal_bytes_and_slots(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, "w" * rnd.randrange(1, 900)) for i in range(4000)] + [(4000 + i, "copy of one text") for i in range(2000)] + [(9000, None), (9001, ""), (None, "n"), (3, "again"), (3, "again")]
    out = run(spark, tmp_path, rows)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=repr) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in out:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    mean = sum(load.values()) / 40
    assert set(load) == set(range(40)) and max(abs(v - mean) for v in load.values()) < 0.02 * mean + 916
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_equal_texts_stay_together_where_their_group_is_small(spark, tmp_path):
    rnd = random.Random(4)
    texts = ["t%d " % i * rnd.randrange(1, 90) for i in range(6000)]
    out = run(spark, tmp_path, list(enumerate(texts + texts)))
    where = collections.defaultdict(set)
    for r in out:
        where[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 40


def test_empty_and_tiny_tables(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    assert run(spark, tmp_path / "a", []) == []
    assert sorted(r.slot for r in run(spark, tmp_path / "b", [(1, "a"), (2, "a"), (3, None)])) in ([0, 0, 0], [0, 0, 1], [0, 1, 2])


def test_ties_in_every_dimension_and_few_passes(spark, tmp_path, monkeypatch):
    passes = []
    own = sharding._histograms
    monkeypatch.setattr(sharding, "_histograms", lambda *a: passes.append(1) or own(*a))
    monkeypatch.setattr(sharding, "SAMPLE", 500)
    rows = [(i, "one text for all") for i in range(3000)] + [(i, "w" * (i % 7)) for i in range(3000, 6000)] + [(6000 + i, "x" * 20_000) for i in range(5)]
    out = run(spark, tmp_path, rows)
    load = collections.Counter()
    for r in out:
        load[r.shard] += r.size
    mean = sum(load.values()) / 40
    assert len(out) == len(rows) and len(passes) <= 42
    assert max(load.values()) <= mean + 20_016 + 0.02 * mean
