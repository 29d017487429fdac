import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tensorloom.llm import decontamination, neardup, quality, toxicity
from tests.llm.test_neardup import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, docs, labels=(), benchmark=()):
    spark.createDataFrame(docs, COLUMNS).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))


VOCAB = [f"{a}{b}{c}" for a in ("l", "m", "st", "tr", "v") for b in "aeio" for c in ("nd", "rs", "lt", "ve", "mp")]


def prose(rnd, n):
    words = [rnd.choice(VOCAB) for _ in range(n)]
    return " ".join(w.capitalize() if k % 9 == 0 else w + "." * (k % 9 == 8) for k, w in enumerate(words))


def test_nulls_repeated_rows_ties_and_empty_side_tables(spark, tmp_path):
    rnd = random.Random(4)
    texts = [prose(rnd, 60) for _ in range(40)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs += [(100, texts[0], None, None, None), (None, texts[1], "en", "s", 1), (101, None, "en", "s", 0), (102, "", "en", "s", 0), (5, texts[5], "en", "s", len(texts[5])), (103, prose(rnd, 40_000), "en", "s", 0)]
    write(spark, tmp_path, docs)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in rows}
    # the copy goes; a row without id, the repeated row and the very long one stay whole
    assert 100 not in kept and {0, 5, 103, None} <= kept
    assert sum(r.doc_id == 5 and r.piece == 0 for r in rows) == 2
    pieces = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 103)
    assert [p for p, _, _ in pieces] == list(range(len(pieces))) and all(n == 4096 for _, _, n in pieces[:-1])


def test_extra_columns_with_clashing_names_stay(spark, tmp_path):
    rnd = random.Random(5)
    texts = [prose(rnd, 60) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 2.0, True) for i, t in enumerate(texts)], COLUMNS + ", key string, score double, kept boolean")
    write(spark, tmp_path, [])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[-3:] == ["key", "score", "kept"], name
    assert docs.count() == 30


@pytest.mark.parametrize("name", ["toxicity", "quality", "decontamination"])
def test_stages_are_the_operators_row_by_row(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)[name](spark, docs, sf).select("doc_id").collect()}
    rows = docs.select("doc_id", "text").collect()
    if name == "toxicity":
        model = toxicity.learned(docs, spark.read.parquet(f"{sf}/labels.parquet"))
        want = {r.doc_id for r in rows if model.scores([r.text])[0] < toxicity.THRESHOLD}
    elif name == "quality":
        model = quality.learned(docs)
        want = {r.doc_id for r in rows if model.of_texts([r.text])[0] >= quality.THRESHOLD}
    else:
        passages = [" ".join((r.text or "").lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
        literal = {r.doc_id for r in rows if any(p and p in " ".join((r.text or "").lower().split()) for p in passages)}
        assert literal and not literal & kept  # what holds a passage as it is goes
        index = decontamination.Index([(str(i), p.encode()) for i, p in enumerate(passages) if p])
        want = {r.doc_id for r in rows if not index.matches(r.text)}
    assert kept == want


def test_near_duplicate_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 4000)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf).select("doc_id").collect()}
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 5, 80)
    assert kept == {i for i, (_, _, first) in want.items() if first}
    assert neardup.classes(docs).where("kept").count() == len(kept)


def test_stages_keep_columns_and_drop_what_they_should(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).persist()
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        assert 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() < before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_empty_documents(spark, sf, tmp_path):
    import os

    for t in ("labels", "benchmark"):
        os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
