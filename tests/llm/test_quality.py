import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tensorloom.llm import quality
from tensorloom.llm.common import text_buffer


def test_em_finds_the_labellers_that_are_wrong():
    rnd = np.random.default_rng(2)
    n, k = 20000, len(quality.LABELLERS)
    good = rnd.random(n) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.9, 0.9, 0.6, 0.8, 0.55])
    v = np.where(rnd.random((n, k)) < right, good[:, None], ~good[:, None]) * 2
    v[rnd.random((n, k)) < 0.3] = 1
    patterns, counts = np.unique(v @ quality._powers, return_counts=True)
    tables, share = quality.estimated(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.03
    accuracy = tables[1, :, 2] / (tables[1, :, 2] + tables[1, :, 0])
    assert np.abs(accuracy - right).max() < 0.05


def test_separates_shapes(spark):
    rnd = np.random.default_rng(3)
    vocab = ["house", "tree", "river", "stone", "cloud", "walks", "slowly", "under", "the", "of", "green", "old", "sings", "over"] + [f"w{a}{b}" for a in "aeiou" for b in "lmnrst"]

    def prose(n):
        words = rnd.choice(vocab, n).tolist()
        return " ".join(w.capitalize() if k % 9 == 0 else w + "." * (k % 9 == 8) for k, w in enumerate(words))

    rows = [(i, prose(60)) for i in range(150)]
    rows += [(200 + i, prose(50).upper().replace(" ", "!! ")) for i in range(12)]
    rows += [(300 + i, " ".join(w + "$$$" for w in prose(50).split())) for i in range(12)]
    rows += [(400 + i, " ".join(x for w in prose(8).split() for x in [w] * 12)) for i in range(12)]
    rows += [(500, None), (501, ""), (502, "  "), (503, prose(30000))]
    df = spark.createDataFrame([(*r, 0.5, True) for r in rows], "doc_id long, text string, score double, kept boolean")
    out = {r.doc_id: r.score for r in quality.scored(df, quality.learned(df)).collect()}
    assert len(out) == len(rows) and all(0 <= s <= 1 for s in out.values())
    assert all(out[i] >= 0.5 for i in range(150)) and out[503] >= 0.5
    assert sum(out[i] >= 0.5 for i in out if 200 <= i < 412) == 0


def test_scores_against_labels_and_partitions(spark, sf):
    """The labels teach nothing here; the scorer of the weak labels is held against them."""
    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    scores = []
    for n in (1, 5, 13):
        part = docs.repartition(n)
        scores.append({r.doc_id: r.score for r in quality.scored(part, quality.learned(part)).collect()})
    assert scores[0] == scores[1] == scores[2]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL").collect() if r.doc_id in scores[0]}
    good, bad = ([scores[0][i] for i, q in labels.items() if q == k] for k in (1, 0))
    order = np.argsort(np.array(good + bad), kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    auc = (rank[: len(good)].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert auc > 0.95
    assert np.mean([s >= quality.THRESHOLD for s in good]) > 0.98


def plain_posterior(v, tables, share):
    """Bayes' rule, one labeller after the other."""
    good, bad = share, 1 - share
    for k, vote in enumerate(v):
        good, bad = good * tables[1, k, vote], bad * tables[0, k, vote]
    return good / (good + bad)


def test_posteriors_and_scores_by_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(["Some words stand here. They say little.", "A A A A a!!! ### $$$", None, "", "x", "THE QUICK BROWN FOX", "| a | b | c |"] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.learned(df)
    for r in quality.scored(df, model).collect():
        data, starts = text_buffer(pa.array([rows[r.doc_id][1]], pa.large_string()))
        v = quality.votes(quality.statistics(data, starts))[0]
        assert abs(r.posterior - plain_posterior(v, model.tables, model.share)) < 1e-9
        x = quality.hashed(data, starts)[0]
        assert abs(r.score - 1 / (1 + np.exp(-(x @ model.weights + model.bias)))) < 1e-6


def test_repeated_rows_null_ids_and_ties_at_the_threshold(spark):
    rows = [(1, "one text of words"), (1, "one text of words"), (1, "another text"), (None, "one text of words"), (2, None)]
    df = spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id long, text string, score double, key boolean")
    out = quality.scored(df, quality.learned(df)).collect()
    assert len(out) == 5 and len({r.score for r in out if r.doc_id != 2}) == 2
    zero = quality.Model(np.full((2, len(quality.LABELLERS), 3), 1 / 3), 0.5, np.zeros(quality.BUCKETS, np.float32), 0.0)
    assert quality.scored(df, zero).where(F.col("score") >= quality.THRESHOLD).count() == 5


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality.scored(df, quality.learned(df)).count() == 0
