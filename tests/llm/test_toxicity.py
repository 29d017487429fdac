import itertools
import zlib

import numpy as np

from tensorloom.llm import toxicity


def test_grammar_marks_and_weights():
    score = lambda *symbols: toxicity.clause_score(list(symbols), [4.0] * len(symbols))
    w, i, th, ta, n, r = range(6)
    assert score(w, w) == 0 and score(i) == 4
    assert score(n, i) < score(i) < score(ta, i) and score(r, w, w, w, w, i) < score(i)
    assert score(n, w, w, w, i) == score(i)  # out of the negation's reach
    assert score(th) == 0 < score(ta, th) and score(i, ta) > score(i)


def test_composed_table_equals_stepwise_machines():
    for symbols in itertools.product(range(6), repeat=4):
        state, total = toxicity.GRAMMAR.start, 0.0
        for s in symbols:
            state, (share, more) = toxicity.GRAMMAR.step(state, (s,))
            total += share * 4.0 + more
        assert abs(total - toxicity.clause_score(list(symbols), [4.0] * 4)) < 1e-9


def write(spark, path, rows, labels):
    spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, toxic string, score double").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))


def test_learned_insults_and_held_out_rows(spark, tmp_path):
    rnd = np.random.default_rng(1)
    vocab = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("lom", "rat", "sin", "tup")]
    rows, labels = [], []
    for i in range(400):
        words = rnd.choice(vocab, 30).tolist()
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words[rnd.integers(30)] = "zorg" + rnd.choice(["ling", "ant", "ude"])
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 1, toxic))
    rows += [(1000, None), (1001, ""), (1002, "You fool! Dumb imbecile, you are vermin."), (1003, "word " * 40000), (1004, "\n.\n")]
    labels += [(5, None, None), (None, 1, 1), (7000, 1, 1)]
    write(spark, tmp_path, rows, labels)
    out = {r.doc_id: r for r in toxicity.query(spark, str(tmp_path)).collect()}
    assert set(out) == {i for i, _ in rows}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in out.items())
    wrong = [i for i, _, t in labels if i in out and out[i].held_out and t is not None and out[i].predicted != t]
    assert not wrong and out[1002].predicted == 1 and not any(out[i].predicted for i in (1000, 1001, 1003, 1004))


def test_texts_that_share_words_teach_one_by_one(spark, tmp_path):
    rnd = np.random.default_rng(2)
    vocab = [f"{a}{b}{c}" for a in "bdfg" for b in "aei" for c in ("lom", "rat", "sin")]
    rows = []
    for i in range(300):  # all texts have the same words in another order, toxic ones an insult more
        words = rnd.permutation(vocab).tolist()
        if i % 4 == 0:
            words.insert(rnd.integers(len(words)), "zorg" + rnd.choice(["ling", "ant", "ude"]))
        rows.append((i, " ".join(words)))
    teach = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.learned(docs, labels)
    assert sum(model.cross[:2]) == sum(i % 4 == 0 for i in teach)
    said = model.scores([t for _, t in rows]) >= toxicity.THRESHOLD
    assert said.tolist() == [i % 4 == 0 for i, _ in rows]


def test_only_copies_with_one_label_collapse(spark):
    text = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(4)]
    rows = [(5, text[0], 1), (3, text[0], 1), (4, text[0] + " more", 1), (6, text[0], 0), (7, text[1] + " " + text[0], 1), (8, text[1], 1), (9, text[2], 0), (10, text[3] + " w0x0", 0), (11, None, 0), (12, " ", 0)]
    out = toxicity.without_copies(spark.createDataFrame(rows, "id long, text string, toxic int")).collect()
    assert sorted(r.id for r in out) == [3, 6, 7, 8, 9, 10, 11]


def test_scores_do_not_depend_on_order_or_partitions(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    found = []
    for n in (1, 5, 13):
        part = docs.repartition(n, "text")
        found.append({r.doc_id: r.score for r in toxicity.scored(part, toxicity.learned(part, labels.repartition(n))).collect()})
    assert found[0] == found[1] == found[2]


def plain_features(text, lexicon):
    """Word by word and clause by clause, with the machines that the table is composed of."""
    import re

    text = (text or "").lower()
    total, best, clauses, words = 0.0, 0.0, 0, 0
    for clause in re.split(r"[\n!.;?]", text):
        state, score, hit = toxicity.GRAMMAR.start, 0.0, False
        for word in re.findall(r"(?:[a-z']|[^\x00-\x7f])+", clause):
            words += 1
            kind, weight = lexicon.of(toxicity.Words([word]))
            state, (share, more) = toxicity.GRAMMAR.step(state, (int(kind[0]),))
            score += share * float(weight[0]) + more
            hit |= int(kind[0]) in (toxicity.INSULT, toxicity.THREAT)
        if hit and score:
            total, best, clauses = total + score, max(best, score), clauses + 1
    return total, best, clauses, words


def test_features_by_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learned(docs, labels)
    texts = [r.text for r in docs.collect() if len(r.text or "") < 3000][:60] + ["You are not a fool! They said: you fool; I will hurt you", "", None, "Été déjà vu.\nidiot"]
    got = toxicity.features(texts, model.lexicon)
    for row, text in zip(got, texts):
        assert np.allclose(row, plain_features(text, model.lexicon)), text


def test_no_labels_and_empty_tables(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    write(spark, tmp_path / "a", [(1, "you fool, you imbecile"), (2, "fine"), (2, "fine")], [])
    assert sorted((r.doc_id, r.predicted) for r in toxicity.query(spark, str(tmp_path / "a")).collect()) == [(1, 1), (2, 0), (2, 0)]
    write(spark, tmp_path / "b", [], [])
    assert toxicity.query(spark, str(tmp_path / "b")).count() == 0


def test_accuracy_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    out = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert hit >= 0.7 * (out.toxic == 1).sum() and hit >= 0.9 * (out.predicted == 1).sum()
