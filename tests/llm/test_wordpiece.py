import random

import public_tokenizers
import pytest

from tensorloom.llm import wordpiece

PATH = public_tokenizers.path("word_bpe_49k.json")


def greedy(word: bytes, vocab: set, longest: int = 0) -> int:
    n = at = 0
    longest = longest or max(map(len, vocab))
    while at < len(word):
        at += next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocab), 1)
        n += 1
    return n


@pytest.mark.parametrize("seed", range(5))
def test_small_vocabularies_against_greedy_matching(seed):
    import numpy as np

    rnd = random.Random(seed)
    vocab = {bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 7))) for _ in range(25)}
    walk = wordpiece.Automaton(vocab)
    words = [bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(1, 25))) for _ in range(300)]
    ends = np.cumsum([len(w) for w in words])
    got = walk.counts(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert got.tolist() == [greedy(w, vocab) for w in words]


def test_query_on_fixture(spark, tmp_path):
    vocab = wordpiece.vocabulary(PATH)
    texts = [None, "", "  \n", "Hello, World!", "ÉTÉ été", "日本語", "a" * 3000, "internationalisation of antidisestablishmentarianism\x0bx", "same", "same", "w " * 40000]
    spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, key string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in wordpiece.query(spark, str(tmp_path)).collect()}
    longest = max(map(len, vocab))
    for i, t in enumerate(texts):
        words = (t or "").lower().encode().split()
        pieces = {w: greedy(w, vocab, longest) for w in set(words)}
        assert got[i] == (len((t or "").encode()), len(words), sum(pieces[w] for w in words))


def test_empty_table(spark):
    assert wordpiece.counted(spark.createDataFrame([], "doc_id long, text string")).count() == 0
