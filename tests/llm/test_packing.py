import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tensorloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello, world!", "it's  he'll\tI'm\nno\r\nyes", "ÀÉÎ éä", "á̂ ́ x", "ẛ̣ İstanbul ΣΑΣ", "x\x0by\x0cz\x1c  q", "<|endoftext|> <|startoftext|>a <|endoftext|>b", "日本語 😀 12 3.5$$$ *** &&&", "word " * 5000, "\u0000 ﻿", "'s 't's", "%%% ok### |"]


def test_ids_by_words_are_those_of_whole_texts():
    import pyarrow as pa

    from tensorloom.llm.common import text_buffer

    tokenizer = Tokenizer.from_file(PATH)
    words = packing.WordIds(PATH)
    for _ in range(2):
        ids, at = words.encoded(*text_buffer(pa.array(TEXTS)), 1)
        for i, t in enumerate(TEXTS):
            assert ids[at[i] : at[i + 1]].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], repr(t)


BITS = [*"aAbzIJKHTWY09 \t\n\r\x0b\x0c'.,&*%<|>!?-_/=\x00"] + ["’", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'RE", "é", "É", "ß", "ẞ", "÷", "×", "İ", "ı", "Σ", "ς", "\u0300", "\u0301", "\u030c", "\u0307", "\u0331", "\u0338", "\u00a0", "日", "ª", "²", "½", "Ⅷ", "😀", "ﬁ", "\u212a", "가", "\u1100", "\u1161", "ÿ", "Þ", "ſ"]


@pytest.mark.parametrize("seed", range(3))
def test_ids_of_random_texts_are_those_of_whole_texts(seed, monkeypatch):
    import pyarrow as pa

    from tensorloom.llm.common import text_buffer

    if seed:
        monkeypatch.setattr(packing, "REMEMBERED", 40)  # units move between the generations
    tokenizer, words, rnd = Tokenizer.from_file(PATH), packing.WordIds(PATH), random.Random(seed)
    for _ in range(400):
        texts = ["".join(rnd.choice(BITS) for _ in range(rnd.choice([0, 1, 2, 3, 8, 30]))) for _ in range(rnd.choice([1, 5, 20]))]
        if rnd.random() < 0.7:
            texts = [t.replace("<|", "") for t in texts]
        ids, at = words.encoded(*text_buffer(pa.array(texts)), 1)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1], repr(t)


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece_once(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([12, 100, 4096])
    counts = {}
    for _ in range(rnd.choice([1, 5, 60])):
        counts[rnd.randrange(1, capacity + 1)] = rnd.choice([1, 2, 3, 50, 1000])
    plan, sequences = packing.planned(counts, capacity)
    filled, seen = {}, {n: 0 for n in counts}
    for length, first, n, seq, offset, each in sorted(plan.tolist(), key=lambda p: (p[0], p[1])):
        assert first == seen[length]
        seen[length] += n
        for k in range(n):
            filled.setdefault(seq + k // each, []).append((offset + k % each * length, length))
    assert seen == counts and sorted(filled) == list(range(sequences))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(n * c for n, c in counts.items())
    assert sequences <= 1.5 * -(-total // capacity) + 1 or sum(c for n, c in counts.items() if n > capacity // 2) <= sequences


def test_query_on_fixture(spark, tmp_path):
    texts = TEXTS + ["short text"] * 40
    spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, length int, key string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = packing.query(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = set()
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want.add((i, p, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096


def test_empty_table(spark):
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
