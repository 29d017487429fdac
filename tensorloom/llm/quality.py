"""Quality classifier without labels: overlapping heuristics vote, EM weighs them, a hashed linear scorer learns.

Eight heuristic labellers look at the shape of a text (capitals, symbols, repeated words, bars, sentence ends,
distinct words, word lengths, garbled words) and vote good, bad or nothing; an abstention says nothing about a
text, as most labellers abstain on short ones. How often each pattern of votes
occurs (at most 3**8 counts, over all rows) is all that expectation-maximisation needs to estimate how each labeller
votes on good and on bad texts. The posteriors of up to ``TRAIN`` rows (those with the smallest hashes of their
ids) teach a logistic regression on hashed pairs of word shapes, which scores every row.

Defined results: null and wordless texts get no votes and a score from the bias alone plus the mark for empty texts;
a repeated row is scored each time, and of an id's texts the least one teaches; a score equal to the threshold keeps a text;
rows with a null id are scored but don't teach; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import mixed, pieces, span_hashes, table, text_buffer, words_of

#: Rows that teach the linear scorer at most, hashed features, least score of a good text.
TRAIN, BUCKETS, THRESHOLD = 4_000, 1024, 0.5
LABELLERS = ("capitals", "symbols", "repeats", "bars", "sentences", "distinct", "lengths", "garbled")
BAD, NONE, GOOD = 0, 1, 2

#: Classes of bytes: letters, capitals, digits, other characters, white space.
_class = np.full(256, ord("."), np.uint8)
_class[[*range(97, 123), *range(128, 256), 39]] = ord("a")
_class[65:91] = ord("A")
_class[48:58] = ord("0")
_class[[33, 35, 36, 37, 38, 42, 124]] = np.frombuffer(b"!####*|", np.uint8)
_symbol = np.zeros(256, bool)
_symbol[[33, 35, 36, 37, 38, 42, 61, 64, 94, 95, 124, 126]] = True
_stop = np.zeros(256, bool)
_stop[[33, 46, 63]] = True


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def statistics(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Shares that the labellers look at, for each row."""
    begin, end, row = words_of(data, starts)
    n = len(starts) - 1
    words = np.bincount(row, minlength=n)
    safe = np.maximum(words, 1)
    hashes = span_hashes(data, begin, end) if len(begin) else np.zeros(0, np.uint64)
    again = np.zeros(len(row), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((hashes, row))
    fresh = np.ones(len(row), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    # characters other than letters before a byte, to find those inside words
    strange = np.concatenate([[0], np.cumsum((_class[data] != ord("a")) & (_class[data] != ord("A")))])
    small = (data >= 97) & (data < 123)
    capital = (data >= 65) & (data < 91)
    letters = np.maximum(_sums(small | capital, starts), 1)
    first_class = _class[data[begin]] if len(begin) else np.zeros(0, np.uint8)
    return {
        "words": words,
        "capitals": _sums(capital, starts) / letters,
        "symbols": _sums(_symbol[data], starts) / np.maximum(np.diff(starts), 1),
        "repeats": np.bincount(row, again, n) / safe,
        "bars": np.bincount(row, first_class == ord("|"), n) / safe,
        "ends": np.bincount(row, _stop[data[end - 1]] if len(end) else None, n) / safe,
        "distinct": np.bincount(row[order], fresh, n) / np.sqrt(safe) / np.sqrt(np.minimum(safe, 400)),
        "length": np.bincount(row, end - begin, n) / safe,
        "garbled": np.bincount(row, strange[np.maximum(end - 1, begin + 1)] > strange[np.minimum(begin + 1, end)], n) / safe,
    }


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """A row of votes, one for each labeller, for each text."""
    some, long = s["words"] > 0, s["words"] >= 20

    def vote(bad, good, where=some):
        return np.where(where & bad, BAD, np.where(where & good, GOOD, NONE))

    return np.column_stack([
        vote(s["capitals"] > 0.4, s["capitals"] < 0.15),
        vote(s["symbols"] > 0.03, s["symbols"] < 0.005),
        vote(s["repeats"] > 0.15, s["repeats"] < 0.02, long),
        vote(s["bars"] > 0.05, s["bars"] == 0),
        vote((s["ends"] < 0.01) | (s["ends"] > 0.6), (s["ends"] > 0.02) & (s["ends"] < 0.35), long),
        vote(s["distinct"] < 0.15, s["distinct"] > 0.35, long),
        vote((s["length"] < 2.5) | (s["length"] > 16), (s["length"] > 3.5) & (s["length"] < 11), long),
        vote(s["garbled"] > 0.25, s["garbled"] < 0.05),
    ]).astype(np.int64)


_powers = 3 ** np.arange(len(LABELLERS))


def estimated(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """EM over the patterns of votes: P(vote | bad or good) for each labeller, and the share of good texts."""
    v = (patterns[:, None] // _powers) % 3
    # to begin with, a vote for bad makes a text doubtful, several make it bad
    good = np.choose(np.minimum((v == BAD).sum(1), 2), [0.9, 0.3, 0.1])
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        share = (weight[1].sum() + 1) / (weight.sum() + 2)
        # a labeller's votes on each kind of text, where it votes; counts of 1 for smoothing
        tables = np.stack([[np.bincount(v[:, k], w, 3) + 1 for k in range(v.shape[1])] for w in weight])
        tables = tables / (tables[..., BAD] + tables[..., GOOD])[..., None]
        tables[..., NONE] = 1
        new = posterior(v, tables, share)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return tables, float(share)


def posterior(v: np.ndarray, tables: np.ndarray, share: float) -> np.ndarray:
    log = np.log(tables)
    which = np.arange(v.shape[1])
    margin = np.log(share / (1 - share)) + sum(log[1, k, v[:, k]] - log[0, k, v[:, k]] for k in which)
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def hashed(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed pairs of word shapes, and a few marks, for each row."""
    n = len(starts) - 1
    begin, end, row = words_of(data, starts)
    out = np.zeros((n, BUCKETS), np.float32)
    words = np.bincount(row, minlength=n)
    out[:, 0] = words == 0
    out[:, 1] = np.minimum(words, 20) / 20
    if not len(begin):
        return out
    # the shape of a word: its byte classes, runs as one
    shape = _class[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[begin] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    short = shape[keep]
    shapes = span_hashes(short, at[begin], at[end])
    same = np.zeros(len(begin), np.uint64)
    whole = span_hashes(data, begin, end)
    same[1:] = (whole[1:] == whole[:-1]) & (row[1:] == row[:-1])
    tokens = mixed(shapes + same)
    before = np.concatenate([[np.uint64(0)], tokens[:-1]])
    before[np.searchsorted(row, np.unique(row))] = 0
    for code in (tokens, mixed(tokens * np.uint64(3) + before)):
        bucket = (code >> np.uint64(40)).astype(np.int64) % (BUCKETS - 2) + 2
        out += np.bincount(row * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    out[:, 2:] = np.sqrt(out[:, 2:] / np.maximum(words, 1)[:, None])
    return out


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient descent with momentum; y are probabilities."""
    w, bias, speed, drift = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    for _ in range(rounds if len(y) else 0):
        error = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y
        speed = 0.9 * speed - rate * (x.T @ error / len(y) + decay * w)
        drift = 0.9 * drift - rate * float(error.mean())
        w, bias = w + speed, bias + drift
    return w, bias


class Model:
    def __init__(self, tables: np.ndarray, share: float, weights: np.ndarray, bias: float):
        self.tables, self.share, self.weights, self.bias = tables, share, weights, bias

    def scores(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts) - 1)
        for i in range(0, len(out), 512):
            part = starts[i : i + 513]
            # row sums, as the rounding of a matrix product would depend on the number of rows
            out[i : i + 512] = (hashed(data[part[0] : part[-1]], part - part[0]) * self.weights.astype(float)).sum(1) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        return self.scores(*text_buffer(pa.array(texts, pa.large_string())))


def learned(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Estimates the labellers on all rows and fits the scorer on the posteriors of a bounded sample."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in pieces(batches, "text"):
            total += np.bincount(votes(statistics(*text_buffer(batch.column("text")))) @ _powers, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["pattern", "n"])

    found = source.mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    if not len(found):
        return Model(np.full((2, len(LABELLERS), 3), 1 / 3), 0.5, np.zeros(BUCKETS, np.float32), 0.0)
    tables, share = estimated(found["pattern"].to_numpy(), found["n"].to_numpy(float))

    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 19):
            data, starts = text_buffer(batch.column("text"))
            y = posterior(votes(statistics(data, starts)), tables, share)
            x = hashed(data, starts)
            rows = pa.Array.from_buffers(pa.binary(), len(y), [None, pa.py_buffer(np.arange(0, (len(y) + 1) * 4 * BUCKETS, 4 * BUCKETS, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([pa.array(y), rows], names=["y", "x"])

    ids = source.select("key").where("key IS NOT NULL").distinct().orderBy(F.xxhash64("key"), "key").limit(TRAIN)
    # one text of each id, so that at most TRAIN rows come to the driver, 4 KB each
    texts = source.join(F.broadcast(ids), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    sample = texts.mapInArrow(taught, "y double, x binary").toPandas()
    sample = sample.sort_values(["y", "x"])  # the order of partitions doesn't matter
    x = np.frombuffer(b"".join(sample["x"]), np.float32).reshape(-1, BUCKETS)
    weights, bias = fitted(x, sample["y"].to_numpy(np.float32))
    return Model(tables, share, weights, bias)


def scored(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, posterior) of each row: the scorer's probability that the text is good, and that of the labellers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, starts = text_buffer(batch.column("text"))
            labelled = posterior(votes(statistics(data, starts)), model.tables, model.share)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(model.scores(data, starts)), pa.array(labelled)], names=["key", "score", "posterior"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, score double, posterior double").withColumnRenamed("key", key)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, learned(docs)).withColumn("kept", F.col("score") >= THRESHOLD)
