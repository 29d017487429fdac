"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that matches a stretch of text with at most k edits shares at least m - q + 1 - k q
of its q-grams with it, all within k diagonals of each other. So: mark the positions of a text whose q-gram is
some passage's; keep the positions around which enough of them are marked; count their passages in overlapping
bands of diagonals; align the bands that reach a passage's bound, within k diagonals, and report the matches.

Texts are compared lower-cased and with runs of white space as one space, in UTF-8 bytes. Passages shorter than
``SHORT`` bytes are only looked for literally. The passages are indexed on the driver in blocks of at most
``BLOCK`` bytes, a pass over the documents for each block, so no broadcast grows beyond some 40 bytes for each of
those; a benchmark of many blocks costs as many passes.

Defined results: null and empty texts match nothing; empty passages are ignored; a document and passage that
match give one row, for the best match (the fewest edits, then the first); repeated rows give repeated matches;
an empty table gives an empty result; ids of documents and passages may be of any type that text can be cast to
and back; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import rows_where, table

Q = 8
#: Edits allowed for a byte of a passage.
EDITS = 0.06
SHORT = 32
#: Bytes of the passages of an index; it holds some 40 bytes for each, which every Python worker gets.
BLOCK = 2_000_000
#: Shared q-grams (text position, passage position) that are looked at at once.
SLICE = 1 << 18


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram at each position, its bytes as a number."""
    n = max(0, len(data) - Q + 1)
    if not n:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), np.dtype("<u8"), np.ascontiguousarray(data), strides=(1,))


class Index:
    """The q-grams of a block of passages."""

    def __init__(self, passages: list[tuple[str | None, bytes]]):
        self.passages = passages
        self.length = np.array([len(p) for _, p in passages], np.int64)
        self.edits = np.minimum((EDITS * self.length).astype(np.int64), np.maximum(0, (self.length - Q) // Q))
        self.edits[self.length < SHORT] = 0
        self.bound = np.maximum(1, self.length - Q + 1 - self.edits * Q)
        found = [(grams(np.frombuffer(p, np.uint8)).copy(), i) for i, (_, p) in enumerate(passages) if len(p) >= SHORT]
        gram = np.concatenate([g for g, _ in found]) if found else np.zeros(0, np.uint64)
        item = np.repeat([i for _, i in found], [len(g) for g, _ in found]).astype(np.int64) if found else np.zeros(0, np.int64)
        at = np.concatenate([np.arange(len(g)) for g, _ in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.item, self.at = item[order].astype(np.int32), at[order].astype(np.int32)
        self.gram, first, many = np.unique(gram[order], return_index=True, return_counts=True)
        self.first, self.many = first.astype(np.int32), many.astype(np.int32)
        # a table of bits that most other grams miss
        self.shift = np.uint64(64 - max(16, int(16 * max(1, len(self.gram))).bit_length()))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self._slot(self.gram)] = True
        self.short = [i for i, (_, p) in enumerate(passages) if 0 < len(p) < SHORT]
        # windows, by classes of passages of similar length: if a passage matches, some window of ``span``
        # positions holds at least ``least`` marked ones
        self.windows = []
        long = np.flatnonzero(self.length >= SHORT)
        low = SHORT
        while len(long) and low <= self.length.max():
            own = long[(self.length[long] >= low) & (self.length[long] < 2 * low)]
            if len(own):
                span = int((self.length[own] + self.edits[own]).min())
                parts = -(-(self.length[own] + self.edits[own] - Q + 1) // span)
                self.windows.append((span, int((-(-self.bound[own] // parts)).min()), int((self.length[own] + self.edits[own]).max())))
            low *= 2

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def regions(self, data: np.ndarray) -> set[tuple[int, int]]:
        """(passage, diagonal) of bands that hold enough shared q-grams."""
        gram = grams(data)
        if not len(gram) or not len(self.gram):
            return set()
        hit = np.flatnonzero(self.bits[self._slot(gram)])
        if not len(hit):
            return set()
        place = np.minimum(np.searchsorted(self.gram, gram[hit]), len(self.gram) - 1)
        real = self.gram[place] == gram[hit]
        hit, place = hit[real], place[real]
        # positions close to which some window holds enough marked positions
        near = np.zeros(len(hit), bool)
        for span, least, reach in self.windows:
            inside = np.searchsorted(hit, hit + span) - np.arange(len(hit))
            dense = hit[inside >= least]
            if len(dense):
                below = np.searchsorted(dense, hit - reach)
                near |= (below < len(dense)) & (dense[np.minimum(below, len(dense) - 1)] <= hit + reach)
        hit, place = hit[near], place[near]
        if not len(hit):
            return set()
        found: set[tuple[int, int]] = set()
        longest = int(self.length.max())
        total = np.cumsum(self.many[place], dtype=np.int64)
        # counts of the bands that may still grow, by lap
        open_bands = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in (0, 1)]
        i = 0
        while i < len(hit):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + SLICE, "right")))
            many = self.many[place[i:j]].astype(np.int64)
            where = np.repeat(hit[i:j], many)
            entry = np.arange(many.sum()) + np.repeat(self.first[place[i:j]] - (np.cumsum(many) - many), many)
            item = self.item[entry].astype(np.int64)
            diagonal = where - self.at[entry] + longest
            width = self.edits[item] + 1
            for lap in (0, 1):
                # bands of two widths, each overlapping the next by one
                band = (diagonal // width + lap) // 2
                seen, had = open_bands[lap]
                key, which = np.unique(np.concatenate([seen, item * (1 << 40) + band]), return_inverse=True)
                n = np.bincount(which, np.concatenate([had, np.ones(len(item), np.int64)]), len(key)).astype(np.int64)
                who = key >> 40
                wide = self.edits[who] + 1
                start = ((key & ((1 << 40) - 1)) * 2 - lap) * wide - longest
                ok = n >= self.bound[who]
                found |= set(zip(who[ok].tolist(), start[ok].tolist()))
                # a band that ends before the next marked position is done
                grows = start + 2 * wide + self.length[who] >= hit[j] if j < len(hit) else np.zeros(len(key), bool)
                open_bands[lap] = key[grows], n[grows]
            i = j
        return found

    def matches(self, text: str | None) -> list[tuple[str | None, int, int, int]]:
        """(item, start, end, edits) in the normalised text, the best for each passage."""
        raw = normal(text)
        best: dict[int, tuple[int, int, int]] = {}
        for i in self.short:
            if (a := raw.find(self.passages[i][1])) >= 0:
                best[i] = (0, a, a + len(self.passages[i][1]))
        for i, start in sorted(self.regions(np.frombuffer(raw, np.uint8))):
            passage, k = self.passages[i][1], int(self.edits[i])
            low = max(0, start - k)
            high = min(len(raw), start + 3 * k + 2 + len(passage))
            if (a := raw.find(passage, low, high)) >= 0:
                found = (0, a, a + len(passage))
            else:
                found = aligned(passage, raw[low:high], k)
                found = found and (found[0], found[1] + low, found[2] + low)
            if found and (i not in best or found < best[i]):
                best[i] = found
        return [(self.passages[i][0], a, b, e) for i, (e, a, b) in sorted(best.items())]


def aligned(passage: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the stretch of the text with the fewest edits from the passage, if at most ``most``.

    The text may begin and end anywhere; only as many diagonals are kept as the lengths allow.
    """
    m, n = len(passage), len(text)
    room = max(0, n - m) + most
    p, t = np.frombuffer(passage, np.uint8), np.frombuffer(text, np.uint8)
    # column d of row i is text position i + d - most; a free start costs nothing in row 0
    width = room + most + 1
    large = 1 << 20
    j = np.arange(width) - most
    cost = np.where((j >= 0) & (j <= n), 0, large)
    begin = j.copy()
    steps = np.arange(width)
    for i in range(1, m + 1):
        j = np.arange(width) + i - most
        ok = (j >= 1) & (j <= n)
        same = np.zeros(width, bool)
        same[ok] = t[j[ok] - 1] == p[i - 1]
        through = cost + np.where(ok, ~same, large)
        above = np.append(cost[1:], large) + 1
        from_above = np.append(begin[1:], 0)
        new = np.minimum(through, above)
        start = np.where(through <= above, begin, from_above)
        # insertions of text bytes run along the row
        run = new - steps
        low = np.minimum.accumulate(run)
        lead = np.maximum.accumulate(np.where(run == low, steps, 0))
        cost = np.where((j >= 0) & (j <= n), low + steps, large)
        begin = start[lead]
        if cost.min() > most:
            return None
    end = int(np.argmin(cost))
    return (int(cost[end]), int(begin[end]), m + end - most) if cost[end] <= most else None


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes of the passages, each of at most BLOCK bytes (or one passage)."""
    held, size = [], 0
    for r in benchmark.select(item, text).where(F.col(text).isNotNull()).distinct().orderBy(item, text).toLocalIterator(prefetchPartitions=True):
        passage = normal(r[1])
        if not passage:
            continue
        if held and size + len(passage) > BLOCK:
            yield Index(held)
            held, size = [], 0
        held.append((None if r[0] is None else str(r[0]), passage))
        size += len(passage)
    yield Index(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(key, item, match_start, match_end, edits) for each document and benchmark passage that it contains."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    spark = docs.sparkSession
    out = None
    for index in blocks(benchmark, item):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *m) for i, t in enumerate(batch.column("text")) for m in shared.value.matches(t.as_py())]
                at, items, start, end, edits = zip(*rows) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(items, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())], names=["key", "item", "match_start", "match_end", "edits"])

        part = source.mapInArrow(run, f"key {kinds[0]}, item string, match_start long, match_end long, edits int")
        out = part if out is None else out.union(part)
    return out.withColumn("item", F.col("item").cast(kinds[1])).withColumnsRenamed({"key": key, "item": item})


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose texts contain no passage."""
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = rows_where(docs, lambda texts, shared=shared: [not shared.value.matches(t) for t in texts], text)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
