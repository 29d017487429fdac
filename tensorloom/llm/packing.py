"""Best-fit packing of tokenised documents into sequences of bounded length, planned on the histogram of lengths.

Documents become pieces of at most ``CAPACITY`` tokens. The plan only needs how many pieces have each length
(at most CAPACITY counts, whatever the input): pieces above a third of the capacity are matched, the longest
with the longest that still fits, at most two to a sequence; shorter ones go, longest first, into the fullest
sequence that still has room. Runs of equal pieces are placed at once, so the plan is a short table of
(length, first rank, number, first sequence, offset, pieces to a sequence), and each piece finds its place from
its length and its rank among the pieces of that length.

Tokens are those of the tokenizer on the whole text. As its white space only separates, each distinct unit
between is encoded once and its ids are reused, by later tasks of the worker too; the tests hold this against
the whole text.

Defined results: null and empty texts are the end token alone; repeated rows are packed each; very long
texts are cut into pieces of the capacity, of which only the last may be shorter.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import LOWER, numbered, pieces, span_hashes, stored, table, text_buffer

CAPACITY, END = 4096, 1
#: Distinct units whose ids a Python worker remembers, in each of two generations; some 40 bytes each.
REMEMBERED = 400_000
#: The form of tokenizer whose words may be divided further, and without regard to case.
_PARTS = {"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
_STEPS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]

GAP, LETTER, DIGIT, MARK, OTHER = range(5)
_kind = np.full(256, OTHER, np.uint8)
_kind[[9, 10, 13, 32]] = GAP
_kind[[*range(65, 91), *range(97, 123)]] = LETTER
_kind[48:58] = DIGIT
# not the marks that contractions and added tokens begin or end with
_kind[list(b'!"#$%&()*+,-./:;=?@[\\]^_`{}~')] = MARK
_divides = np.zeros((5, 5), bool)
_divides[[LETTER, LETTER, DIGIT, DIGIT, DIGIT, MARK, MARK], [DIGIT, MARK, LETTER, DIGIT, MARK, LETTER, DIGIT]] = True
# letters that normal forms leave alone: ASCII, and two bytes that begin with 195 but for the signs of product and quotient
_plain = _kind == LETTER
_accent = np.zeros(256, bool)
_accent[128:192] = True
_accent[[0x97, 0xB7]] = False


def _byte_signs() -> np.ndarray:
    """The characters that byte-level models write bytes as."""
    sign = np.arange(256, dtype="<u4")
    hidden = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b >= 174)]
    sign[hidden] = 256 + np.arange(len(hidden))
    return sign


class WordIds:
    """The ids of a tokenizer, unit by unit, remembered across the slices and tasks of a worker.

    Units are what ASCII blanks, tabs and line ends separate. Where the tokenizer normalises and divides text
    as ``_STEPS`` and ``_PARTS`` say, words are divided further between ASCII letters, digits and marks, units
    count as equal whatever the case of ASCII letters (but before other characters, as those may combine), and
    units of letters alone go straight to the model. Texts that hold an added token, in any case, aren't divided.
    """

    _loaded: dict[str, WordIds] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        steps = [[x["type"] for x in (form[k] or {}).get(n, [])] for k, n in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.fine = steps == list(_STEPS) and {form["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")} == _PARTS and form["model"]["type"] == "BPE"
        self.added = [t["content"].lower().encode() for t in form["added_tokens"]]
        self.signs = _byte_signs()
        self.clear()

    def clear(self) -> None:
        self.old = self.new = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def ids_of(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, fine: bool) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each span has, and all of them in a row."""
        count = np.zeros(len(begin), np.int64)
        rough = np.ones(len(begin), bool)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        raw = data.tobytes()
        if fine:
            second = np.concatenate([[False], data[:-1] == 195]) & _accent[data]
            odd = np.concatenate([[0], np.cumsum(~(_plain[data] | second | (data == 195)))])
            rough = odd[end] > odd[begin]
            own = np.flatnonzero(~rough)
            low = LOWER[data]
            low[second & (data < 0x9F)] += 32
            long = end[own] - begin[own]
            of = np.arange(int(long.sum()))
            signs = np.full(len(of) + len(own), 32, "<u4")
            signs[of + np.repeat(np.arange(len(own)), long)] = self.signs[low[of + np.repeat(begin[own] - (np.cumsum(long) - long), long)]]
            model = self.tokenizer.model.tokenize
            found = [model(t) for t in signs.tobytes().decode("utf-32-le").split(" ")[:-1]]
            count[own] = [len(f) for f in found]
            parts.append((own, np.array([t.id for f in found for t in f], np.uint32)))
        own = np.flatnonzero(rough)
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin[own].tolist(), end[own].tolist())]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count[own] = [len(i) for i in ids]
        parts.append((own, np.array([t for i in ids for t in i], np.uint32)))
        flat = np.zeros(int(count.sum()), np.uint32)
        first = np.cumsum(count) - count
        for own, part in parts:
            n = count[own]
            flat[np.arange(len(part)) + np.repeat(first[own] - (np.cumsum(n) - n), n)] = part
        return count, flat

    @staticmethod
    def _found(table: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is or would be in the table, and whether it is there."""
        at = np.minimum(np.searchsorted(table[0], keys), max(0, len(table[0]) - 1))
        return at, table[0][at] == keys if len(table[0]) else np.zeros(len(keys), bool)

    def _add(self, keys: np.ndarray, count: np.ndarray, flat: np.ndarray) -> None:
        """Adds sorted new keys to the newer table; a full one becomes the older one, whose units move up as they are met."""
        if len(self.new[0]) + len(keys) > REMEMBERED:
            self.old, self.new = self.new, (keys[:0], count[:0], count[:0], flat[:0])
        hashes, first, many, ids = self.new
        place = np.searchsorted(hashes, keys)
        own = len(ids) + np.cumsum(count) - count
        self.new = np.insert(hashes, place, keys), np.insert(first, place, own), np.insert(many, place, count), np.concatenate([ids, flat])

    def units(self, data: np.ndarray, starts: np.ndarray, fine: bool) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = _kind[data]
        inside = kind != GAP
        fresh = np.ones(len(data), bool)  # where a unit may not go on
        fresh[1:] = ~inside[:-1]
        if fine:
            fresh[1:] |= _divides[kind[:-1], kind[1:]]
        fresh[starts[:-1][starts[:-1] < len(data)]] = True
        stop = np.append(fresh[1:] | ~inside[1:], True)
        return np.flatnonzero(inside & fresh), np.flatnonzero(inside & stop) + 1

    def encoded(self, data: np.ndarray, starts: np.ndarray, end_token: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after the other with the end token behind each, and where each row's ids start."""
        n = len(starts) - 1
        fine, same = self.fine, data
        if fine and len(data):
            same = LOWER[data]
            text = same.tobytes()
            fine = not any(t in text for t in self.added)
            same = np.where(np.append(data[1:] < 128, True), same, data) if fine else data
        begin, end = self.units(data, starts, fine)
        row = np.searchsorted(starts, begin, "right") - 1
        keys = span_hashes(same, begin, end) if len(begin) else np.zeros(0, np.uint64)
        unique, one, which = np.unique(keys, return_index=True, return_inverse=True)
        at, known = self._found(self.new, unique)
        was_at, was = self._found(self.old, unique)
        was &= ~known
        count = np.zeros(len(unique), np.int64)
        ids = []
        for found, table, rows in ((known, self.new, at), (was, self.old, was_at)):
            rows = rows[found]
            count[found] = many = table[2][rows]
            ids.append((found, table[3][np.arange(many.sum()) + np.repeat(table[1][rows] - (np.cumsum(many) - many), many)]))
        new = ~known & ~was
        if new.any():
            count[new], fresh = self.ids_of(data, begin[one[new]], end[one[new]], fine)
            ids.append((new, fresh))
        first = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.uint32)
        for found, part in ids:
            many = count[found]
            flat[np.arange(len(part)) + np.repeat(first[found] - (np.cumsum(many) - many), many)] = part
        if (late := ~known).any():
            many = count[late]
            self._add(unique[late], many, flat[np.arange(many.sum()) + np.repeat(first[late] - (np.cumsum(many) - many), many)])
        # the end token of each row is one more entry behind its units
        place = np.searchsorted(row, np.arange(n), "right") + np.arange(n)
        word = np.ones(len(row) + n, bool)
        word[place] = False
        from_, many = np.full(len(word), len(flat), np.int64), np.ones(len(word), np.int64)
        from_[word], many[word] = first[which], count[which]
        stop = np.cumsum(many)
        pick = np.arange(stop[-1] if len(stop) else 0) + np.repeat(from_ - (stop - many), many)
        return np.append(flat, np.uint32(end_token))[pick], np.concatenate([[0], stop[place]])


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = WordIds.of(tokenizer)
        for batch in pieces(batches, "text"):
            ids, at = words.encoded(*text_buffer(batch.column("text")), end)
            long = np.diff(at)
            cuts = -(-long // capacity)
            doc = np.repeat(np.arange(len(long)), cuts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(long[doc] - start, capacity)
            begin = at[doc] + start
            view = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(begin.tolist(), length.tolist())]
            columns = [batch.column("key").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, at[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = f"key {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, fields).withColumnRenamed("key", key)


def planned(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows of (length, first rank, number, first sequence, offset, pieces to a sequence), and the number of sequences."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    plan: list[tuple] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: ranges of sequences
    sizes: list[int] = []  # the gaps in use, ascending
    sequences = 0

    def open_gap(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    def put(length: int, n: int, first: int, offset: int, each: int = 1) -> None:
        plan.append((length, used[length], n, first, offset, each))
        used[length] += n
        left[length] -= n

    large = sorted(n for n in left if n > capacity // 3)
    waiting = list(large)  # ascending, those with pieces left
    while waiting:
        length = waiting[-1]
        k = bisect.bisect_right(waiting, capacity - length) - 1
        if k < 0:
            n = left[length]
            put(length, n, sequences, 0)
            open_gap(capacity - length, sequences, n)
            sequences += n
            waiting.pop()
            continue
        mate = waiting[k]
        n = left[length] // 2 if mate == length else min(left[length], left[mate])
        if mate == length and n == 0:
            n = 1
            put(length, 1, sequences, 0)
            below = waiting[k - 1] if k else None
            if below is not None:
                put(below, 1, sequences, length)
                if not left[below]:
                    waiting.pop(k - 1)
            open_gap(capacity - length - (below or 0), sequences, 1)
        elif mate == length:
            put(length, 2 * n, sequences, 0, 2)
            open_gap(capacity - 2 * length, sequences, n)
        else:
            put(length, n, sequences, 0)
            put(mate, n, sequences, length)
            open_gap(capacity - length - mate, sequences, n)
        sequences += n
        for size in {length, mate}:
            if not left[size] and size in waiting:
                waiting.remove(size)
    for length in sorted((n for n in left if n <= capacity // 3), reverse=True):
        while left[length]:
            k = bisect.bisect_left(sizes, length)
            if k < len(sizes):
                gap = sizes[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(k)
            else:
                gap, first, n = capacity, sequences, -(-left[length] // (capacity // length))
                sequences += n
            each = gap // length
            full = min(n, left[length] // each)
            if full:
                put(length, full * each, first, capacity - gap, each)
                open_gap(gap - full // full * each * length, first, full)
            if full < n:
                rest = left[length]
                if rest:
                    put(length, rest, first + full, capacity - gap, rest)
                    open_gap(gap - rest * length, first + full, 1)
                    full += 1
                open_gap(gap, first + full, n - full)
    return np.array(plan, np.int64).reshape(-1, 6), sequences


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, a written table with a column ``length`` (see ``tokenised``)."""
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan, _ = planned(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    starts = plan[:, 0] * (1 << 44) + plan[:, 1]
    ranked = numbered(cut, "length", "rank_of_length")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank_of_length"))
            row = plan[np.searchsorted(starts, length * (1 << 44) + rank, "right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row[:, 3] + nth // row[:, 5]), pa.array(row[:, 4] + nth % row[:, 5] * length)], names=[*batch.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long").drop("rank_of_length")


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Tokenises documents and packs their pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packed(stored(tokenised(docs, tokenizer, capacity, end), "pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
