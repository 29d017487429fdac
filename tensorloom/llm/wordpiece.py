"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie. Each node has a failure link, to the node that is reached once the pieces that
the greedy longest match would cut off its string are gone, and the number of those pieces. A word is counted
in one walk over its bytes: where no edge leads on, the popped pieces are added and the failure link is
followed. No piece is ever built. The walk is made for all distinct words of a slice of texts at once.

Words are runs of bytes other than ASCII white space, of the lower-cased text. The vocabulary is a set of byte
strings; single bytes that it lacks are added, so every word can be counted.

Defined results: null and empty texts have no words and no tokens; a repeated row is counted each time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import pieces, span_hashes, table, text_buffer, words_of

REMEMBERED = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


def vocabulary(path: str) -> set[bytes]:
    """The byte strings of a byte-level vocabulary file, without word-end marks and special tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    of = byte_alphabet()
    return {bytes(of[c] for c in t.removesuffix("</w>")) for t in model["model"]["vocab"] if t not in special} - {b""}


class Automaton:
    def __init__(self, vocab: Iterable[bytes]):
        vocab = set(vocab) | {bytes([b]) for b in range(256)}
        edges: dict[int, int] = {}
        parent, byte, final = [0], [0], [False]
        for token in sorted(vocab):
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in edges:
                    edges[key] = len(parent)
                    parent.append(node)
                    byte.append(b)
                    final.append(False)
                node = edges[key]
            final[node] = True
        n = len(parent)
        fail, pops = [0] * n, [0] * n
        depth = [0] * n
        for v in range(1, n):
            depth[v] = depth[parent[v]] + 1
        for v in sorted(range(1, n), key=depth.__getitem__):
            if final[v]:
                pops[v] = 1
                continue
            u, count = fail[parent[v]], pops[parent[v]]
            while (key := u << 8 | byte[v]) not in edges:
                count += pops[u]
                u = fail[u]
            fail[v], pops[v] = edges[key], count
        rest = [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            rest[v] = pops[v] + rest[fail[v]]
        self.fail, self.pops, self.rest = (np.array(x, np.int64) for x in (fail, pops, rest))
        # open addressing with a power of two of slots, at most a quarter full
        keys = np.fromiter(edges, np.int64, len(edges))
        nodes = np.fromiter(edges.values(), np.int64, len(edges))
        self.shift = np.uint64(64 - max(10, int(4 * len(keys)).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.keys, self.nodes, self.probes = np.full(slots, -1, np.int64), np.zeros(slots, np.int64), 0
        left, place = np.arange(len(keys)), self._slot(keys)
        while len(left):
            self.probes += 1
            free = self.keys[place] == -1
            _, one = np.unique(place[free], return_index=True)
            taken = np.flatnonzero(free)[one]
            self.keys[place[taken]], self.nodes[place[taken]] = keys[left[taken]], nodes[left[taken]]
            stay = np.ones(len(left), bool)
            stay[taken] = False
            left, place = left[stay], (place[stay] + 1) & (slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def next(self, nodes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """Where the edges lead, -1 where there is none."""
        keys = nodes << 8 | bytes_
        place = self._slot(keys)
        out = np.where(self.keys[place] == keys, self.nodes[place], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[place] != -1))
        while len(open_):
            place[open_] = (place[open_] + 1) & (len(self.keys) - 1)
            hit = self.keys[place[open_]]
            found = hit == keys[open_]
            out[open_[found]] = self.nodes[place[open_[found]]]
            open_ = open_[~found & (hit != -1)]
        return out

    def counts(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of greedy longest-match pieces of each byte span."""
        order = np.argsort(begin - end, kind="stable")  # the longest first, so that those still walking are a prefix
        at, length = begin[order], (end - begin)[order]
        node, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -k, "left"))
            byte = data[at[:n] + k].astype(np.int64)
            to = self.next(node[:n], byte)
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                total[stuck] += self.pops[node[stuck]]
                node[stuck] = self.fail[node[stuck]]
                to[stuck] = self.next(node[stuck], byte[stuck])
                stuck = stuck[to[stuck] < 0]
            node[:n] = to
        out = np.empty(len(at), np.int64)
        out[order] = total + self.rest[node]
        return out


_made: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _made:
        _made[path] = Automaton(vocabulary(path))
    return _made[path]


def counted(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_words, n_tokens) of each row."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = automaton(path)
        known, tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in pieces(batches, "text"):
            lowered = pa.array([(t or "").lower() for t in batch.column("text").to_pylist()], pa.large_string())
            data, starts = text_buffer(lowered)
            begin, end, row = words_of(data, starts)
            hashes = span_hashes(data, begin, end) if len(begin) else np.zeros(0, np.uint64)
            unique, one, which = np.unique(hashes, return_index=True, return_inverse=True)
            new = ~np.isin(unique, known, assume_unique=True)
            if len(known) + int(new.sum()) > REMEMBERED:
                known, tokens, new = known[:0], tokens[:0], np.ones(len(unique), bool)
            every = np.concatenate([known, unique[new]])
            order = np.argsort(every, kind="stable")
            tokens = np.concatenate([tokens, walk.counts(data, begin[one[new]], end[one[new]])])[order]
            known = every[order]
            each = tokens[np.searchsorted(known, unique)][which]
            n = batch.num_rows
            size = text_buffer(batch.column("text"))[1]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(size)), pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array(np.bincount(row, each, n).astype(np.int64))], names=["key", "n_bytes", "n_words", "n_tokens"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n_bytes long, n_words long, n_tokens long").withColumnRenamed("key", key)


def query(spark, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents"))
