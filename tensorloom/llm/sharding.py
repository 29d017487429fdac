"""K-d tree partitioning: shards of near equal bytes, cut at distributed weighted medians.

Every row is a point in metadata space (by default size, checksum and number of characters of its text). A
node that is to hold m shards is cut along its widest dimension, relative to the whole table, where the
share m // 2 / m of its bytes lies to the left. A pass over the points sums the bytes of all nodes of a level by
``RANGES`` ranges of every dimension, whose bounds come from a sample, so that each holds about as many bytes;
the range that holds the cut is looked at again by ``BINS`` parts, until its bytes are below ``TOLERANCE`` of a
shard. The sample decides how many passes there are, not where a cut may lie. What reaches the driver is the
sample, a row for each node and dimension, ``BINS`` sums for each node that is looked at again, and at most ``GATHER``
rows of it in the end. Ties are
ordered by the other dimensions and last by id, so equal texts share a shard unless their group is larger than
the tolerance and lies on a cut.

Defined results: the size is the UTF-8 length (null: none) plus 16; null ids rank below all others; repeated rows are
rows of their own; an empty table gives an empty result. Ids are whole numbers, or text that spells them; other ids raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import forget, numbered, rows_in, stored, table

BINS = 1024
#: Ranges of a dimension, and rows of the sample at most that their bounds come from.
RANGES, SAMPLE = 2048, 200_000
#: Rows of a node that are looked at on the driver at most.
GATHER = 1000
#: Share of a shard's bytes by which a cut may miss its place.
TOLERANCE = 0.002
LEAST = -(1 << 63)
KEY = "__key"


@dataclass
class Node:
    leaves: int
    first: int
    cut: tuple | None = None
    order: tuple = ()
    left: Node | None = None
    right: Node | None = None


def _before(values: list[np.ndarray], cut: tuple) -> np.ndarray:
    """Whether points come before the cut in lexicographic order."""
    out = values[-1] < cut[-1]
    for v, c in reversed(list(zip(values[:-1], cut[:-1]))):
        out = (v < c) | ((v == c) & out)
    return out


def leaf_of(root: Node, columns: dict[str, np.ndarray]) -> np.ndarray:
    """For each point the first shard of the lowest node, as the tree is so far, that it lies in."""
    out = np.zeros(len(columns[KEY]), np.int32)
    todo = [(root, np.arange(len(out)))]
    while todo:
        node, own = todo.pop()
        if node.left is None:
            out[own] = node.first
        elif len(own):
            left = _before([columns[c][own] for c in node.order], node.cut)
            todo += [(node.left, own[left]), (node.right, own[~left])]
    return out


def _points(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of 65,536 rows at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 1 << 16:
            yield {c: np.concatenate([b.column(b.schema.get_field_index(c)).to_numpy() for b in held]) for c in names}
            held, rows = [], 0
    if rows:
        yield {c: np.concatenate([b.column(b.schema.get_field_index(c)).to_numpy() for b in held]) for c in names}


def _bounds(points: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """For each column the lower ends of the ranges, from a sample of bounded size, which the rows' values choose."""
    rows = rows_in(points)
    share = F.pmod(F.xxhash64(*columns, KEY), F.lit(1 << 20)) < (1 << 20) * min(1.0, SAMPLE / max(1, rows))
    sample = points.where(share).select("size", *columns).toPandas()
    ends = []
    for c in columns:
        order = np.argsort(sample[c].to_numpy(), kind="stable")
        value, weight = sample[c].to_numpy()[order], np.cumsum(sample["size"].to_numpy()[order])
        at = np.searchsorted(weight, np.arange(1, RANGES) * (weight[-1] / RANGES)) if len(weight) else np.zeros(0, int)
        ends.append(np.concatenate([[-(1 << 63)], np.unique(value[np.minimum(at, len(value) - 1)])]).astype(np.int64))
    return ends


def _level(points: DataFrame, root: Node, columns: list[str], ends: list[np.ndarray], share: dict[int, float]) -> list:
    """For each node and dimension: bytes, least and greatest value, and of the range in which the wanted share of the bytes
    is reached the bytes up to its end, its own, its rows, and its least and greatest value."""
    read = points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for part in _points(batches, read):
            leaf = leaf_of(root, part)
            for n in np.unique(leaf).tolist():
                if n not in share:
                    continue
                own = np.flatnonzero(leaf == n)
                for d, c in enumerate(columns):
                    if (n, d) not in held:
                        m = len(ends[d])
                        held[n, d] = [np.zeros(m, np.int64), np.zeros(m, np.int64), np.full(m, (1 << 63) - 1, np.int64), np.full(m, -(1 << 63), np.int64)]
                    sums, rows, low, high = held[n, d]
                    value = part[c][own]
                    at = np.searchsorted(ends[d], value, "right") - 1
                    np.add.at(sums, at, part["size"][own])
                    rows += np.bincount(at, minlength=len(rows))
                    np.minimum.at(low, at, value)
                    np.maximum.at(high, at, value)
        for (n, d), (sums, rows, low, high) in held.items():
            at = np.flatnonzero(rows)
            columns_ = [pa.array(np.full(len(at), n, np.int32)), pa.array(np.full(len(at), d, np.int32)), pa.array(at.astype(np.int32)), *[pa.array(x[at]) for x in (sums, rows, low, high)]]
            yield pa.RecordBatch.from_arrays(columns_, names=["n", "d", "b", "w", "rows", "lo", "hi"])

    sums = points.mapInArrow(run, "n int, d int, b int, w long, rows long, lo long, hi long").groupBy("n", "d", "b").agg(F.sum("w").alias("w"), F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # a node and dimension have RANGES rows at most
    own = Window.partitionBy("n", "d")
    wanted = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("n")] * F.sum("w").over(own)
    ranked = sums.select("*", F.sum("w").over(own.orderBy("b")).alias("upto"), wanted.alias("wanted"))
    cut = F.min_by(F.struct("upto", "w", "rows", "lo", "hi"), F.when(F.col("upto") >= F.col("wanted"), F.col("b")))
    return ranked.groupBy("n", "d").agg(F.sum("w").alias("total"), F.min("lo").alias("low"), F.max("hi").alias("high"), cut.alias("cut")).collect()


def _own(part: dict[str, np.ndarray], leaf: np.ndarray, n: int, look: tuple) -> np.ndarray:
    """The points of a node that lie in what is looked at: columns, the values that the first of them are fixed at, bounds of the next."""
    order, fixed, (low, high) = look[:3]
    own = leaf == n
    for c, v in zip(order, fixed):
        own &= part[c] == v
    value = part[order[len(fixed)]]
    return own & (value >= low) & (value <= high)


def _histograms(points: DataFrame, root: Node, looked: dict[int, tuple]) -> list:
    """Bytes and rows by node and part; looked: for each node what ``_own`` takes, and the width of a part."""
    read = points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: np.zeros((2, BINS), np.int64) for n in looked}
        for part in _points(batches, read):
            leaf = leaf_of(root, part)
            for n, look in looked.items():
                own = _own(part, leaf, n, look)
                # differences as unsigned numbers, as the range of a dimension may be wider than a long
                value = part[look[0][len(look[1])]][own].view(np.uint64) - np.array(look[2][0], np.int64).view(np.uint64)
                bins = (value // np.uint64(look[3])).astype(np.int64)
                np.add.at(total[n][0], bins, part["size"][own])
                total[n][1] += np.bincount(bins, minlength=BINS)
        rows = [(n, b, w, k) for n, sums in total.items() for b, (w, k) in enumerate(sums.T.tolist()) if k]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["n", "b", "w", "k"])

    return points.mapInArrow(run, "n int, b int, w long, k long").groupBy("n", "b").agg(F.sum("w").alias("w"), F.sum("k").alias("k")).collect()


def _gathered(points: DataFrame, root: Node, looked: dict[int, tuple]) -> pd.DataFrame:
    """The points in what is looked at, at most ``GATHER`` of each node, with their node as ``n``."""
    read = points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _points(batches, read):
            leaf = leaf_of(root, part)
            for n, look in looked.items():
                own = _own(part, leaf, n, look)
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(own.sum(), n, np.int32)), *[pa.array(part[c][own]) for c in read]], names=["n", *read])

    return points.mapInArrow(run, "n int, " + ", ".join(f"`{c}` long" for c in read)).toPandas()


def _cuts(points: DataFrame, root: Node, orders: dict[int, tuple], bounds: dict[int, dict], wanted: dict[int, float], ranges: dict[int, tuple], slack: float) -> dict[int, tuple]:
    """For each node the point, in its order of columns, before which about the wanted bytes lie.

    bounds: least and greatest value of each column; ranges: of the first column of the order the range that holds
    the cut, as the bytes before it, its own, its rows, its least and greatest value. Once few rows are left, they
    come to the driver and the cut is exact.
    """
    done: dict[int, tuple] = {}
    fixed: dict[int, tuple] = {n: () for n in orders}
    low: dict[int, float] = {n: ranges[n][0] for n in orders}
    span = {n: ranges[n][3:] for n in orders}
    few: set[int] = set()

    def settle(n: int, before: float, weight: float, rows: int, first: int, last: int) -> None:
        """Takes the range from first to last, or looks closer next time."""
        low[n] = before
        rest = (LEAST,) * (len(orders[n]) - len(fixed[n]) - 1)
        if weight <= slack or len(rest) == 0 and first == last:
            done[n] = (*fixed[n], first if wanted[n] - before < before + weight - wanted[n] else last + 1, *rest)
        elif rows <= GATHER:
            span[n] = (first, last)
            few.add(n)
        elif first == last:
            fixed[n] = (*fixed[n], first)
            # columns that have one value in the node need no pass
            while (least := bounds[n][orders[n][len(fixed[n])]])[0] == least[1] and len(fixed[n]) < len(orders[n]) - 1:
                fixed[n] = (*fixed[n], least[0])
            span[n] = least
        else:
            span[n] = (first, last)

    for n in orders:
        settle(n, *ranges[n])
    while active := [n for n in orders if n not in done and n not in few]:
        step = {n: max(1, -(-(span[n][1] - span[n][0] + 1) // BINS)) for n in active}
        sums = _histograms(points, root, {n: (orders[n], fixed[n], span[n], step[n]) for n in active})
        for n in active:
            total = low[n]
            bins = sorted((r.b, r.w, r.k) for r in sums if r.n == n)
            for b, w, rows in bins[:-1]:
                if total + w >= wanted[n]:
                    break
                total += w
            else:
                b, w, rows = bins[-1]
            first = span[n][0] + b * step[n]
            settle(n, total, w, rows, first, min(first + step[n] - 1, span[n][1]))
    if few:
        found = _gathered(points, root, {n: (orders[n], fixed[n], span[n]) for n in few})
        for n in few:
            own = found[found["n"] == n].sort_values(list(orders[n]))
            upto = low[n] + np.concatenate([[0], np.cumsum(own["size"].to_numpy())])
            at = int(np.argmin(np.abs(upto - wanted[n])))
            row = own[list(orders[n])].iloc[min(at, len(own) - 1)].tolist()
            done[n] = (*row[:-1], row[-1] + (at == len(own)))
    return done


def shards(docs: DataFrame, count: int, dimensions: tuple[str, ...], size: str = "size", key: str = "doc_id") -> DataFrame:
    """Adds ``shard`` (0 to count - 1) to each row; dimensions, size and key are whole numbers."""
    names = {d: f"__{i}" for i, d in enumerate(dimensions)}
    ready = docs.drop("shard").select("*", *[F.coalesce(F.col(d).cast("long"), F.lit(LEAST + 1)).alias(a) for d, a in names.items()], F.coalesce(F.col(key).cast("long"), F.lit(LEAST + 1)).alias(KEY))
    points = stored(ready.select(F.col(size).cast("long").alias("size"), *names.values(), KEY), "points")
    columns = list(names.values())
    root = Node(count, 0)
    ends = _bounds(points, columns)
    ids = tuple(points.agg(F.min(KEY), F.max(KEY)).first())
    whole, level = None, [root]
    while level := [n for n in level if n.leaves > 1]:
        found = {(r.n, columns[r.d]): r for r in _level(points, root, columns, ends, {n.first: n.leaves // 2 / n.leaves for n in level})}
        nodes = {n.first: n for n in level if (n.first, columns[0]) in found}
        if not nodes:
            break
        whole = whole or {c: found[0, c] for c in columns}
        orders, wanted, bounds, ranges = {}, {}, {}, {}
        for k, n in nodes.items():
            width = {c: (found[k, c].high - found[k, c].low) / max(1, whole[c].high - whole[c].low) for c in columns}
            widest = max(columns, key=lambda c: (width[c], -columns.index(c)))
            orders[k] = (widest, *[c for c in columns if c != widest], KEY)
            bounds[k] = {c: (found[k, c].low, found[k, c].high) for c in columns} | {KEY: ids}
            wanted[k] = found[k, widest].total * (n.leaves // 2) / n.leaves
            cut = found[k, widest].cut
            ranges[k] = (cut.upto - cut.w, cut.w, cut.rows, cut.lo, cut.hi)
        cuts = _cuts(points, root, orders, bounds, wanted, ranges, TOLERANCE * whole[columns[0]].total / count)
        level = []
        for k, n in nodes.items():
            half = n.leaves // 2
            n.order, n.cut = orders[k], cuts[k]
            n.left, n.right = Node(half, n.first), Node(n.leaves - half, n.first + half)
            level += [n.left, n.right]
    forget(points)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (*columns, KEY)}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf_of(root, own))], names=[*batch.schema.names, "shard"])

    return ready.mapInArrow(placed, f"{fields}, shard int").drop(*columns, KEY)


def query(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.char_length(text).cast("long").alias("chars"))
    dealt = shards(stored(docs, "sizes"), 40, ("size", "text_crc32", "chars")).drop("chars")
    out = numbered(stored(dealt, "dealt"), "shard", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
