"""Near duplicates by MinHash: universal hash minima, banding, signature check, full-set check, components.

1. One pass over the texts gives each document the size and a digest of its set of word shingles, ``HASHES``
   minima of universal hashes (their lowest byte is kept as signature) and ``BANDS`` band keys of ``ROWS`` minima.
2. Equal sets collapse to the smallest id of theirs, so copies cost one row.
3. In each band bucket every document is paired with one centre; pairs whose signatures disagree too much
   go, the rest is confirmed on full sets, the likeliest first, and pairs inside one component are skipped.
4. Buckets that still hold two components are searched in full, except inside components: small ones by
   pairs, larger ones in blocks of bounded size, so that no link is lost and no task sees a whole bucket.
5. Components come from alternating large-star and small-star.

Joins whose keys may be frequent (a band, a centre, a root, the digest of a text with many copies) go through
``spread``, which deals the rows of a frequent key to several tasks.

A pair at the threshold shares no band with probability (1 - 0.8**4)**24 = 3e-6; the signature check passes
it unless fewer than 59 of 96 minima agree, 4.5 standard deviations below the mean.

Defined results: words are runs of bytes other than ASCII white space, after lower-casing A-Z; a text of
fewer words than a shingle is one shingle; null and wordless texts have no shingles and link with nothing;
rows with a null id link with nothing and are kept; a repeated row gets its result once for each time it occurs;
an id that occurs with several texts links what any of them links. Ids are whole numbers, or text that spells them;
other ids raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import LOWER, MOST_IDS, forget, frequent, mixed, often, pieces, rows_in, span_hashes, spread, stored, text_buffer, words_of

ROWS, BANDS = 4, 24
HASHES = ROWS * BANDS
#: Least number of agreeing minima for a pair to be confirmed on full sets, at a threshold of 80 percent.
AGREE = 59
#: Buckets of up to so many documents are searched by pairs, larger ones in blocks of so many rows and bytes of sets.
SMALL, BLOCK, BLOCK_BYTES = 64, 256, 16_000_000
#: Up to so many edges (16 bytes each) a step of the components runs in one task, without a shuffle; beyond, it is distributed.
ONE_TASK = 1 << 17

_seed = np.random.default_rng(20240229)
FACTOR = _seed.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
OFFSET = _seed.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each row."""
    begin, end, row = words_of(data, starts)
    words = span_hashes(LOWER[data], begin, end) if len(begin) else np.zeros(0, np.uint64)
    first = np.searchsorted(row, np.arange(len(starts)))
    folded = words.copy()
    for k in range(1, width):
        folded = mixed(folded[: max(0, len(words) - k)] * np.uint64(3) + words[k:])
    out = []
    for i in range(len(starts) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            out.append(np.unique(folded[a : b - width + 1]))
        elif b > a:
            one = words[a : a + 1]
            for k in range(a + 1, b):
                one = mixed(one * np.uint64(3) + words[k])
            out.append(mixed(one ^ np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 4096):
        np.minimum(out, (short[None, i : i + 4096] * FACTOR[:, None] + OFFSET[:, None]).min(1), out=out)
    return out


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = shingle_sets(*text_buffer(batch.column("text")), width)
            n = len(sets)
            mins = np.zeros((n, HASHES), np.uint32)
            digest = np.zeros((n, 2), np.uint64)
            for i, s in enumerate(sets):
                mins[i] = minima(s)
                digest[i] = mixed(s ^ np.uint64(0x5BD1E995)).sum(), mixed(s + np.uint64(0x1B873593)).sum()
            keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
            for r in range(ROWS):
                keys = mixed(keys * np.uint64(5) + mins[:, r::ROWS])
            signs = np.ascontiguousarray(mins.astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digest[:, 0].view(np.int64)),
                    pa.array(digest[:, 1].view(np.int64)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * HASHES, HASHES, dtype=np.int32)), pa.py_buffer(signs)]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel())),
                ],
                names=["id", "n", "d1", "d2", "sig", "bands"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = shingle_sets(*text_buffer(batch.column("text")), width)
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], names=["id", "set"])

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, other = (text_buffer(batch.column(c))[0].reshape(-1, HASHES) for c in ("sx", "sc"))
        same = (one == other).sum(1).astype(np.int32)
        keep = pa.array(same >= AGREE)
        yield pa.RecordBatch.from_arrays([batch.column("x").filter(keep), batch.column("c").filter(keep), pa.array(same).filter(keep)], names=["x", "c", "est"])


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for each node that isn't the smallest of its component; edges: (u, v) of longs. Alternates large-star and small-star."""

    def written(pairs: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        out = stored(pairs.distinct().observe(seen, F.bit_xor(F.xxhash64("u", "v")).alias("x")), "star")
        return out, seen.get | {"n": rows_in(out)}

    now, state = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"))
    while state["n"]:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        few = state["n"] <= ONE_TASK
        if few:
            both = both.coalesce(1)
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        if few:
            met = both.join(least, "u")
        else:
            least = stored(least, "least")
            hubs = least.where(F.col("n") > often(2 * state["n"])).select("u", F.col("n").alias("m"))
            met = spread(both, least.drop("n").withColumnRenamed("m", "to"), "u", "v", hubs).withColumnRenamed("to", "m")
        large = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # a node has few smaller neighbours by now: each is the least of one of its neighbours
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = state
        after, state = written(small.union(lowest.toDF("u", "v")).coalesce(1) if few else small.union(lowest.toDF("u", "v")))
        forget(now)
        if not few:
            forget(least)
        now = after
        if state == before:
            break
    out = now.withColumnRenamed("v", "root")
    out._stored_at = now._stored_at
    return out


class _Search:
    """What the steps of one call share."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs, width, percent
        self.roots: DataFrame | None = None

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, set) of the documents with these ids."""
        ids = stored(ids.distinct(), "ids")
        picked = F.broadcast(ids) if rows_in(ids) <= MOST_IDS else ids
        texts = self.docs.join(picked, "id", "left_semi")
        out = stored(texts.mapInArrow(_sets(self.width), "id long, set array<long>"), "sets")
        if rows_in(out) > rows_in(ids):  # repeated rows
            every, out = out, stored(out.distinct(), "sets")
            forget(every)
        forget(ids)
        return out

    def confirm(self, pairs: DataFrame) -> None:
        """Adds the links among the pairs (x, c), a written table, and brings the components up to date."""
        sets = self.sets(pairs.select(F.col("x").alias("id")).union(pairs.select("c")))
        hot = frequent(pairs, "c", rows_in(pairs))
        met = spread(pairs.select("x", "c"), sets.select(F.col("id").alias("c"), F.col("set").alias("s2")), "c", "x", hot)
        met = met.join(sets.select(F.col("id").alias("x"), F.col("set").alias("s1")), "x")
        both = F.size(F.array_intersect("s1", "s2"))
        linked = met.where(both * 100 >= self.percent * (F.size("s1") + F.size("s2") - both))
        self.linked(linked.select(F.col("x").alias("u"), F.col("c").alias("v")))
        forget(sets)

    def linked(self, edges: DataFrame) -> None:
        """Merges the components that the edges join; only their roots take part."""
        if self.roots is None:
            self.roots = components(edges)
            return
        edges = stored(edges, "edges")
        rows = rows_in(edges)
        if not rows:
            forget(edges)
            return
        ends = self.rooted(self.rooted(edges, "u", "ru", "v", frequent(edges, "u", rows)), "v", "rv", "u", frequent(edges, "v", rows))
        ends = stored(ends.select(F.col("ru").alias("u"), F.col("rv").alias("v")).where("u <> v").distinct(), "links")
        merged = components(ends)
        forget(edges)
        forget(ends)
        old = self.roots
        moved = spread(old, merged.select(F.col("u").alias("root"), F.col("root").alias("to")), "root", "u", frequent(old, "root", rows_in(old)), "left")
        self.roots = stored(moved.select("u", F.coalesce("to", "root").alias("root")).union(merged), "roots")
        forget(old)
        forget(merged)

    def rooted(self, df: DataFrame, name: str, root: str, by: str = "", hot: DataFrame | None = None) -> DataFrame:
        """Adds the root of the column's node; hot: frequent nodes of the column, whose rows ``by`` tells apart."""
        if self.roots is None:
            return df.withColumn(root, F.col(name))
        met = spread(df, self.roots.select(F.col("u").alias(name), F.col("root").alias(f"_{root}")), name, by, hot, "left")
        return met.withColumn(root, F.coalesce(f"_{root}", name)).drop(f"_{root}")

    def resolve(self, pairs: DataFrame, leaders: DataFrame, steps: tuple[int, ...]) -> None:
        """Confirms all pairs (x, c, nx, nc) that may be links, except those inside a component by then."""
        near = stored(pairs.where(F.least("nx", "nc") * 100 >= self.percent * F.greatest("nx", "nc")).select("x", "c").distinct(), "near")
        signs = leaders.select("id", "sig")
        met = spread(near, signs.toDF("c", "sc"), "c", "x", frequent(near, "c", rows_in(near))).join(signs.toDF("x", "sx"), "x")
        likely = met.select("x", "c", "sx", "sc").mapInArrow(_agreeing, "x long, c long, est int")
        order = Window.partitionBy("x").orderBy(F.desc("est"), "c")
        ranked = stored(likely.withColumn("rank", F.row_number().over(order)), "pairs")
        forget(near)
        hot, low = frequent(ranked, "c", rows_in(ranked)), 0
        for high in (*steps, None):
            part = ranked.where((F.col("rank") > low) & (F.col("rank") <= high if high else F.lit(True)))
            part = stored(self.rooted(self.rooted(part, "x", "rx"), "c", "rc", "x", hot).where("rx <> rc").select("x", "c"), "open")
            if rows_in(part):
                self.confirm(part)
            forget(part)
            low = high
        forget(ranked)

    def divided(self, near: DataFrame) -> DataFrame:
        """The rows of the buckets that hold more than one component, with their root and the bucket's largest component."""
        placed = self.rooted(near.select("key", "id", "n"), "id", "root")
        counts = placed.groupBy("key", "root").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
        several = counts.groupBy("key").agg(
            F.count("*").alias("roots"), F.max_by("root", F.struct("k", "root")).alias("main"), F.max_by("w", F.struct("k", "root")).alias("w_main"),
            F.max("k").alias("n_main"), F.sum("k").alias("n_all"), F.sum("w").alias("w_all"),
        )
        several = stored(several.where("roots > 1").drop("roots"), "several")
        rows = several.agg(F.sum("n_all")).first()[0] or 0
        out = spread(placed, several, "key", "id", several.where(F.col("n_all") > often(rows)).select("key", F.col("n_all").alias("m")))
        out = stored(out, "open")
        forget(several)
        return out

    def across(self, large: DataFrame, leaders: DataFrame) -> None:
        """Searches divided buckets in blocks: rows outside the largest component against all others.

        A block holds signatures alone; only documents that it can't tell apart by them come with their sets,
        to blocks of bounded bytes.
        """

        def parts(rows: Column, bytes_: Column) -> Column:
            return F.greatest(F.ceil(rows / BLOCK), F.ceil(bytes_ * 8 / BLOCK_BYTES), F.lit(1)).cast("int")

        blocks = parts(F.col("n_main"), F.col("w_main"))
        chunks = parts(F.col("n_all") - F.col("n_main"), F.col("w_all") - F.col("w_main"))
        own = F.xxhash64("id")
        here = F.pmod(own, chunks).cast("int")

        def place(i, j, side, kind):
            return F.struct(i.alias("i"), j.alias("j"), side.alias("side"), F.lit(kind).alias("kind"))

        main = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: place(F.pmod(own, blocks).cast("int"), j, F.lit(0), 0))
        rest = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: place(i, here, F.lit(1), 0))
        apart = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: place(F.least(here, j), F.greatest(here, j), (j < here).cast("int"), 1))
        signed = large.join(leaders.select("id", "sig"), "id")  # a document has as many rows as bands at most
        dealt = signed.select("key", "id", "root", "sig", F.explode(F.when(F.col("root") == F.col("main"), main).otherwise(F.concat(rest, apart))).alias("at")).select("key", "id", "root", "sig", "at.*")
        block = "key", "i", "j", "kind"
        alike = stored(dealt.groupBy(*block).applyInPandas(_alike, "key long, i int, j int, kind int, id long, root long, sig binary, side int"), "alike")
        if rows_in(alike):
            sets = self.sets(alike.select("id"))
            full = spread(alike, sets, "id", list(block), frequent(alike, "id", rows_in(alike)))
            self.linked(full.groupBy(*block).applyInPandas(_across(self.percent), "u long, v long").distinct())
            forget(sets)
        forget(alike)


def _likely(group: pd.DataFrame) -> list[tuple[int, int, int]]:
    """(minus the agreeing minima, i, j) of the pairs of rows that may be links between components: of those with side 0 to those with side 1, or among all if there is one side."""
    signs = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(-1, HASHES)
    side, roots = group["side"].to_numpy(), group["root"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    pairs = []
    among = not len(right)
    others = left if among else right
    for k in range(0, len(left), 32):
        own = left[k : k + 32]
        ok = roots[own][:, None] != roots[others][None]
        if among:
            ok &= others[None] > own[:, None]
        same = np.zeros(ok.shape, np.int32)
        if ok.any():
            same[:] = (signs[own][:, None] == signs[others][None]).sum(2)
        i, j = np.nonzero(ok & (same >= AGREE))
        pairs += zip((-same[i, j]).tolist(), own[i].tolist(), others[j].tolist())
    return pairs


def _alike(group: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block that may link with another one of it."""
    rows = sorted({k for _, i, j in _likely(group) for k in (i, j)})
    return group.iloc[rows][["key", "i", "j", "kind", "id", "root", "sig", "side"]]


def _across(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links between different components in a block."""
        ids, sets = group["id"].to_numpy(), group["set"].tolist()
        root = {r: r for r in group["root"]}
        roots = group["root"].to_numpy()

        def top(r):
            while root[r] != r:
                root[r] = r = root[root[r]]
            return r

        found = []
        for _, i, j in sorted(_likely(group)):
            a, b = top(roots[i]), top(roots[j])
            if a != b:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both * 100 >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[max(a, b)] = min(a, b)
                    found.append((ids[i], ids[j]))
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return run


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id_column, n_shingles, component_id, kept) for each row of docs; the bands and ``AGREE`` find the pairs from 80 percent up."""
    if not 80 <= percent <= 100:
        raise ValueError(f"percent must be from 80 to 100, not {percent}: bands and signature check would lose links below 80")
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    base = stored(source.mapInArrow(_sketch(width), "id long, n long, d1 long, d2 long, sig binary, bands array<long>"), "sketch")
    search = _Search(source, width, percent)
    # equal sets have equal sizes, signatures and bands, so any row's will do
    same = base.where("n > 0 AND id IS NOT NULL").groupBy("d1", "d2")
    firsts = stored(same.agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "firsts")
    leaders = firsts.select("id", "n", "sig", "bands")
    keyed = leaders.select("id", "n", F.explode("bands").alias("key"))
    centre = F.min_by(F.struct("id", "n"), F.xxhash64("id", "key"))
    buckets = stored(keyed.groupBy("key").agg(F.count("*").alias("size"), centre.alias("centre")).where("size > 1"), "buckets")
    near = stored(spread(keyed, buckets, "key", "id", buckets.where(F.col("size") > often(BANDS * rows_in(firsts))).select("key", F.col("size").alias("m"))), "near")
    forget(buckets)
    search.resolve(near.where("id <> centre.id").select(F.col("id").alias("x"), F.col("centre.id").alias("c"), F.col("n").alias("nx"), F.col("centre.n").alias("nc")), leaders, (1,))

    small = search.divided(near.where(F.col("size") <= SMALL))
    pairs = small.select("key", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx")).join(small.select("key", F.col("id").alias("c"), F.col("n").alias("nc"), F.col("root").alias("rc")), "key")
    search.resolve(pairs.where(f"x > c AND rx <> rc AND least(nx, nc) * 100 >= greatest(nx, nc) * {percent}").select("x", "c", "nx", "nc"), leaders, ())
    large = search.divided(near.where(F.col("size") > SMALL))
    if rows_in(large):
        search.across(large, leaders)

    # each set finds its component, then each row its set; rows of the most copied sets find it by broadcast
    most = often(rows_in(base))
    placed = stored(search.rooted(firsts.select("d1", "d2", "id", "copies"), "id", "component").drop("id"), "placed")
    hot = F.broadcast(placed.where(F.col("copies") > most).drop("copies"))
    rows = base.select("id", "n", "d1", "d2")
    linked = rows.where("n > 0 AND id IS NOT NULL")
    often_copied = linked.join(hot, ["d1", "d2"])
    others = linked.join(hot, ["d1", "d2"], "left_anti").join(placed.where(F.col("copies") <= most).drop("copies"), ["d1", "d2"])
    alone = rows.where("n = 0 OR id IS NULL").withColumn("component", F.col("id"))
    final = alone.unionByName(often_copied).unionByName(others)
    for gone in (firsts, near, small, large):
        forget(gone)
    return final.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    from tensorloom.llm.common import table

    return classes(table(spark, sf_dir, "documents"), width=2)
