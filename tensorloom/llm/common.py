"""Shared pieces of the training-data operators: written tables, text buffers, hashes, ranks."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of an Arrow batch at most, unless the session sets another number: texts may be long, and batches lie outside the heap.
BATCH_ROWS = 1000
_rows_key = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(_rows_key, None) is None:
        spark.conf.set(_rows_key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, as in tests, a local master gets a
    folder of its own; on a cluster that is an error, as executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + (own := tempfile.mkdtemp(prefix="tensorloom-"))
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of the tables that ``stored`` wrote and nothing deleted yet, and how many rows each has.
_tables: list[str] = []
_rows: dict[str, int | None] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder as Parquet and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tensorloom/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    _tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _rows[path] = seen.get.get("n")
    out._stored_at = path
    return out


def rows_in(df: DataFrame) -> int:
    """The number of rows of a table, which ``stored`` has counted as it wrote it."""
    n = _rows.get(getattr(df, "_stored_at", None))
    return df.count() if n is None else n


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def forget(df: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path in _rows:
        _delete(df.sparkSession, path)
        _tables.remove(path)
        del _rows[path]


def mark() -> int:
    """A place in the list of tables, for ``release``."""
    return len(_tables)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables written since a mark: results that still read them must be written or collected by then."""
    for path in _tables[since:]:
        _delete(spark, path)
        del _rows[path]
    del _tables[since:]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and where each row starts (one more at the end); null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, starts, data = column.buffers()
    at = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps Python workers for later tasks, and what each holds on to would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``most`` text bytes, one row at least: what a task holds at once stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, starts = text_buffer(batch.column(column))
        first = 0
        while first < batch.num_rows:
            end = max(first + 1, int(np.searchsorted(starts, starts[first] + most, "right")) - 1)
            yield batch.slice(first, end - first)
            first = end
    give_back()


M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(33))
    x = x * M1
    x ^= x >> np.uint64(33)
    x *= M2
    x ^= x >> np.uint64(33)
    return x


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
CODE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, each from a polynomial over random byte codes modulo 2**64."""
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(CODE[codes] * powers(BASE, len(codes)), out=total[1:])
    return mixed((total[ends] - total[starts]) * powers(INVERSE, len(codes) + 1)[starts] + (ends - starts).astype(np.uint64))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that aren't white space, and the index of its row; a run ends with its row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    row_start = starts[:-1][starts[:-1] < len(data)]
    first[row_start] = inside[row_start]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    row_end = starts[1:][starts[1:] > 0] - 1
    last[row_end] = inside[row_end]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(starts, begin, "right") - 1


def numbered(df: DataFrame, group: str, slot: str) -> DataFrame:
    """Adds ``slot``, a rank without gaps from 0 in each group, though no task sees a whole group.

    df must be a written table (``stored``): its rows are counted by partition and group, the counts are
    summed up over the partitions, and each partition numbers its own rows from its sum.
    """
    part = f"__{slot}_part"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def count_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: dict = {}
        here = TaskContext.get().partitionId()
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            if not len(values):
                continue
            order = np.argsort(values, kind="stable")
            keys, first, n = np.unique(values[order], return_index=True, return_counts=True)
            rank = np.empty(len(values), np.int64)
            base = np.array([seen.get(k, 0) for k in keys.tolist()], np.int64)
            rank[order] = np.arange(len(values)) - np.repeat(first, n) + np.repeat(base, n)
            for k, b, c in zip(keys.tolist(), base.tolist(), n.tolist()):
                seen[k] = b + c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(values), here, np.int32)), pa.array(rank)], names=[*batch.schema.names, part, slot])

    local = stored(df.mapInArrow(count_within, f"{fields}, `{part}` int, `{slot}` long"), "ranks")
    counts = local.groupBy(group, part).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(group, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return local.join(base, [group, part]).withColumn(slot, F.col(slot) + F.col("__base")).drop(part, "__base")


def crc_of_id(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(column: str = "doc_id") -> Column:
    return (crc_of_id(column) % 3) == 1


def rows_where(docs: DataFrame, keep, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose texts ``keep`` (a function of a list of texts) marks as true."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            yield batch.filter(pa.array(np.asarray(keep(batch.column(text).to_pylist()), bool)))

    return docs.mapInArrow(run, fields)


#: Up to so many ids (8 bytes each) are broadcast; beyond, they are joined by a shuffle.
MOST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key isn't among the ids, a written table with that one column."""
    return docs.join(F.broadcast(ids) if rows_in(ids) <= MOST_IDS else ids, key, "left_anti")


#: Rows of one key that a task gets at least before they are dealt to several, and keys that may be so at most (some 32 bytes each).
HOT, MOST_HOT = 256, 200_000


def often(rows: int) -> int:
    """Beyond how many rows on a key it counts as frequent: of so many rows at most ``MOST_HOT`` keys are."""
    return max(HOT, rows // MOST_HOT)


def frequent(df: DataFrame, key: str, rows: int) -> DataFrame | None:
    """The frequent keys of df, which has so many rows, and ``m``, how often each occurs; None if there can be none."""
    return df.groupBy(key).agg(F.count("*").alias("m")).where(F.col("m") > often(rows)) if rows > HOT else None


def spread(left: DataFrame, right: DataFrame, key: str, by: str | list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left joined with right, which has a row for each key, without a task that gets all rows of a frequent key.

    hot: the frequent keys of left (see ``frequent``); their rows of right are repeated, and left's are dealt
    among them by the columns ``by``.
    """
    if hot is None:
        return left.join(right, key, how)
    parts = F.ceil(F.coalesce("m", F.lit(1)) / HOT).cast("int")
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(*[by] if isinstance(by, str) else by), parts).cast("int")).drop("m")
    repeated = right.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("m")
    return dealt.join(repeated, [key, "_part"], how).drop("_part")
