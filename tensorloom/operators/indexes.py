"""Indexes as laid-out tables: buckets for equality, sorted ranges for intervals, postings for shapes and properties.

An index is a folder of Parquet parts whose layout lets Spark skip files: equality lookups read one bucket folder
(partition pruning), intervals read the row groups whose least and greatest values meet them (the rows are range
partitioned and sorted). Inserts add parts, removals add tombstones that a lookup takes out by an anti-join, and
``compacted`` writes both together again. Nothing is kept in memory; all parts lie in the folder that the caller
names, which has to be shared.

Common to all: ``insert``, ``remove``, ``search``, ``rows`` and ``statistics``. Entries are (key, value...) rows;
what the key is (a tensor id, a record) is the caller's choice. Null values are found by no test but the full scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators import search

BUCKET = "_bucket"


class Index:
    """Parts of (key, columns...) under a folder, and tombstones of keys; a tombstone removes what was inserted before it."""

    def __init__(self, spark: SparkSession, folder: str, key: str, columns: dict[str, str], key_type: str = "bigint"):
        self.spark, self.folder, self.key, self.columns = spark, folder.rstrip("/"), key, columns
        self.schema = ", ".join([f"`{key}` {key_type}", *[f"`{c}` {t}" for c, t in columns.items()], "_batch int"])
        self.key_type, self.batches, self.lookups = key_type, 0, 0

    # layout: what subclasses differ in

    def laid_out(self, entries: DataFrame) -> tuple[DataFrame, list[str]]:
        """The entries in the order and number of files they are written in, and the columns that become folders."""
        return entries, []

    def where(self, rows: DataFrame, **wanted) -> DataFrame:
        raise NotImplementedError

    # common

    def insert(self, entries: DataFrame) -> None:
        self.batches += 1
        laid, folders = self.laid_out(entries.select(self.key, *self.columns).withColumn("_batch", F.lit(self.batches)))
        laid.write.mode("append").partitionBy(*folders).parquet(f"{self.folder}/rows")

    def remove(self, keys: DataFrame) -> None:
        self.batches += 1
        keys.select(F.col(self.key).cast(self.key_type).alias(self.key)).withColumn("_batch", F.lit(self.batches)).write.mode("append").parquet(f"{self.folder}/gone")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _parts(self) -> DataFrame:
        schema = self.schema + (f", {BUCKET} int" if isinstance(self, HashIndex) else "")
        if not self._exists("rows"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/rows")

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Takes out what a later tombstone removes; only the rows found so far take part."""
        if self._exists("gone"):
            gone = self.spark.read.schema(f"`{self.key}` {self.key_type}, _batch int").parquet(f"{self.folder}/gone").groupBy(self.key).agg(F.max("_batch").alias("_until"))
            rows = rows.join(gone, self.key, "left").where("_until IS NULL OR _until < _batch")
        return rows.select(self.key, *self.columns)

    def rows(self) -> DataFrame:
        return self._alive(self._parts())

    def search(self, **wanted) -> DataFrame:
        self.lookups += 1
        return self._alive(self.where(self._parts(), **wanted))

    def full_scan(self, **wanted) -> DataFrame:
        """Equality on every attribute without regard to the layout."""
        return self.rows().where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in wanted.items()], F.lit(True)))

    def statistics(self) -> DataFrame:
        """(index, entries, keys, distinct values, lookups)."""
        values = F.count_distinct(*self.columns)
        return self.rows().agg(F.count("*").alias("entries"), F.count_distinct(self.key).alias("keys"), values.alias("values")).select(F.lit(type(self).__name__).alias("index"), "entries", "keys", "values", F.lit(self.lookups).alias("lookups"))

    def compacted(self, folder: str) -> Index:
        """The live entries as a new index in one batch."""
        out = type(self).__new__(type(self))
        out.__dict__.update(self.__dict__ | {"folder": folder.rstrip("/"), "batches": 0, "lookups": 0})
        out.insert(self.rows())
        return out

    def backup(self, folder: str, name: str) -> None:
        """The live entries under a name; ``restored`` reads them, ``prune`` deletes old ones."""
        self.rows().write.parquet(f"{folder.rstrip('/')}/{name}")

    def restored(self, folder: str, name: str, to: str) -> Index:
        """A new index in the folder ``to`` with the entries of a backup."""
        out = type(self).__new__(type(self))
        out.__dict__.update(self.__dict__ | {"folder": to.rstrip("/"), "batches": 0, "lookups": 0})
        out.insert(self.spark.read.parquet(f"{folder.rstrip('/')}/{name}"))
        return out


def prune(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Deletes all backups of a folder but the last ``keep`` by name; returns the names that are left."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    for name in names[: max(0, len(names) - keep)]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}"), True)
    return names[max(0, len(names) - keep) :]


def maintained(index: Index, folder: str, tombstones: int = 10_000) -> Index:
    """The index, written anew in the folder if more than so many tombstones slow it down."""
    if not index._exists("gone") or index.spark.read.parquet(f"{index.folder}/gone").count() <= tombstones:
        return index
    return index.compacted(folder)


class HashIndex(Index):
    """Equality on one or several columns; the first ones given decide the bucket folder."""

    def __init__(self, spark: SparkSession, folder: str, key: str, columns: dict[str, str], buckets: int = 16, key_type: str = "bigint"):
        super().__init__(spark, folder, key, columns, key_type)
        self.buckets = buckets

    def _bucket(self, values: list[Column]) -> Column:
        # a null in any column is a value of its own here; the tests of search never find it
        return F.pmod(F.xxhash64(*[F.coalesce(v.cast("string"), F.lit("")) for v in values]), F.lit(self.buckets)).cast("int")

    def laid_out(self, entries: DataFrame) -> tuple[DataFrame, list[str]]:
        bucketed = entries.withColumn(BUCKET, self._bucket([F.col(c) for c in self.columns]))
        # many rows of one value are dealt to several files of its folder
        return bucketed.repartition(F.col(BUCKET), F.pmod(F.xxhash64(self.key), F.lit(4))), [BUCKET]

    def where(self, rows: DataFrame, **wanted) -> DataFrame:
        test = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v).cast(self.columns[c]) for c, v in wanted.items()])
        if set(wanted) == set(self.columns):
            values = [F.lit(wanted[c]).cast(t) for c, t in self.columns.items()]
            bucket = self.spark.range(1).select(self._bucket(values)).first()[0]
            test = (F.col(BUCKET) == bucket) & test
        return rows.where(test)


class CompositeIndex(HashIndex):
    """Equality on a tuple of columns, where None in a query stands for any value.

    The bucket comes from the first column alone, so a query that knows it still reads one folder.
    """

    def laid_out(self, entries: DataFrame) -> tuple[DataFrame, list[str]]:
        bucketed = entries.withColumn(BUCKET, self._bucket([F.col(next(iter(self.columns)))]))
        return bucketed.repartition(F.col(BUCKET), F.pmod(F.xxhash64(self.key), F.lit(4))), [BUCKET]

    def where(self, rows: DataFrame, **wanted) -> DataFrame:
        known = {c: v for c, v in wanted.items() if v is not None}
        out = rows.where(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v).cast(self.columns[c]) for c, v in known.items()], F.lit(True)))
        first = next(iter(self.columns))
        if first in known:
            bucket = self.spark.range(1).select(self._bucket([F.lit(known[first]).cast(self.columns[first])])).first()[0]
            out = out.where(F.col(BUCKET) == bucket)
        return out


class RangeIndex(Index):
    """Intervals, points and counts on one column, range-partitioned and sorted on writing; later batches are sorted parts of their own."""

    def __init__(self, spark: SparkSession, folder: str, key: str, column: str, kind: str = "double", files: int = 8, key_type: str = "bigint"):
        super().__init__(spark, folder, key, {column: kind}, key_type)
        self.column, self.files = column, files

    def laid_out(self, entries: DataFrame) -> tuple[DataFrame, list[str]]:
        # the key is part of the range, so that a value with many rows spreads over several files
        return entries.repartitionByRange(self.files, self.column, self.key).sortWithinPartitions(self.column, self.key), []

    def where(self, rows: DataFrame, low=None, high=None, include_low: bool = True, include_high: bool = True, equals=None) -> DataFrame:
        x = F.col(self.column)
        if equals is not None:
            return rows.where(x == equals)
        out = rows.where(x.isNotNull())
        if low is not None:
            out = out.where(x >= low if include_low else x > low)
        if high is not None:
            out = out.where(x <= high if include_high else x < high)
        return out

    def lookup(self, value) -> DataFrame:
        return self.search(equals=value)

    def range(self, low, high) -> DataFrame:
        """Both ends included."""
        return self.search(low=low, high=high)

    def range_count(self, low, high) -> DataFrame:
        return self.range(low, high).agg(F.count("*").alias("n"))


class PropertyIndex(RangeIndex):
    """A property that an expression or a function of (data, shape) gives, computed once when rows come in."""

    def __init__(self, spark: SparkSession, folder: str, key: str, name: str, extract: Column | Callable[[Column, Column], Column], files: int = 8, key_type: str = "bigint"):
        super().__init__(spark, folder, key, name, "double", files, key_type)
        self.extract = extract

    def insert(self, entries: DataFrame) -> None:
        if self.column in entries.columns:
            return super().insert(entries)
        value = self.extract if isinstance(self.extract, Column) else self.extract(F.col("data"), F.col("shape"))
        return super().insert(entries.withColumn(self.column, value.cast("double")))


class SpatialIndex(Index):
    """Shapes: by exact shape, number of dimensions, number of elements, and the ratio of the longest to the shortest side."""

    def __init__(self, spark: SparkSession, folder: str, key: str, key_type: str = "bigint"):
        super().__init__(spark, folder, key, {"shape": "array<bigint>", "ndim": "int", "elements": "bigint", "aspect": "double"}, key_type)

    def insert(self, entries: DataFrame) -> None:
        shape = F.col("shape").cast("array<bigint>")
        elements = F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, d: a * d)
        super().insert(entries.select(self.key, shape.alias("shape"), F.size(shape).alias("ndim"), elements.alias("elements"), F.try_divide(F.array_max(shape), F.array_min(shape)).alias("aspect")))

    def laid_out(self, entries: DataFrame) -> tuple[DataFrame, list[str]]:
        return entries.repartitionByRange(4, "ndim", "elements", self.key).sortWithinPartitions("ndim", "elements"), []

    def where(self, rows: DataFrame, shape: list[int] | None = None, ndim: int | None = None, elements: tuple[int, int] | None = None, aspect: tuple[float, float] | None = None) -> DataFrame:
        out = rows
        if shape is not None:
            size = 1
            for d in shape:
                size *= d
            # the numbers prune files, the list decides
            out = out.where((F.col("ndim") == len(shape)) & (F.col("elements") == size))
            out = out.where(F.col("shape") == (F.array(*[F.lit(d).cast("bigint") for d in shape]) if shape else F.array().cast("array<bigint>")))
        if ndim is not None:
            out = out.where(F.col("ndim") == ndim)
        if elements is not None:
            out = out.where(F.col("elements").between(*elements))
        if aspect is not None:
            out = out.where(F.col("aspect").between(*aspect))
        return out


class PostingIndex(Index):
    """Tokens of texts, sorted by token; a document that comes again replaces its earlier version."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", key_type: str = "bigint"):
        super().__init__(spark, folder, key, {"token": "string", "n": "bigint"}, key_type)

    def insert(self, entries: DataFrame, text: str = "text") -> None:
        if text not in entries.columns:  # postings already
            return super().insert(entries)
        if self._exists("rows"):
            self.remove(entries.select(self.key))
        super().insert(search.counted_tokens(entries, text, self.key))  # laid_out sorts them

    def laid_out(self, entries: DataFrame) -> tuple[DataFrame, list[str]]:
        return entries.repartitionByRange("token", self.key).sortWithinPartitions("token", self.key), []

    def where(self, rows: DataFrame, query: str = "") -> DataFrame:
        return rows.where(F.col("token").isin(search.query_tokens(query)))

    def scores(self, query: str) -> DataFrame:
        """(key, score) as ``search.full_text`` has them."""
        return search.posting_search(self.search(query=query), query, self.key)


class QueryBuilder:
    """Conditions on several indexes: the keys that all of them find, or any of them.

    ``cost`` orders the indexes by the rows that a condition is likely to leave (equalities before intervals before
    shapes), so that the intersections begin with the smallest tables.
    """

    _cost = {HashIndex: 0, CompositeIndex: 1, RangeIndex: 2, PropertyIndex: 2, SpatialIndex: 3}

    def __init__(self, key: str):
        self.key, self.conditions = key, []

    def given(self, index: Index, **wanted) -> QueryBuilder:
        self.conditions.append((index, wanted))
        return self

    def plan(self) -> list[str]:
        """The order in which the conditions are looked up."""
        return [f"{type(i).__name__}({', '.join(w)})" for i, w in self._ordered()]

    def _ordered(self) -> list[tuple[Index, dict]]:
        return sorted(self.conditions, key=lambda c: self._cost.get(type(c[0]), 9))

    def execute(self) -> DataFrame:
        """The keys that meet all conditions, each once; without conditions there is nothing to look up."""
        found = [i.search(**w).select(self.key) for i, w in self._ordered()]
        if not found:
            raise ValueError("a query needs a condition")
        return reduce(lambda a, b: a.join(b, self.key, "left_semi"), found).distinct()

    def execute_any(self) -> DataFrame:
        """The keys that meet one condition at least, each once."""
        found = [i.search(**w).select(self.key) for i, w in self._ordered()]
        return reduce(lambda a, b: a.union(b), found).distinct()


def folder_for(spark: SparkSession, name: str) -> str:
    """A new folder for an index under the folder that all executors share."""
    from tensorloom.sources.cut import shared_folder

    return f"{shared_folder(spark)}/tensorloom/{name}-{uuid.uuid4().hex}"
