"""Datasets of tensors on any file system that Spark writes: Parquet parts, versions by pointer, transactions.

A dataset is a folder of parts and of numbered pointers. A pointer lists the parts of its version: parts of rows,
and parts of tombstones (ids that the write removed). Each row carries the number of the commit that wrote it, so a
tombstone removes what older commits wrote: an update or delete writes a few rows and no more, and ``compact`` writes
a dataset anew without what is gone. Pointers are small files made by "create if absent", which lets one of two
writers win; the other gets a ``Conflict`` and nothing of it is ever seen. A transaction over several datasets
writes its pointers first and becomes visible by one more such file, its decision; a pointer whose transaction has
not been decided counts for nothing, and the next writer decides it as aborted. Readers see whole versions only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom import model
from tensorloom.functions import codecs
from tensorloom.functions import dense as D
from tensorloom.plans import nql

_METADATA_TYPES = {"int": "^-?[0-9]+$", "float": r"^-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$", "bool": "^(true|false)$", "list": r"^\[", "dict": r"^\{"}


class DatasetError(ValueError):
    pass


class Conflict(DatasetError):
    """Another writer was faster; nothing of this write is seen."""


_STORED = model.TENSORS + ", _commit int, _code struct<values:array<int>,scale:double,zero_point:bigint,constant:boolean>"


def flat(values) -> tuple[list[int], list[float]]:
    """Shape and row-major numbers of nested lists (or a numpy array)."""
    values = values.tolist() if hasattr(values, "tolist") else values
    if not isinstance(values, (list, tuple)):
        return [], [float(values)]
    if not values:
        return [0], []
    parts = [flat(v) for v in values]
    if any(s != parts[0][0] for s, _ in parts):
        raise DatasetError("the nested lists aren't rectangular")
    return [len(values), *parts[0][0]], [x for _, d in parts for x in d]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # datasets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _create(self, path: str, text: str) -> bool:
        """Makes a file with this text; False if there is one already."""
        fs, p = self._fs(path)
        try:
            out = fs.create(p, False)
        except Exception as error:  # py4j hides the class: only an existing file means that another was faster
            if fs.exists(p):
                return False
            raise DatasetError(f"can't write {path}: {error}") from None
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _text(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _listed(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith(".")) if fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return self._latest(name) is not None

    def datasets(self) -> list[str]:
        return [n for n in self._listed(self.root) if not n.startswith("_") and self.exists(n)]

    def create(self, name: str, schema: dict | None = None, metric: str = "cosine", preset: str = "none") -> None:
        """schema: what rows must be like; preset: one of ``codecs.PRESETS``, how they are stored."""
        if preset not in codecs.PRESETS:
            raise DatasetError(f"unknown preset {preset}")
        if self.exists(name):
            raise DatasetError(f"dataset {name} exists")
        self._point(name, self._number(name), {"parts": [], "gone": [], "schema": schema, "metric": metric, "preset": preset})

    def drop(self, name: str) -> None:
        self._pointer(name)
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)

    # pointers

    def _decision(self, transaction: str | None) -> str | None:
        return "committed" if transaction is None else self._text(f"{self.root}/_transactions/{transaction}")

    def _latest(self, name: str) -> dict | None:
        """The newest pointer that counts."""
        for number in reversed(self._listed(f"{self.root}/{name}/_pointers")):
            found = json.loads(self._text(f"{self.root}/{name}/_pointers/{number}") or "{}")
            if found and self._decision(found["transaction"]) == "committed":
                return found | {"number": int(number)}
        return None

    def _number(self, name: str) -> int:
        """The number of the next pointer; undecided transactions before it are aborted."""
        numbers = self._listed(f"{self.root}/{name}/_pointers")
        for number in numbers[-1:]:
            found = json.loads(self._text(f"{self.root}/{name}/_pointers/{number}") or "{}")
            if found and self._decision(found["transaction"]) is None:
                self._create(f"{self.root}/_transactions/{found['transaction']}", "aborted")
        return int(numbers[-1]) + 1 if numbers else 0

    def _point(self, name: str, number: int, pointer: dict, transaction: str | None = None) -> None:
        if not self._create(f"{self.root}/{name}/_pointers/{number:010d}", json.dumps(pointer | {"transaction": transaction})):
            raise Conflict(f"another writer changed {name}")

    def _pointer(self, name: str) -> dict:
        found = self._latest(name)
        if found is None:
            raise DatasetError(f"no dataset {name}")
        return found

    # reading

    def _rows(self, name: str, pointer: dict) -> DataFrame:
        """The rows of a version as they are stored, with their commits."""
        base = f"{self.root}/{name}/"
        if not pointer["parts"]:
            return self.spark.createDataFrame([], _STORED)
        rows = self.spark.read.schema(_STORED).parquet(*[base + p for p in pointer["parts"]])
        if pointer["gone"]:
            gone = self.spark.read.schema("tensor_id string, _commit int").parquet(*[base + p for p in pointer["gone"]]).groupBy("tensor_id").agg(F.max("_commit").alias("_until"))
            rows = rows.join(gone, "tensor_id", "left").where("_until IS NULL OR _until <= _commit").drop("_until")
        return rows

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """All rows of the current version, or of an older one by its number; quantised elements as they come back."""
        pointer = self._pointer(name)
        if version is not None:
            text = self._text(f"{self.root}/{name}/_pointers/{version:010d}")
            pointer = json.loads(text) if text else {}
            if not pointer or self._decision(pointer["transaction"]) != "committed":
                raise DatasetError(f"{name} has no version {version}")
        rows = self._rows(name, pointer)
        back = F.when(F.col("_code").isNotNull(), codecs.from_int8("_code")).otherwise(F.col("data"))
        return rows.withColumn("data", back).select(*[f.split()[0] for f in model.TENSORS.split(", ")])

    def versions(self, name: str) -> list[int]:
        self._pointer(name)
        numbers = [(n, json.loads(self._text(f"{self.root}/{name}/_pointers/{n}") or "{}")) for n in self._listed(f"{self.root}/{name}/_pointers")]
        return [int(n) for n, p in numbers if p and self._decision(p["transaction"]) == "committed"]

    def compression_stats(self, name: str) -> DataFrame:
        """(total, compressed, original_bytes, compressed_bytes, algorithms, ratio) of the stored rows."""
        return codecs.compression_stats(self._rows(name, self._pointer(name)).select("dtype", "data", "_code"))

    def page(self, name: str, offset: int = 0, limit: int | None = 100) -> DataFrame:
        out = self.read(name).orderBy("seq").offset(offset)
        return out if limit is None else out.limit(limit)

    def get(self, name: str, tensor_id: str) -> T.Row:
        row = self.read(name).where(F.col("tensor_id") == tensor_id).first()
        if row is None:
            raise DatasetError(f"no tensor {tensor_id} in {name}")
        return row

    def count(self, name: str) -> int:
        return self.read(name).count()

    def sample(self, name: str, n: int, seed: int = 0) -> DataFrame:
        """n rows without replacement, the same for the same seed."""
        return self.read(name).orderBy(F.xxhash64("tensor_id", F.lit(seed)), "tensor_id").limit(max(0, n))

    def query(self, name: str, test: Column | Callable) -> DataFrame:
        """Rows that pass a Column, or a function of (data, metadata) where errors count as false."""
        if isinstance(test, Column):
            return self.read(name).where(test)

        def passes(data, metadata) -> bool:
            try:
                return bool(test(data, json.loads(metadata or "{}")))
            except Exception:  # a row whose predicate fails is skipped
                return False

        @F.pandas_udf("boolean")
        def run(data: pd.Series, metadata: pd.Series) -> pd.Series:
            return pd.Series([passes(d, m) for d, m in zip(data, metadata)], dtype="boolean")

        return self.read(name).where(run("data", "metadata"))

    def by_metadata(self, name: str, filters: dict) -> DataFrame:
        return self.read(name).where(nql.path_equals("metadata", filters))

    # writing

    def prepared(self, name: str, rows: DataFrame, first: int) -> DataFrame:
        """Rows (shape, data and optionally tensor_id, dtype, metadata) with the system columns; breaks of the schema are errors."""
        pointer = self._pointer(name)
        schema = pointer["schema"] or {}
        have = set(rows.columns)
        out = rows.select(
            F.lit(name).alias("dataset"),
            (F.coalesce("tensor_id", F.expr("uuid()")) if "tensor_id" in have else F.expr("uuid()")).alias("tensor_id"),
            (F.monotonically_increasing_id() + first).alias("seq"),
            F.col("shape").cast("array<bigint>").alias("shape"),
            (F.col("dtype") if "dtype" in have else F.lit("float32")).alias("dtype"),
            F.col("data").cast("array<double>").alias("data"),
            (F.col("metadata") if "metadata" in have else F.lit("{}")).alias("metadata"),
            F.current_timestamp().alias("created_at"),
            F.lit(1).cast("bigint").alias("version"),
        )
        checks = [(F.size("data") == D.num_elements("shape"), "data and shape differ in size")]
        if "shape" in schema:
            checks.append((F.col("shape") == F.array(*[F.lit(d).cast("bigint") for d in schema["shape"]]), f"the shape isn't {schema['shape']}"))
        if "dtype" in schema:
            checks.append((F.col("dtype") == schema["dtype"], f"the dtype isn't {schema['dtype']}"))
        for key, kind in schema.get("metadata", {}).items():
            entry = F.get_json_object("metadata", f"$.{key}")
            checks.append((F.coalesce(entry.rlike(_METADATA_TYPES[kind]) if kind in _METADATA_TYPES else entry.isNotNull(), F.lit(False)), f"metadata {key} isn't there as {kind}"))
        for ok, message in checks:
            out = out.where(F.assert_true(ok, F.lit(message)).isNull())
        return out

    def _changes(self, name: str, pointer: dict, number: int, changes: list[tuple[str, DataFrame]]) -> dict:
        """Writes the parts of some changes (append or gone, rows) and returns the pointer that lists them too."""
        codec, quantised = codecs.PRESETS[pointer["preset"]]
        new = {k: list(pointer[k]) for k in ("parts", "gone")}
        for kind, rows in changes:
            part = f"part-{uuid.uuid4().hex}"
            if kind == "gone":
                rows.select(F.col("tensor_id").cast("string"), F.lit(number).alias("_commit")).write.parquet(f"{self.root}/{name}/{part}")
                new["gone"].append(part)
                continue
            none = F.lit(None).cast("struct<values:array<int>,scale:double,zero_point:bigint,constant:boolean>")
            rows = rows.withColumn("_commit", F.lit(number)).withColumn("_code", none)
            # empty tensors and those with other values than numbers stay as they are
            some = (F.size("data") > 0) & ~F.exists("data", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            if quantised == "int8":
                rows = rows.withColumn("_code", F.when(some, codecs.int8("data"))).withColumn("data", F.when(F.col("_code").isNull(), F.col("data")))
            elif quantised == "float16":
                rows = rows.withColumn("data", codecs.float16("data"))
            rows.write.option("compression", codec).parquet(f"{self.root}/{name}/{part}")
            new["parts"].append(part)
        return {k: v for k, v in pointer.items() if k not in ("number", "transaction")} | new

    def commit(self, name: str, *changes: tuple[str, DataFrame]) -> int:
        """Applies changes, each ("append", rows) or ("gone", ids), as one new version; returns its number."""
        pointer = self._pointer(name)
        number = self._number(name)
        new = self._changes(name, pointer, number, list(changes))
        if self._pointer(name)["number"] != pointer["number"]:
            raise Conflict(f"another writer changed {name}")
        self._point(name, number, new)
        return number

    def transaction(self) -> Transaction:
        """``with store.transaction() as t:`` collects writes on several datasets and commits them all or none."""
        return Transaction(self)

    def insert(self, name: str, rows: DataFrame) -> None:
        """Appends rows as one new version: all or none are seen."""
        self.commit(name, ("append", self._numbered(name, rows)))

    def _numbered(self, name: str, rows: DataFrame) -> DataFrame:
        last = self.read(name).agg(F.max("seq")).first()[0]
        return self.prepared(name, rows, 0 if last is None else last + 1)

    def batch_update(self, name: str, rows: DataFrame) -> None:
        """Replaces tensors by id (tensor_id, shape, data, metadata); unknown ids are an error, versions go up."""
        self.commit(name, *self._updated(name, rows))

    def _updated(self, name: str, rows: DataFrame) -> list[tuple[str, DataFrame]]:
        now = self.read(name).select("tensor_id", "seq", "created_at", "version", F.col("metadata").alias("_old"))
        ready = self.prepared(name, rows, 0).drop("seq", "created_at", "version")
        ready = ready if "metadata" in rows.columns else ready.drop("metadata")
        known = ready.join(now, "tensor_id", "left")
        known = known.where(F.assert_true(F.col("seq").isNotNull(), F.concat(F.lit(f"no tensor in {name} with id "), "tensor_id")).isNull())
        known = known.withColumn("metadata", F.col("metadata") if "metadata" in rows.columns else F.col("_old")).withColumn("version", F.col("version") + 1)
        return [("gone", ready.select("tensor_id")), ("append", known.select(*[f.split()[0] for f in model.TENSORS.split(", ")]))]

    def insert_tensors(self, name: str, tensors: Iterable[tuple]) -> list[str]:
        """Inserts (values, metadata) pairs of nested lists or arrays; returns their ids."""
        rows = []
        for values, metadata in tensors:
            shape, data = flat(values)
            rows.append(((metadata or {}).get("record_id") or uuid.uuid4().hex, shape, data, json.dumps(metadata or {})))
        self.insert(name, self.spark.createDataFrame(rows, "tensor_id string, shape array<bigint>, data array<double>, metadata string"))
        return [r[0] for r in rows]

    def delete(self, name: str, ids: list[str] | DataFrame) -> None:
        """Removes tensors by a list of ids, or by a table of any size with a column ``tensor_id``."""
        gone = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "tensor_id string")
        self.commit(name, ("gone", gone))

    def update_metadata(self, name: str, tensor_id: str, metadata: dict) -> None:
        """Replaces the user's metadata; the system columns stay, the version goes up. Writes one row."""
        self.get(name, tensor_id)
        own = self.read(name).where(F.col("tensor_id") == tensor_id)
        new = own.withColumn("metadata", F.lit(json.dumps(metadata))).withColumn("version", F.col("version") + 1)
        self.commit(name, ("gone", own.select("tensor_id")), ("append", new))

    def compact(self, name: str) -> None:
        """Writes the live rows as one part and forgets tombstones; older versions stay readable by their numbers."""
        pointer = self._pointer(name)
        number = self._number(name)
        new = self._changes(name, pointer | {"parts": [], "gone": []}, number, [("append", self.read(name))])
        if self._pointer(name)["number"] != pointer["number"]:
            raise Conflict(f"another writer changed {name}")
        self._point(name, number, new)

    def snapshot(self, name: str, target: str) -> None:
        self.read(name).write.parquet(target)

    def restore(self, name: str, source: str) -> None:
        """Appends the rows of a snapshot whose ids aren't there, ids and all."""
        if not self.exists(name):
            self.create(name)
        saved = self.spark.read.schema(model.TENSORS).parquet(source)
        now = self.read(name)
        self.commit(name, ("append", saved.join(now.select("tensor_id"), "tensor_id", "left_anti").select(now.columns)))


class Transaction:
    """Writes on several datasets that are seen together or not at all.

    Each dataset must be as it was when the transaction first used it, else ``Conflict``; an exception in the block
    aborts it. Writes of one transaction don't see each other.
    """

    def __init__(self, store: Store):
        self.store, self.id = store, uuid.uuid4().hex
        self.changes: dict[str, list] = {}
        self.base: dict[str, dict] = {}

    def _use(self, name: str) -> list:
        if name not in self.base:
            self.base[name] = self.store._pointer(name)
        return self.changes.setdefault(name, [])

    def insert(self, name: str, rows: DataFrame) -> None:
        self._use(name).append(("append", self.store._numbered(name, rows)))

    def update(self, name: str, rows: DataFrame) -> None:
        self._use(name).extend(self.store._updated(name, rows))

    def delete(self, name: str, ids: DataFrame) -> None:
        self._use(name).append(("gone", ids))

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.commit()

    def commit(self) -> None:
        store, decision = self.store, f"{self.store.root}/_transactions/{self.id}"
        ready = []
        for name in sorted(self.changes):
            number = store._number(name)
            ready.append((name, number, store._changes(name, self.base[name], number, self.changes[name])))
        try:
            for name, number, pointer in ready:
                if store._pointer(name)["number"] != self.base[name]["number"]:
                    raise Conflict(f"another writer changed {name}")
                store._point(name, number, pointer, self.id)
        except Exception:
            store._create(decision, "aborted")
            raise
        if not store._create(decision, "committed"):
            raise Conflict("another writer aborted the transaction")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, data): each file as one matrix of the rows in which every field is a number; order as in the file."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))
    lines = F.slice(F.split("text", r"\r?\n"), 2, F.size(F.split("text", r"\r?\n")))
    rows = F.transform(lines, lambda line: F.transform(F.split(line, ","), lambda x: F.trim(x).try_cast("double")))
    good = F.filter(rows, lambda r: F.forall(r, lambda x: x.isNotNull()))
    out = raw.select("path", good.alias("rows")).where(F.size("rows") > 0)
    return out.select("path", F.array(F.size("rows").cast("bigint"), F.size(F.col("rows")[0]).cast("bigint")).alias("shape"), F.flatten("rows").alias("data"))


def pack_fixed(vectors: DataFrame, column: str, size: int) -> DataFrame:
    """Vectors that all have ``size`` elements, else an error."""
    return vectors.where(F.assert_true(F.size(column) == size, F.lit(f"a vector doesn't have {size} elements")).isNull())


def sdk_tensors(spark: SparkSession, values: Iterable) -> DataFrame:
    rows = [(i, *flat(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "tensor_id long, shape array<bigint>, data array<double>")
