"""Tensors by the table: arithmetic, products, reductions and search on collections, as plans until they are read.

A ``TensorFrame`` holds rows of (key, shape, data). Operators between two frames match rows by key; operators with a
number apply to every row. Nothing runs before ``collect``, ``to_arrow`` or a write.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators import named, search
from tensorloom.sources.store import Store, flat


class TensorFrame:
    def __init__(self, rows: DataFrame, key: str = "tensor_id"):
        self.rows, self.key = rows.select(key, F.col("shape").cast("array<bigint>").alias("shape"), F.col("data").cast("array<double>").alias("data")), key

    # making

    @classmethod
    def of(cls, spark: SparkSession, values: Iterable) -> TensorFrame:
        """From nested lists or arrays; keys count from 0. Integers and booleans become floats."""
        rows = [(i, *flat(v)) for i, v in enumerate(values)]
        return cls(spark.createDataFrame(rows, "tensor_id bigint, shape array<bigint>, data array<double>"))

    @classmethod
    def stored(cls, store: Store, dataset: str) -> TensorFrame:
        return cls(store.read(dataset))

    @classmethod
    def from_arrow(cls, spark: SparkSession, table: pa.Table, key: str = "tensor_id") -> TensorFrame:
        return cls(spark.createDataFrame(table), key)

    # reading

    def collect(self) -> dict:
        """Arrays by key: for results that fit the driver."""
        return {r[self.key]: np.array(r.data, float).reshape([int(d) for d in r.shape]) for r in self.rows.collect() if r.data is not None}

    def to_arrow(self) -> pa.Table:
        return self.rows.toArrow()

    def store(self, store: Store, dataset: str) -> None:
        if not store.exists(dataset):
            store.create(dataset)
        store.insert(dataset, self.rows.select(F.col(self.key).cast("string").alias("tensor_id"), "shape", "data"))

    # operators

    def apply(self, name: str, other: TensorFrame | None = None, **parameters) -> TensorFrame:
        """Any operator of ``operators.named`` by its name."""
        if other is None:
            return TensorFrame(named.apply(name, self.rows, **parameters), self.key)
        right = other.rows.select(F.col(other.key).alias(self.key), F.col("data").alias("data2"), F.col("shape").alias("shape2"))
        return TensorFrame(named.apply(name, self.rows.join(right, self.key), True, **parameters), self.key)

    def _with(self, name: str, other) -> TensorFrame:
        return self.apply(name, other) if isinstance(other, TensorFrame) else self.apply(name, value=float(other))

    def __add__(self, other):
        return self._with("add", other)

    __radd__ = __add__

    def __sub__(self, other):
        return self._with("subtract", other)

    def __rsub__(self, other):
        return self * -1.0 + other

    def __mul__(self, other):
        return self._with("multiply", other)

    __rmul__ = __mul__

    def __truediv__(self, other):
        return self._with("divide", other)

    def __pow__(self, power: float):
        return self.apply("power", value=float(power))

    def __neg__(self):
        return self * -1.0

    def __matmul__(self, other: TensorFrame):
        return self.apply("matmul", other)

    def sum(self, dim: int | None = None) -> TensorFrame:
        return self.apply("sum") if dim is None else self.apply("sum_dim", dim=dim)

    def mean(self, dim: int | None = None) -> TensorFrame:
        return self.apply("mean") if dim is None else self.apply("mean_dim", dim=dim)

    def norm(self) -> TensorFrame:
        return self.apply("norm")

    def reshape(self, *shape: int) -> TensorFrame:
        return self.apply("reshape", shape=list(shape))

    def transpose(self, *dims: int) -> TensorFrame:
        return self.apply("transpose", dims=list(dims)) if dims else self.apply("transpose")

    def similar(self, query, metric: str = "cosine", k: int = 10) -> DataFrame:
        """(key, score, rank) of the k most similar tensors."""
        _, data = flat(query)
        return search.find_similar(self.rows, data, metric, k, self.key).select(self.key, "score", "rank")


def arrow_array(values: np.ndarray) -> pa.FixedShapeTensorArray:
    """A stack of equal tensors (first dimension: the tensors) as an Arrow array, without a copy of each."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(values, np.float32))


def from_arrow_array(array: pa.FixedShapeTensorArray) -> np.ndarray:
    return array.to_numpy_ndarray()


class Connector:
    """What a storage back end has to offer; ``StoreConnector`` is the one over a ``Store``."""

    def store(self, dataset: str, values, metadata: dict | None = None) -> str:
        raise TypeError("a connector has to define store")

    def retrieve(self, dataset: str, tensor_id: str) -> np.ndarray:
        raise TypeError("a connector has to define retrieve")

    def delete(self, dataset: str, tensor_id: str) -> None:
        raise TypeError("a connector has to define delete")

    def details(self, dataset: str, tensor_id: str) -> dict:
        raise TypeError("a connector has to define details")


class StoreConnector(Connector):
    def __init__(self, store: Store):
        self.backend = store

    def store(self, dataset: str, values, metadata: dict | None = None) -> str:
        if not self.backend.exists(dataset):
            self.backend.create(dataset)
        return self.backend.insert_tensors(dataset, [(values, metadata)])[0]

    def retrieve(self, dataset: str, tensor_id: str) -> np.ndarray:
        row = self.backend.get(dataset, tensor_id)
        return np.array(row.data, float).reshape([int(d) for d in row.shape])

    def delete(self, dataset: str, tensor_id: str) -> None:
        self.backend.get(dataset, tensor_id)
        self.backend.delete(dataset, [tensor_id])

    def details(self, dataset: str, tensor_id: str) -> dict:
        row = self.backend.get(dataset, tensor_id).asDict(True)
        return {k: v for k, v in row.items() if k != "data"}
