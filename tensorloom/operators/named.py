"""Operators by name: on columns, on stored tensors, tracked in an operation log, with a cache of results.

``OPERATORS`` maps a name to its arity, the kind of its parameters and a function that builds a column of the
results' elements and one of their shapes. ``apply`` runs an operator over a table of tensors at once, so a batch of
stored tensors is one job. ``Tracker`` stores results with their provenance, logs the operation and its edges, and
answers repeated calls from the tables it has written.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import dense as D
from tensorloom.sources.store import DatasetError, Store


class OperationError(ValueError):
    pass


@dataclass(frozen=True)
class Operator:
    """build(a, a_shape, b, b_shape, parameters) gives the results' elements and shapes as columns."""

    name: str
    inputs: int
    build: Callable[..., tuple[Column, Column]]
    parameters: tuple[str, ...] = ()
    about: str = ""


OPERATORS: dict[str, Operator] = {}


def _operator(name: str, inputs: int, about: str, *parameters: str):
    def register(build):
        OPERATORS[name] = Operator(name, inputs, build, parameters, about)
        return build

    return register


def _shape(*dims) -> Column:
    return F.array(*[F.lit(d).cast("bigint") for d in dims]) if dims else F.array().cast("array<bigint>")


def _other(b, parameters):
    """The second operand: a tensor's elements, or a number among the parameters."""
    return parameters["value"] if b is None else b


def _elementwise(function):
    return lambda a, sa, b, sb, p: (function(a, _other(b, p)), sa)


_operator("add", 2, "sum, element by element", "value")(_elementwise(D.add))
_operator("subtract", 2, "difference, element by element", "value")(_elementwise(D.subtract))
_operator("multiply", 2, "product, element by element", "value")(_elementwise(D.multiply))
_operator("divide", 2, "quotient, element by element", "value")(_elementwise(D.divide))
_operator("power", 1, "elements to a power", "value")(_elementwise(D.power))
_operator("log", 1, "natural logarithms")(lambda a, sa, b, sb, p: (D.log(a), sa))
_operator("abs", 1, "absolute values")(lambda a, sa, b, sb, p: (F.transform(a, lambda x: F.abs(x)), sa))
_operator("dot", 2, "inner product of vectors")(lambda a, sa, b, sb, p: (F.array(D.dot(a, b)), _shape()))
_operator("outer", 2, "outer product of vectors")(lambda a, sa, b, sb, p: (D.outer(a, b), F.concat(sa, sb)))
_operator("sum", 1, "sum of all elements")(lambda a, sa, b, sb, p: (F.array(D.total(a)), _shape()))
_operator("mean", 1, "mean of all elements")(lambda a, sa, b, sb, p: (F.array(D.mean(a)), _shape()))
_operator("min", 1, "least element")(lambda a, sa, b, sb, p: (F.array(F.array_min(a)), _shape()))
_operator("max", 1, "greatest element")(lambda a, sa, b, sb, p: (F.array(F.array_max(a)), _shape()))
_operator("norm", 1, "Frobenius norm")(lambda a, sa, b, sb, p: (F.array(D.frobenius_norm(a)), _shape()))
_operator("reshape", 1, "the same elements in another shape", "shape")(lambda a, sa, b, sb, p: (a, D.reshape(sa, p["shape"])))
_operator("flatten", 1, "the same elements as a vector")(lambda a, sa, b, sb, p: (a, F.array(F.size(a).cast("bigint"))))
_operator("normalize", 1, "divided by the Frobenius norm; zeros stay")(lambda a, sa, b, sb, p: (D.bound(D.frobenius_norm(a), lambda n: F.transform(a, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))), sa))


def _kernel(function: Callable[..., np.ndarray]) -> Callable[..., tuple[Column, Column]]:
    """An operator of numpy arrays, in one Arrow UDF that returns elements and shape; a row where it fails is null."""

    def build(a, sa, b, sb, p):
        columns = [a, sa] + ([b, sb] if b is not None else [])

        @F.pandas_udf("struct<data:array<double>,shape:array<bigint>>")
        def run(*batch: pd.Series) -> pd.DataFrame:
            rows = []
            for row in zip(*batch):
                try:
                    tensors = [np.asarray(row[i], float).reshape([int(d) for d in row[i + 1]]) for i in range(0, len(row), 2)]
                    out = np.asarray(function(*tensors, **p), float)
                    rows.append((out.ravel(), list(out.shape)))
                except (ValueError, TypeError, IndexError, np.linalg.LinAlgError):
                    rows.append((None, None))
            return pd.DataFrame(rows, columns=["data", "shape"])

        out = run(*columns)
        return out["data"], out["shape"]

    return build


_operator("matmul", 2, "matrix product")(_kernel(lambda a, b: a @ b))
_operator("transpose", 1, "dimensions in another order, reversed without one", "dims")(_kernel(lambda a, dims=None: np.transpose(a, dims)))
_operator("permute", 1, "dimensions in the given order", "dims")(_kernel(lambda a, dims: np.transpose(a, dims)))
_operator("concatenate", 2, "joined along a dimension, the first without one", "dim")(_kernel(lambda a, b, dim=0: np.concatenate([a, b], dim)))
_operator("stack", 2, "joined along a new dimension, the first without one", "dim")(_kernel(lambda a, b, dim=0: np.stack([a, b], dim)))
_operator("einsum", 2, "a contraction of two tensors by an equation", "equation")(_kernel(lambda a, b, equation: np.einsum(equation, a, b)))
_operator("svd", 1, "singular values of a matrix")(_kernel(lambda a: np.linalg.svd(a, compute_uv=False)))
_operator("inverse", 1, "inverse of a square matrix")(_kernel(np.linalg.inv))
_operator("determinant", 1, "determinant of a square matrix")(_kernel(np.linalg.det))
_operator("trace", 1, "sum of the diagonal")(_kernel(np.trace))
_operator("sum_dim", 1, "sums along a dimension", "dim")(_kernel(lambda a, dim: a.sum(dim)))
_operator("mean_dim", 1, "means along a dimension", "dim")(_kernel(lambda a, dim: a.mean(dim)))


def listed(spark) -> DataFrame:
    """(name, inputs, parameters, about) of every operator."""
    return spark.createDataFrame([(o.name, o.inputs, list(o.parameters), o.about) for o in OPERATORS.values()], "name string, inputs int, parameters array<string>, about string")


def operator(name: str, parameters: dict) -> Operator:
    if name not in OPERATORS:
        raise OperationError(f"unknown operation {name}: one of {', '.join(sorted(OPERATORS))}")
    found = OPERATORS[name]
    if unknown := set(parameters) - set(found.parameters):
        raise OperationError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    return found


def apply(name: str, tensors: DataFrame, second: bool = False, **parameters) -> DataFrame:
    """The table (data, shape, and data2, shape2 if ``second``) with the results in place of data and shape.

    The shape of a result of a function of numpy arrays is null where it fails; element-wise operators fail as a whole.
    """
    found = operator(name, parameters)
    if found.inputs == 1 and second or found.inputs == 2 and not second and "value" not in parameters:
        raise OperationError(f"{name} takes {found.inputs} operands")
    data, shape = found.build(F.col("data"), F.col("shape"), F.col("data2") if second else None, F.col("shape2") if second else None, parameters)
    return tensors.withColumns({"_data": data, "_shape": shape}).drop("data", "shape", "data2", "shape2").withColumnsRenamed({"_data": "data", "_shape": "shape"})


LOG = "operation_id string, operation_type string, status string, started_at timestamp, completed_at timestamp, ms double, user_id string, parameters string, error_message string"
EDGE = "child string, parent string, operation_id string"
AUDIT = "at timestamp, user string, action string, tensor_id string, details string"


class Tracker:
    """Runs operators on stored tensors: results in a dataset, an operation log, edges, an audit log and a cache.

    The log's tables are folders under ``root``/_history. The cache maps a call (operator, inputs in their order,
    parameters, versions of the datasets) to the ids it made, so that a - b and b - a differ.
    """

    def __init__(self, store: Store, user: str = "anonymous", cached: bool = True):
        self.store, self.user, self.spark = store, user, store.spark
        self.cache: dict[str, list[str]] = {}
        self.caching, self.hits, self.misses = cached, 0, 0

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        if rows:
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.store.root}/_history/{name}")

    def _table(self, name: str, schema: str) -> DataFrame:
        fs, p = self.store._fs(f"{self.store.root}/_history/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.store.root}/_history/{name}") if fs.exists(p) else self.spark.createDataFrame([], schema)

    def operations(self) -> DataFrame:
        return self._table("operations", LOG)

    def edges(self) -> DataFrame:
        return self._table("edges", EDGE)

    def audit(self) -> DataFrame:
        return self._table("audit", AUDIT)

    def log_event(self, action: str, tensor_id: str | None = None, user: str | None = None, **details) -> None:
        self._append("audit", [(datetime.now(), user or self.user, action, tensor_id, json.dumps(details, sort_keys=True))], AUDIT)

    # the cache

    def clear(self) -> None:
        self.cache.clear()

    def cache_stats(self) -> dict:
        asked = self.hits + self.misses
        return {"entries": len(self.cache), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0, "enabled": self.caching}

    def _key(self, name: str, dataset: str, inputs: list, parameters: dict) -> str:
        call = [name, dataset, self.store._pointer(dataset)["number"], inputs, sorted(parameters.items(), key=lambda x: x[0])]
        return hashlib.sha256(json.dumps(call, default=str).encode()).hexdigest()

    # operators

    def run(self, name: str, dataset: str, inputs: list[tuple[str, ...]], target: str | None = None, **parameters) -> list[str]:
        """Applies an operator to each tuple of stored ids, in one job; returns the results' ids, in the order of the inputs.

        Results go to ``target`` (the dataset itself by default) with their provenance as metadata. A failure is
        logged with its message and raised.
        """
        target = target or dataset
        key = self._key(name, dataset, inputs, parameters | {"target": target})
        if self.caching and key in self.cache:
            self.hits += 1
            return self.cache[key]
        self.misses += 1
        operation, began, clock = uuid.uuid4().hex, datetime.now(), time.perf_counter()
        ids = [f"{operation}-{i}" for i in range(len(inputs))]

        def log(status: str, message: str | None) -> None:
            self._append("operations", [(operation, name, status, began, datetime.now(), (time.perf_counter() - clock) * 1000, self.user, json.dumps(parameters, sort_keys=True, default=str), message)], LOG)

        try:
            width = {len(i) for i in inputs}
            if len(width) != 1 or not 1 <= min(width) <= 2:
                raise OperationError("each call takes one or two tensors, all the same number")
            two = width == {2}
            wanted = self.spark.createDataFrame([(i, *own) for i, own in zip(ids, inputs)], "tensor_id string, a string" + ", b string" * two)
            now = self.store.read(dataset)
            rows = wanted.join(now.select(F.col("tensor_id").alias("a"), "data", "shape"), "a")
            if two:
                rows = rows.join(now.select(F.col("tensor_id").alias("b"), F.col("data").alias("data2"), F.col("shape").alias("shape2")), "b")
            parents = F.array("a", "b") if two else F.array("a")
            made = apply(name, rows, two, **parameters)
            about = F.to_json(F.struct(F.lit(name).alias("operation"), F.lit(operation).alias("operation_id"), parents.alias("parents")))
            made = made.select("tensor_id", "shape", "data", about.alias("metadata"))
            whole = made.where(F.assert_true(F.col("data").isNotNull(), F.concat(F.lit(f"{name} failed for "), "tensor_id")).isNull())
            if not self.store.exists(target):
                self.store.create(target)
            self.store.insert(target, whole)
            found = self.store.read(target).where(F.startswith("tensor_id", F.lit(operation))).count()
            if found != len(ids):
                self.store.delete(target, ids)
                raise DatasetError(f"{len(ids) - found} of the tensors aren't in {dataset}")
        except Exception as error:
            log("failed", str(error).splitlines()[0][:500])
            raise
        log("completed", None)
        self._append("edges", [(child, parent, operation) for child, own in zip(ids, inputs) for parent in own], EDGE)
        if self.caching:
            self.cache[key] = ids
        return ids

    def benchmark(self, name: str, dataset: str, inputs: list[tuple[str, ...]], iterations: int = 3, **parameters) -> dict:
        """Mean, least, greatest and total milliseconds of runs that store nothing."""
        took = []
        now = self.store.read(dataset)
        wanted = self.spark.createDataFrame(inputs, "a string" + ", b string" * (len(inputs[0]) == 2))
        for _ in range(iterations):
            began = time.perf_counter()
            rows = wanted.join(now.select(F.col("tensor_id").alias("a"), "data", "shape"), "a")
            if len(inputs[0]) == 2:
                rows = rows.join(now.select(F.col("tensor_id").alias("b"), F.col("data").alias("data2"), F.col("shape").alias("shape2")), "b")
            apply(name, rows, len(inputs[0]) == 2, **parameters).write.format("noop").mode("overwrite").save()
            took.append((time.perf_counter() - began) * 1000)
        return {"operation": name, "iterations": iterations, "mean_ms": float(np.mean(took)), "min_ms": min(took), "max_ms": max(took), "total_ms": sum(took)}


# workflows


class WorkflowError(ValueError):
    pass


def _filled(value, results: dict):
    """``$task.field`` is the field of the result of a task, ``$task`` the result itself; lists and maps are filled too."""
    if isinstance(value, str) and value.startswith("$"):
        task, _, field = value[1:].partition(".")
        out = results[task]
        return out[field] if field else out
    if isinstance(value, list):
        return [_filled(v, results) for v in value]
    if isinstance(value, dict):
        return {k: _filled(v, results) for k, v in value.items()}
    return value


def rounds(tasks: dict[str, dict]) -> list[list[str]]:
    """The tasks in topological rounds: each round's tasks need only those of earlier rounds. A cycle is a deadlock."""
    needs = {name: set(task.get("needs", ())) | _named(task.get("arguments", {})) for name, task in tasks.items()}
    if unknown := set().union(*needs.values(), set()) - set(tasks):
        raise WorkflowError(f"unknown tasks: {', '.join(sorted(unknown))}")
    done: set[str] = set()
    out = []
    while len(done) < len(tasks):
        ready = sorted(n for n in tasks if n not in done and needs[n] <= done)
        if not ready:
            raise WorkflowError(f"deadlock among {', '.join(sorted(set(tasks) - done))}")
        out.append(ready)
        done.update(ready)
    return out


def _named(value) -> set[str]:
    if isinstance(value, str) and value.startswith("$"):
        return {value[1:].partition(".")[0]}
    if isinstance(value, dict):
        value = list(value.values())
    return set().union(*[_named(v) for v in value], set()) if isinstance(value, list) else set()


def workflow(tasks: dict[str, dict], functions: dict[str, Callable]) -> dict:
    """Runs tasks {name: {"call", "arguments", "needs"}} round by round; returns every task's result.

    A result is what the function returns: a DataFrame stays a plan, so that Spark sees one plan for chained tasks.
    """
    results: dict = {}
    for ready in rounds(tasks):
        for name in ready:
            task = tasks[name]
            if task["call"] not in functions:
                raise WorkflowError(f"task {name} calls the unknown {task['call']}")
            results[name] = functions[task["call"]](**_filled(task.get("arguments", {}), results))
    return results


def tensor_workflow(candidates: DataFrame, operations: list[tuple[str, dict]], key: str = "tensor_id", order: str = "score") -> tuple[DataFrame, DataFrame]:
    """Takes the best candidate (data, shape, key, score), applies operators one after the other, and keeps each step.

    Returns the steps (step, operation, data, shape) and their lineage (child, parent, operation). An unknown
    operation is passed over; one that fails ends the chain before its step.
    """
    best = candidates.orderBy(F.desc(order), key).limit(1).select(F.col(key).cast("string").alias("_id"), "data", "shape")
    steps, before, at = [best.select(F.lit(0).alias("step"), F.lit("input").alias("operation"), "_id", "data", "shape")], best, 0
    for name, parameters in operations:
        if name not in OPERATORS:
            continue
        at += 1
        before = apply(name, before, **parameters).where("data IS NOT NULL")
        steps.append(before.select(F.lit(at).alias("step"), F.lit(name).alias("operation"), "_id", "data", "shape"))
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    named = F.when(F.col("step") == 0, F.col("_id")).otherwise(F.concat_ws(":", "_id", "step"))
    lineage = every.where("step > 0").select(named.alias("child"), F.when(F.col("step") == 1, F.col("_id")).otherwise(F.concat_ws(":", "_id", F.col("step") - 1)).alias("parent"), "operation")
    return every.select("step", "operation", named.alias("tensor_id"), "data", "shape"), lineage
