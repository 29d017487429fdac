"""Tensor algebra on the element form: relational joins and sums, for tensors larger than a row.

A table of elements has one column for each index and ``value``. A contraction is an equi-join on the shared
labels and a sum over the labels that go; Spark combines the sums map-side, spreads hot keys by AQE and spills.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Elements of an outer product, of operands without a shared index, at most.
OUTER = 10_000_000


def summed(cells: DataFrame, *kept: str) -> DataFrame:
    """Sum over all indexes but the kept ones; also merges duplicates of a sparse tensor."""
    return cells.groupBy(*kept).agg(F.sum("value").alias("value"))


def parse_equation(equation: str) -> tuple[list[str], str]:
    """Operand labels and output labels; without an arrow the labels that occur once, in alphabetical order."""
    left, arrow, right = equation.replace(" ", "").partition("->")
    operands = left.split(",")
    labels = "".join(operands)
    if not all(c.isalpha() for c in labels + right) or not all(operands):
        raise ValueError(f"not an einsum equation: {equation}")
    if not arrow:
        right = "".join(sorted(c for c in set(labels) if labels.count(c) == 1))
    if len(set(right)) != len(right) or not set(right) <= set(labels):
        raise ValueError(f"output labels of {equation} must be distinct labels of the operands")
    return operands, right


def contraction_order(operands: list[str], output: str, sizes: dict[str, int]) -> list[tuple[int, int]]:
    """Greedy pairs of operands to join: the pair that shares labels and leaves the smallest result comes first."""
    left = {i: set(o) for i, o in enumerate(operands)}
    steps, fresh = [], len(operands)

    def result(a: int, b: int) -> set:
        rest = set(output).union(*[s for k, s in left.items() if k not in (a, b)])
        return (left[a] | left[b]) & rest

    while len(left) > 1:
        pairs = [(not (left[a] & left[b]), int(reduce(lambda x, c: x * sizes.get(c, 2), result(a, b), 1)), a, b) for a in left for b in left if a < b]
        _, _, a, b = min(pairs)
        new = result(a, b)
        steps.append((a, b))
        del left[a], left[b]
        left[fresh] = new
        fresh += 1
    return steps


def einsum(equation: str, *operands: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """General contraction of element tables whose index columns are named i0, i1, ...; returns i0, i1, ... and value.

    Operands that share no index are multiplied out only up to ``OUTER`` elements; beyond, that is an error.
    """
    inputs, output = parse_equation(equation)
    if len(inputs) != len(operands):
        raise ValueError(f"{equation} has {len(inputs)} operands, not {len(operands)}")
    tables: dict[int, tuple[str, DataFrame]] = {}
    for k, (labels, cells) in enumerate(zip(inputs, operands)):
        where = [F.col(f"i{labels.index(c)}") == F.col(f"i{n}") for n, c in enumerate(labels) if labels.index(c) != n]
        cells = cells.where(reduce(lambda a, b: a & b, where)) if where else cells
        own = "".join(dict.fromkeys(labels))
        tables[k] = own, cells.select(*[F.col(f"i{labels.index(c)}").alias(c) for c in own], "value")
    fresh = len(tables)
    for a, b in contraction_order(inputs, output, sizes or {}):
        (la, da), (lb, db) = tables.pop(a), tables.pop(b)
        rest = set(output).union(*[labels for labels, _ in tables.values()])
        kept = "".join(c for c in dict.fromkeys(la + lb) if c in rest)
        shared = [c for c in la if c in lb]
        right = db.select(*[F.col(c) for c in lb], F.col("value").alias("_other"))
        if not shared and (n := da.count() * db.count()) > OUTER:
            raise ValueError(f"{equation} asks for an outer product of {n} elements, more than {OUTER}")
        joined = da.join(right, shared) if shared else da.crossJoin(right)  # an outer product is asked for by the equation
        tables[fresh] = kept, joined.groupBy(*kept).agg(F.sum(F.col("value") * F.col("_other")).alias("value"))
        fresh += 1
    labels, cells = next(iter(tables.values()))
    if set(labels) != set(output):
        cells = cells.groupBy(*output).agg(F.sum("value").alias("value"))
    return cells.select(*[F.col(c).alias(f"i{n}") for n, c in enumerate(output)], "value")


def matmul(a: DataFrame, b: DataFrame, *batch: str) -> DataFrame:
    """(batch, i, j, value) of the products of (batch, i, j, value) tables."""
    left = a.select(*batch, "i", F.col("j").alias("k"), F.col("value").alias("va"))
    right = b.select(*batch, F.col("i").alias("k"), "j", F.col("value").alias("vb"))
    return left.join(right, [*batch, "k"]).groupBy(*batch, "i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("value"))


def elementwise(a: DataFrame, b: DataFrame, keys: list[str], op: str) -> DataFrame:
    """add and subtract keep the elements of either side, multiply those of both."""
    right = b.select(*keys, F.col("value").alias("_other"))
    if op == "multiply":
        return a.join(right, keys).select(*keys, (F.col("value") * F.col("_other")).alias("value"))
    x, y = F.coalesce("value", F.lit(0.0)), F.coalesce("_other", F.lit(0.0))
    return a.join(right, keys, "full_outer").select(*keys, {"add": x + y, "subtract": x - y}[op].alias("value"))


def trace(cells: DataFrame, one: str, other: str, *rest: str) -> DataFrame:
    return summed(cells.where(F.col(one) == F.col(other)), *rest)


def reduced(cells: DataFrame, kept: list[str], over: str) -> DataFrame:
    """sum, mean, min, max with the first index of either, population and sample variance along one dimension."""
    return cells.groupBy(*kept).agg(
        F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.min_by(over, F.struct("value", over)).alias("argmin"),
        F.max("value").alias("max"), F.max_by(over, F.struct(F.col("value"), -F.col(over))).alias("argmax"), F.var_pop("value").alias("var"), F.stddev_pop("value").alias("std"), F.var_samp("value").alias("var_samp"),
    )


def convolve(cells: DataFrame, kernel: list[float], key: str, pos: str, length: int, mode: str = "valid") -> DataFrame:
    """1-D true convolution of each signal of ``length`` elements with a small kernel: key, pos, value.

    ``same`` pads half the kernel on either side, so an even kernel gives one value more than the signal.
    """
    k = len(kernel)
    taps = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("m"), F.lit(float(w)).alias("w")) for i, w in enumerate(kernel)])).alias("t")
    spread = cells.select(key, pos, "value", taps).select(key, (F.col(pos) + F.col("t.m")).alias("at"), (F.col("value") * F.col("t.w")).alias("part"))
    first, last = {"full": (0, length + k - 2), "valid": (k - 1, length - 1), "same": (k - 1 - k // 2, length - 1 + k // 2)}[mode]
    out = spread.where(F.col("at").between(first, last)).groupBy(key, "at").agg(F.sum("part").alias("value"))
    return out.select(key, (F.col("at") - first).alias(pos), "value")


def covariance(cells: DataFrame, variable: str, sample: str) -> DataFrame:
    """Pairs of variables (a <= b) with their sample covariance and correlation; pairs of variables are asked for."""
    b = cells.select(F.col(variable).alias("b"), sample, F.col("value").alias("y"))
    pairs = cells.select(F.col(variable).alias("a"), sample, F.col("value").alias("x")).join(b, sample).where("a <= b")
    return pairs.groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"), F.corr("x", "y").alias("corr"))
