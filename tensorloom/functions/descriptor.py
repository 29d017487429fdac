"""Descriptors: the mathematical facts of a tensor as columns, computed once at write time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import dense as D
from tensorloom.operators import linalg

NUMERIC = "num_elements ndim frobenius_norm l1_norm linf_norm mean std min max sparsity rank trace determinant condition_number eigen_min eigen_max".split()
BOOLEAN = "is_square is_symmetric is_positive_definite is_orthogonal is_diagonal is_sparse".split()


def scalar_facts(data: str = "data", shape: str = "shape") -> dict[str, Column]:
    """Facts of any tensor, as JVM expressions."""
    s = F.col(shape)
    return {
        "num_elements": D.num_elements(shape), "ndim": F.size(s), "frobenius_norm": D.frobenius_norm(data), "l1_norm": D.l1_norm(data), "linf_norm": D.linf_norm(data),
        "mean": D.mean(data), "std": D.std(data, unbiased=True), "min": F.array_min(data).cast("double"), "max": F.array_max(data).cast("double"), "sparsity": D.sparsity(data),
        "is_sparse": D.sparsity(data) > 0.5, "is_square": (F.size(s) == 2) & (F.try_element_at(s, F.lit(1)) == F.try_element_at(s, F.lit(2))),
    }


def described(tensors: DataFrame, matrices: bool = True) -> DataFrame:
    """Adds the descriptor columns to rows of (shape, data); matrix facts, by one Arrow UDF, are null for other tensors."""
    right = F.assert_true(F.size("data") == D.num_elements("shape"), F.lit("data and shape differ in size"))
    out = tensors.where(right.isNull()).withColumns(scalar_facts())
    if matrices:
        out = out.withColumn("_facts", linalg.facts("data", "shape")).select("*", "_facts.*").drop("_facts")
    return out


def has_property(name: str) -> Column:
    """symmetric, positive_definite, orthogonal, sparse, dense, square or diagonal; an unknown fact is false."""
    if name == "dense":
        return ~F.coalesce(F.col("is_sparse"), F.lit(False))
    if f"is_{name}" not in BOOLEAN:
        raise ValueError(f"unknown property {name}")
    return F.coalesce(F.col(f"is_{name}"), F.lit(False))


def norm_between(low: float = 0.0, high: float = float("inf"), kind: str = "frobenius") -> Column:
    return F.col({"l1": "l1_norm", "linf": "linf_norm"}.get(kind, "frobenius_norm")).between(low, high)


def shape_is(shape: list[int]) -> Column:
    return F.col("shape") == (F.array(*[F.lit(d).cast("bigint") for d in shape]) if shape else F.array().cast("array<bigint>"))


def shape_where(ndim: int | None = None, size: tuple[int, int] | None = None, aspect: tuple[float, float] | None = None) -> Column:
    out = F.lit(True)
    if ndim is not None:
        out &= F.size("shape") == ndim
    if size is not None:
        out &= D.num_elements("shape").between(*size)
    if aspect is not None:
        out &= F.try_divide(F.array_max("shape"), F.array_min("shape")).between(*aspect)
    return F.coalesce(out, F.lit(False))


def matmul_compatible(shape: list[int]) -> Column:
    """Stored tensors whose rows match the columns of the query."""
    if len(shape) < 2:
        return F.lit(False)
    return (F.size("shape") >= 2) & F.coalesce(F.try_element_at("shape", F.lit(-2)) == shape[-1], F.lit(False))


def decomposition_candidate(kind: str, least: int = 2) -> Column:
    rows, columns = F.try_element_at("shape", F.lit(1)), F.try_element_at("shape", F.lit(2))
    rule = {
        "svd": (rows >= least) & (columns >= least), "qr": (rows >= columns) & (columns >= least), "eigen": (rows == columns) & (rows >= least),
        "cholesky": (rows == columns) & F.coalesce(F.col("is_positive_definite"), F.lit(False)),
    }[kind]
    return F.coalesce((F.size("shape") == 2) & rule, F.lit(False))


OPS = {"eq": "=", "=": "=", "==": "=", "gt": ">", ">": ">", "ge": ">=", ">=": ">=", "lt": "<", "<": "<", "le": "<=", "<=": "<="}


def predicate(field: str, op: str, value) -> Column:
    """A test of a descriptor field: equality within 1e-9 max(1, |v|); a null or unknown field is false."""
    if isinstance(value, bool):
        if op not in ("eq", "=", "=="):
            raise ValueError("flags are only compared for equality")
        if field not in BOOLEAN:
            return F.lit(False)
        return F.coalesce(F.col(field) == value, F.lit(False))
    if not isinstance(value, (int, float)):
        raise ValueError(f"{field}: neither a flag nor a number: {value!r}")
    if field not in NUMERIC:
        return F.lit(False)
    x, sign = F.col(field).cast("double"), OPS[op]
    test = F.abs(x - value) <= 1e-9 * max(1.0, abs(value)) if sign == "=" else {">": x > value, ">=": x >= value, "<": x < value, "<=": x <= value}[sign]
    return F.coalesce(test, F.lit(False))


def property_query(min_norm=None, max_norm=None, symmetric=None, positive_definite=None, rank=None, max_condition=None) -> Column:
    tests = [("frobenius_norm", ">=", min_norm), ("frobenius_norm", "<=", max_norm), ("is_symmetric", "=", symmetric), ("is_positive_definite", "=", positive_definite), ("rank", "=", rank), ("condition_number", "<=", max_condition)]
    out = F.lit(True)
    for field, op, value in tests:
        if value is not None:
            out &= predicate(field, op, value)
    return out


def index_statistics(tensors: DataFrame) -> DataFrame:
    flag = lambda n: F.count_if(F.coalesce(F.col(f"is_{n}"), F.lit(False))).alias(f"{n}_count")
    return tensors.agg(F.count("*").alias("count"), F.count_distinct("shape").alias("shapes"), F.avg("frobenius_norm").alias("avg_norm"), F.min("frobenius_norm").alias("min_norm"), F.max("frobenius_norm").alias("max_norm"), flag("symmetric"), flag("sparse"), flag("square"))


def aggregate(tensors: DataFrame, function: str, field: str) -> DataFrame:
    """count of all rows; min and max over nothing are infinite, avg and sum over nothing 0; an unknown field has no values."""
    x = F.col(field).cast("double") if field in NUMERIC else F.lit(None).cast("double")
    out = {
        "count": F.count("*").cast("double"), "sum": F.coalesce(F.sum(x), F.lit(0.0)), "avg": F.coalesce(F.avg(x), F.lit(0.0)), "mean": F.coalesce(F.avg(x), F.lit(0.0)),
        "min": F.coalesce(F.min(x), F.lit(float("inf"))), "max": F.coalesce(F.max(x), F.lit(float("-inf"))),
    }
    if function not in out:
        raise ValueError(f"unknown aggregate {function}")
    return tensors.agg(out[function].alias("value"))
