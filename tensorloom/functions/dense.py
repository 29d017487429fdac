"""Column functions over dense tensors: ``data`` is a row-major ARRAY<DOUBLE>, ``shape`` an ARRAY<BIGINT>.

Everything here is a JVM expression. Broadcasting is limited to equal sizes and scalars, the cases that need no
index arithmetic; other shapes go through the element form (``operators.elements``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(data, step: Callable[[Column, Column], Column], start: float = 0.0) -> Column:
    return F.aggregate(_col(data), F.lit(start).cast("double"), lambda acc, x: step(acc, x.cast("double")))


def doubles(data) -> Column:
    return F.transform(_col(data), lambda x: x.cast("double"))


def bound(value, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once a row, also where f uses it inside a lambda over elements."""
    return F.element_at(F.transform(F.array(value), f), 1)


# element-wise


def paired(a, b, op: Callable[[Column, Column], Column]) -> Column:
    """op over two tensors of equal size, or over a tensor and a number."""
    if isinstance(b, (int, float)):
        return F.transform(_col(a), lambda x: op(x.cast("double"), F.lit(float(b))))
    same = F.assert_true(F.size(_col(a)) == F.size(_col(b)), F.lit("tensors of different sizes"))
    return F.when(same.isNull(), F.zip_with(_col(a), _col(b), lambda x, y: op(x.cast("double"), y.cast("double"))))


def ieee_divide(x: Column, y: Column) -> Column:
    """x / y with the infinities and NaN of IEEE 754 where y is 0."""
    zero = F.when(F.isnan(x) | (x == 0), F.lit(NAN)).when(x > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(y == 0, zero).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))


def ieee_log(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(F.ln(F.when(x > 0, x).otherwise(F.lit(1.0))))


def add(a, b) -> Column:
    return paired(a, b, lambda x, y: x + y)


def subtract(a, b) -> Column:
    return paired(a, b, lambda x, y: x - y)


def multiply(a, b) -> Column:
    return paired(a, b, lambda x, y: x * y)


def divide(a, b) -> Column:
    if isinstance(b, (int, float)) and b == 0:
        raise ZeroDivisionError("division by the number zero")
    return paired(a, b, ieee_divide)


def power(a, b) -> Column:
    return paired(a, b, lambda x, y: F.pow(x, y))


def log(a) -> Column:
    return F.transform(_col(a), lambda x: ieee_log(x.cast("double")))


# products


def dot(a, b) -> Column:
    return fold(paired(a, b, lambda x, y: x * y), lambda acc, x: acc + x)


def outer(a, b) -> Column:
    return F.flatten(F.transform(_col(a), lambda x: F.transform(_col(b), lambda y: x.cast("double") * y.cast("double"))))


def cross(a, b) -> Column:
    a, b = _col(a), _col(b)
    at = lambda v, i: v[i].cast("double")
    return F.array(*[at(a, i) * at(b, j) - at(a, j) * at(b, i) for i, j in ((1, 2), (2, 0), (0, 1))])


# shapes


def num_elements(shape) -> Column:
    return F.aggregate(_col(shape), F.lit(1).cast("bigint"), lambda acc, d: acc * d)


def reshape(shape, to: list[int]) -> Column:
    wanted = 1
    for d in to:
        wanted *= d
    same = F.assert_true(num_elements(shape) == wanted, F.lit("another number of elements"))
    return F.when(same.isNull(), F.array(*[F.lit(d).cast("bigint") for d in to]))


def permute(data, shape: list[int], dims: list[int]) -> Column:
    """The elements of a tensor of known shape with its dimensions in the given order."""
    if sorted(dims) != list(range(len(shape))):
        raise ValueError("dims must be a permutation")
    strides = [1] * len(shape)
    for k in range(len(shape) - 2, -1, -1):
        strides[k] = strides[k + 1] * shape[k + 1]
    order = [0]
    for d in dims:
        order = [o + i * strides[d] for o in order for i in range(shape[d])]
    return F.transform(F.array(*[F.lit(o) for o in order]), lambda i: F.get(_col(data), i)) if order else _col(data)


def transpose(data, rows: int, columns: int) -> Column:
    i = F.sequence(F.lit(0), F.lit(rows * columns - 1))
    return F.transform(i, lambda k: F.get(_col(data), (k % rows * columns + F.floor(k / rows)).cast("int")))


def flatten_shape(shape, start: int = 0, end: int = -1) -> Column:
    s = _col(shape)
    last = F.size(s) + end if end < 0 else F.lit(end)
    merged = F.aggregate(F.slice(s, F.lit(start + 1), last - start + 1), F.lit(1).cast("bigint"), lambda a, d: a * d)
    return F.concat(F.slice(s, 1, start) if start else F.slice(s, F.lit(1), F.lit(0)), F.array(merged), F.slice(s, last + 2, F.size(s) - last - 1))


def squeeze_shape(shape, dim: int | None = None) -> Column:
    s = _col(shape)
    if dim is None:
        return F.filter(s, lambda d: d != 1)
    at = F.lit(dim) if dim >= 0 else F.size(s) + dim
    return F.filter(s, lambda d, i: ~((i == at) & (d == 1)))


def unsqueeze_shape(shape, dim: int) -> Column:
    return F.array_insert(_col(shape), F.lit(dim + 1), F.lit(1).cast("bigint")) if dim >= 0 else F.array_insert(_col(shape), F.size(_col(shape)) + dim + 2, F.lit(1).cast("bigint"))


# reductions over all elements


def total(data) -> Column:
    return fold(data, lambda acc, x: acc + x)


def mean(data) -> Column:
    return F.try_divide(total(data), F.size(_col(data)))


def variance(data, unbiased: bool = False) -> Column:
    squares = bound(mean(data), lambda centre: F.aggregate(_col(data), F.lit(0.0), lambda acc, x: acc + (x.cast("double") - centre) * (x.cast("double") - centre)))
    return F.try_divide(squares, F.size(_col(data)) - (1 if unbiased else 0))


def std(data, unbiased: bool = False) -> Column:
    return F.sqrt(variance(data, unbiased))


# norms


def l1_norm(data) -> Column:
    return fold(data, lambda acc, x: acc + F.abs(x))


def frobenius_norm(data) -> Column:
    return F.sqrt(fold(data, lambda acc, x: acc + x * x))


def linf_norm(data) -> Column:
    return fold(data, lambda acc, x: F.greatest(acc, F.abs(x)))


def p_norm(data, p: float) -> Column:
    if p <= 0:
        raise ValueError("p must be positive")
    return F.pow(fold(data, lambda acc, x: acc + F.pow(F.abs(x), F.lit(float(p)))), F.lit(1.0 / p))


def sparsity(data) -> Column:
    return F.try_divide(fold(data, lambda acc, x: acc + (x == 0).cast("double")), F.size(_col(data)))


def trace(data, n) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + F.get(_col(data), (i * (n + 1)).cast("int")).cast("double"))


def is_symmetric(data, n: int, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    cells = F.array(*[F.struct(F.lit(i * n + j).alias("a"), F.lit(j * n + i).alias("b")) for i in range(n) for j in range(i)]) if n > 1 else None
    if cells is None:
        return F.lit(True)
    d = _col(data)
    return F.forall(cells, lambda c: F.abs(F.get(d, c["a"]).cast("double") - F.get(d, c["b"]).cast("double")) <= atol + rtol * F.abs(F.get(d, c["b"]).cast("double")))


# similarity of flattened tensors; the shorter one counts as padded with zeros


def _padded(a, b, op) -> Column:
    zero = F.lit(0.0)
    return F.zip_with(_col(a), _col(b), lambda x, y: op(F.coalesce(x.cast("double"), zero), F.coalesce(y.cast("double"), zero)))


def distance2(a, b) -> Column:
    return fold(_padded(a, b, lambda x, y: (x - y) * (x - y)), lambda acc, x: acc + x)


def inner(a, b) -> Column:
    return fold(_padded(a, b, lambda x, y: x * y), lambda acc, x: acc + x)


def frobenius_similarity(a, b) -> Column:
    return 1 / (1 + F.sqrt(distance2(a, b)))


def cosine_similarity(a, b) -> Column:
    na, nb = frobenius_norm(a), frobenius_norm(b)
    return F.when((na < 1e-10) | (nb < 1e-10), F.lit(0.0)).otherwise(F.try_divide(inner(a, b), na * nb))


def relative_similarity(a, query) -> Column:
    size = frobenius_norm(query)
    return F.when(size < 1e-10, 1 / (1 + F.sqrt(distance2(a, query)))).otherwise(1 / (1 + F.try_divide(F.sqrt(distance2(a, query)), size)))


def metric_distance(a, b, metric: str) -> Column:
    """l2 (squared), cosine (1 - cos) or dot (negated product)."""
    if metric == "l2":
        return distance2(a, b)
    if metric == "cosine":
        return 1 - cosine_similarity(a, b)
    if metric == "dot":
        return -inner(a, b)
    raise ValueError(f"unknown metric {metric}")


def score_of(distance: Column, metric: str) -> Column:
    return {"cosine": 1 - distance, "l2": 1 / (1 + distance), "dot": -distance}[metric]
