"""Query plans as data: Scan, IndexLookup, VectorSearch and Aggregate, from tagged JSON to a DataFrame."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import descriptor
from tensorloom.operators import search

DEFAULT_LIMIT = 100


@dataclass(frozen=True)
class Scan:
    dataset: str
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class IndexLookup:
    dataset: str
    predicates: tuple = ()
    limit: int | None = None


@dataclass(frozen=True)
class VectorSearch:
    dataset: str
    query: tuple
    k: int = 10
    metric: str = "cosine"


@dataclass(frozen=True)
class Aggregate:
    dataset: str
    function: str
    field: str = ""
    predicates: tuple = ()


KINDS = {"scan": Scan, "index_lookup": IndexLookup, "vector_search": VectorSearch, "aggregate": Aggregate}


def parse(plan: str | dict):
    """A plan from its tagged JSON, e.g. {"op": "scan", "dataset": "d"}; predicates are {field, op, value}."""
    data = dict(json.loads(plan) if isinstance(plan, str) else plan)
    kind = KINDS.get(data.pop("op", None))
    if kind is None:
        raise ValueError("a plan's op is one of " + ", ".join(KINDS))
    if "predicates" in data:
        data["predicates"] = tuple((p["field"], p["op"], p["value"]) for p in data["predicates"])
    if "query" in data:
        data["query"] = tuple(data["query"])
    try:
        return kind(**data)
    except TypeError as error:
        raise ValueError(str(error)) from None


def optimized(plan):
    """Scans get the default limit; equalities come before ranges."""
    if isinstance(plan, Scan) and plan.limit is None:
        return replace(plan, limit=DEFAULT_LIMIT)
    if isinstance(plan, (IndexLookup, Aggregate)):
        return replace(plan, predicates=tuple(sorted(plan.predicates, key=lambda p: descriptor.OPS.get(p[1], "") != "=")))
    return plan


def compiled(plan, tensors: DataFrame, order: str = "seq", key: str = "tensor_id") -> DataFrame:
    """The plan over a described table of tensors (dataset, seq, data, descriptor columns)."""
    plan = optimized(parse(plan) if isinstance(plan, (str, dict)) else plan)
    rows = tensors.where(F.col("dataset") == plan.dataset)
    for predicate in getattr(plan, "predicates", ()):
        rows = rows.where(descriptor.predicate(*predicate))
    match plan:
        case Scan():
            return rows.orderBy(order).offset(plan.offset).limit(plan.limit)
        case IndexLookup():
            out = rows.orderBy(order)
            return out if plan.limit is None else out.limit(plan.limit)
        case VectorSearch():
            return search.nearest(rows, list(plan.query), plan.k, plan.metric, tie=key)
        case Aggregate():
            return descriptor.aggregate(rows, plan.function, plan.field)


def index_advice(log: DataFrame, hot: int = 5) -> DataFrame:
    """(field, n, mean_ms) of the fields queried most in a log of (field, latency_ms)."""
    return log.groupBy("field").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_ms")).orderBy(F.desc("n"), "field").limit(hot)


def ucb(arms: dict[str, tuple[int, float]], indexed: set[str] = frozenset(), weight: float = 1.4) -> str | None:
    """The field to index next: unseen ones first, else the highest mean reward plus exploration; arms: field -> (n, mean)."""
    import math

    open_ = {f: a for f, a in arms.items() if f not in indexed}
    if not open_:
        return None
    unseen = sorted(f for f, (n, _) in open_.items() if not n)
    if unseen:
        return unseen[0]
    total = sum(n for n, _ in arms.values())
    return max(sorted(open_), key=lambda f: open_[f][1] + weight * math.sqrt(math.log(total) / open_[f][0]))
