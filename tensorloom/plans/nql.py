"""The text query language: six forms, parsed into a small tree and compiled to DataFrame expressions.

    list datasets | count [records in] <dataset> | get all [records|tensors] from <dataset>
    find|get [records|tensors] from <dataset> where <field> <op> <value>        op: = == != < <= > >= is equals eq
    find|get [records|tensors] from <dataset> where tensor[[i]] <op> <number>

Typing of metadata: a missing or null entry never matches; a number against a string entry compares their text
for = and != only and fails for ranges; a quoted string against another kind of entry compares with its text
(booleans as True and False).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.operators.catalog import path

_THING = r"(?:\s*(?:all\s+)?(?:records|tensors|data|entries))?"
_FORMS = [
    ("list", re.compile(r"^(?:list|show)\s+(?:all\s+)?datasets\s*$", re.I)),
    ("count", re.compile(rf"^count{_THING}\s*(?:in|from)?\s+(?P<dataset>[\w.-]+)\s*$", re.I)),
    ("all", re.compile(rf"^(?:get|show|find)\s+(?:all\s*)?{_THING}\s*from\s+(?P<dataset>[\w.-]+)\s*$", re.I)),
    ("tensor", re.compile(rf"^(?:find|get|show){_THING}\s+from\s+(?P<dataset>[\w.-]+)\s+where\s+tensor(?:\s+value)?\s*(?:\[\s*(?P<index>\d+)\s*\])?\s*(?P<op>==|!=|<=|>=|=|<|>)\s*(?P<value>.+?)\s*$", re.I)),
    ("meta", re.compile(rf"^(?:find|get|show){_THING}\s+from\s+(?P<dataset>[\w.-]+)\s+where\s+(?P<field>[\w.]+)\s*(?P<op>==|!=|<=|>=|=|<|>|\bis\b|\bequals\b|\beq\b)\s*(?P<value>.+?)\s*$", re.I)),
]


class QueryError(ValueError):
    """A text that isn't a query, or a dataset that isn't there."""


@dataclass(frozen=True)
class Query:
    form: str
    dataset: str | None = None
    field: str | None = None
    index: int | None = None
    op: str | None = None
    value: object = None
    quoted: bool = False


def literal(text: str) -> tuple[object, bool]:
    """The value of a literal and whether it was quoted: whole number, other number or text."""
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1], True
    try:
        number = float(text)
    except ValueError:
        return text, False
    return (int(number) if number.is_integer() else number), False


def parse(text: str) -> Query:
    for form, pattern in _FORMS:
        if m := pattern.match(text.strip()):
            g = m.groupdict()
            if "value" not in g:
                return Query(form, g.get("dataset"))
            value, quoted = literal(g["value"])
            op = {"is": "=", "equals": "=", "eq": "=", "==": "="}.get(g["op"].lower(), g["op"])
            if form == "tensor":
                if quoted or not isinstance(value, (int, float)):
                    raise QueryError(f"tensor elements are numbers, not {g['value']}")
                return Query(form, g["dataset"], index=int(g["index"]) if g["index"] else 0, op=op, value=value)
            return Query(form, g["dataset"], field=g["field"], op=op, value=value, quoted=quoted)
    raise QueryError(f"not a query: {text}")


def compare(x: Column, op: str, y) -> Column:
    y = y if isinstance(y, Column) else F.lit(y)
    return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def is_close(x: Column, value: float) -> Column:
    return F.abs(x - value) <= F.greatest(1e-6 * F.greatest(F.abs(x), F.lit(abs(float(value)))), F.lit(1e-9))


def metadata_test(metadata: str, field: str, op: str, value, quoted: bool) -> Column:
    """The typed comparison of an entry of a JSON metadata column."""
    entry = F.try_parse_json(F.col(metadata))
    where = "$." + field
    kind = F.schema_of_variant(F.try_variant_get(entry, where, "variant"))
    text = F.try_variant_get(entry, where, "string")
    as_text = F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)
    if isinstance(value, str) or quoted:
        # an unquoted word is a string as well
        test = compare(as_text, op, str(value))
    else:
        number = F.try_variant_get(entry, where, "double")
        numeric = compare(number, op, float(value)) if op not in ("=", "!=") else (number == float(value) if op == "=" else number != float(value))
        textual = compare(text, op, str(value)) if op in ("=", "!=") else F.lit(False)
        test = F.when(kind == "STRING", textual).when(kind == "BOOLEAN", compare((text == "true").cast("int"), op, value)).otherwise(numeric)
    return F.coalesce(test, F.lit(False))


def tensor_test(data: str, index: int, op: str, value: float) -> Column:
    """The comparison of one element; out of range is false, equality allows for rounding."""
    x = F.get(F.col(data), F.lit(index)).cast("double")
    close = is_close(x, value)
    test = {"=": close, "!=": ~close}.get(op)
    return F.coalesce(compare(x, op, float(value)) if test is None else test, F.lit(False))


def condition(query: Query, metadata: str = "metadata", data: str = "data") -> Column:
    if query.form == "tensor":
        return tensor_test(data, query.index, query.op, query.value)
    return metadata_test(metadata, query.field, query.op, query.value, query.quoted) if query.form == "meta" else F.lit(True)


def run(tensors: DataFrame, text: str) -> DataFrame:
    """Compiles a query over a table of tensors (dataset, metadata, data, ...)."""
    q = parse(text)
    if q.form == "list":
        return tensors.select("dataset").distinct()
    own = tensors.where(F.col("dataset") == q.dataset)
    if own.limit(1).isEmpty():
        raise QueryError(f"no dataset {q.dataset}")
    return own.agg(F.count("*").alias("count")) if q.form == "count" else own.where(condition(q))


def tree(parsed: dict, metadata: str = "metadata", data: str = "data") -> Column:
    """The condition of a parsed filter {filters: [{joiner: AND|OR, conditions: [{key, operator, value}]}]}; unknown operators are ignored."""

    def one(c: dict) -> Column | None:
        op = {"is": "=", "equals": "=", "eq": "=", "==": "="}.get(str(c["operator"]).lower(), c["operator"])
        if op not in ("=", "!=", "<", "<=", ">", ">="):
            return None
        if m := re.fullmatch(r"tensor(?:\[(\d+)\])?", c["key"]):
            return tensor_test(data, int(m[1] or 0), op, c["value"])
        return metadata_test(metadata, c["key"], op, c["value"], isinstance(c["value"], str))

    out = F.lit(True)
    for clause in parsed.get("filters", []):
        tests = [t for c in clause["conditions"] if (t := one(c)) is not None]
        if tests:
            either = str(clause.get("joiner", "AND")).upper() == "OR"
            out &= reduce((lambda a, b: a | b) if either else (lambda a, b: a & b), tests)
    return out


def run_tree(tensors: DataFrame, parsed: dict) -> DataFrame:
    """A parsed query {dataset, filters} over a table of tensors: what a language model, or a form, hands in."""
    if not isinstance(parsed.get("dataset"), str) or not isinstance(parsed.get("filters", []), list):
        raise QueryError("a parsed query has a dataset and a list of filters")
    for clause in parsed.get("filters", []):
        if not isinstance(clause, dict) or not all(isinstance(c, dict) and {"key", "operator", "value"} <= set(c) for c in clause.get("conditions", [None])):
            raise QueryError("a filter has conditions with key, operator and value")
    own = tensors.where(F.col("dataset") == parsed["dataset"])
    if own.limit(1).isEmpty():
        raise QueryError(f"no dataset {parsed['dataset']}")
    return own.where(tree(parsed))


def understood(tensors: DataFrame, text: str, complete: Callable[[str], str] | None = None, schema: dict | None = None) -> DataFrame:
    """A query in words: by the grammar, else by a language model that answers with a parsed query as JSON.

    complete: from a prompt to a text. An answer that is no parsed query is a ``QueryError``.
    """
    try:
        return run(tensors, text)
    except QueryError:
        if complete is None:
            raise
    prompt = "Answer with JSON only: {\"dataset\": name, \"filters\": [{\"joiner\": \"AND\" or \"OR\", \"conditions\": [{\"key\", \"operator\", \"value\"}]}]}.\n"
    prompt += f"Datasets and their fields: {json.dumps(schema or {}, sort_keys=True)}\nQuestion: {text}"
    answer = complete(prompt)
    try:
        parsed = json.loads(answer[answer.index("{") : answer.rindex("}") + 1])
    except ValueError:
        raise QueryError(f"no parsed query: {answer[:200]}") from None
    return run_tree(tensors, parsed)


def path_equals(metadata: str, filters: dict) -> Column:
    """AND of equalities with metadata entries; in a list entry any element may match; a missing entry doesn't match."""
    out = F.lit(True)
    for key, value in filters.items():
        entry = path(metadata, key)
        listed = F.from_json(entry, "array<string>")
        text = str(value).lower() if isinstance(value, bool) else str(value)
        out &= F.coalesce(F.when(entry.startswith("["), F.array_contains(listed, text)).otherwise(entry == text), F.lit(False))
    return out
