"""Tools by name over a store, for agents and services: each has a name, a description, a schema and ``execute``."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from tensorloom.functions import descriptor
from tensorloom.plans import nql, plan
from tensorloom.sources.store import Store


class ToolError(ValueError):
    pass


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    #: JSON types by argument; those that end in ? may be left out.
    schema: dict[str, str]
    run: Callable

    def execute(self, arguments: dict | str) -> str:
        """The result as JSON text; wrong arguments are a ``ToolError``."""
        given = json.loads(arguments) if isinstance(arguments, str) else dict(arguments)
        kinds = {"string": str, "integer": int, "number": (int, float), "array": list, "object": dict}
        for name, kind in self.schema.items():
            if name not in given:
                if not kind.endswith("?"):
                    raise ToolError(f"{self.name} needs {name}")
            elif not isinstance(given[name], kinds[kind.rstrip("?")]) or isinstance(given[name], bool):
                raise ToolError(f"{self.name}: {name} isn't of type {kind.rstrip('?')}")
        if unknown := set(given) - set(self.schema):
            raise ToolError(f"{self.name} doesn't know {', '.join(sorted(unknown))}")
        return json.dumps(self.run(**given), default=str)


#: Rows that a tool returns at most: its answer goes into a conversation.
MOST_ROWS = 100


def toolset(store: Store) -> dict[str, Tool]:
    """list_datasets, scan, get, property_search, aggregate and query over the datasets of a store."""

    def rows(df, columns: list[str]) -> list[dict]:
        return [r.asDict(True) for r in df.select(*columns).limit(MOST_ROWS).collect()]

    def described(dataset: str):
        return descriptor.described(store.read(dataset))

    def scan(dataset: str, limit: int = 10, offset: int = 0):
        return rows(store.page(dataset, offset, limit), ["tensor_id", "shape", "metadata"])

    def get(dataset: str, tensor_id: str):
        return store.get(dataset, tensor_id).asDict(True)

    def property_search(dataset: str, field: str, op: str, value: float, limit: int = 10):
        return rows(described(dataset).where(descriptor.predicate(field, op, value)).orderBy("seq").limit(limit), ["tensor_id", "shape", field])

    def aggregate(dataset: str, function: str, field: str = "frobenius_norm"):
        return descriptor.aggregate(described(dataset), function, field).first().value

    def query(text: str):
        every = None
        for name in store.datasets():
            part = store.read(name)
            every = part if every is None else every.unionByName(part)
        return rows(nql.run(every, text), ["*"])

    def run_plan(plan_: dict):
        return rows(plan.compiled(plan_, described(plan_["dataset"])), ["*"])

    tools = [
        Tool("list_datasets", "Names of all datasets.", {}, store.datasets),
        Tool("scan", "A page of a dataset's tensors.", {"dataset": "string", "limit": "integer?", "offset": "integer?"}, scan),
        Tool("get", "One tensor by its id.", {"dataset": "string", "tensor_id": "string"}, get),
        Tool("property_search", "Tensors whose property meets a test.", {"dataset": "string", "field": "string", "op": "string", "value": "number", "limit": "integer?"}, property_search),
        Tool("aggregate", "An aggregate of a property.", {"dataset": "string", "function": "string", "field": "string?"}, aggregate),
        Tool("query", "A query in words.", {"text": "string"}, query),
        Tool("plan", "A plan as an object.", {"plan_": "object"}, run_plan),
    ]
    return {t.name: t for t in tools}


def react(task: str, tools: dict[str, Tool], decide: Callable[[str, list[dict]], dict], most: int = 8) -> dict:
    """A loop of thought, tool and observation until ``decide`` answers or ``most`` steps are done.

    ``decide`` (a language model, or rules) sees the task and the steps so far and returns {"answer": ...} or
    {"tool": name, "arguments": {...}}. A failing tool's message is its observation.
    """
    steps: list[dict] = []
    for _ in range(most):
        choice = decide(task, steps)
        if "answer" in choice:
            return {"answer": choice["answer"], "steps": steps}
        name = choice.get("tool")
        try:
            seen = tools[name].execute(choice.get("arguments", {})) if name in tools else f"unknown tool {name}"
        except Exception as error:  # the agent sees what went wrong
            seen = f"error: {str(error).splitlines()[0]}"
        steps.append({"tool": name, "arguments": choice.get("arguments", {}), "observation": seen})
    return {"answer": None, "steps": steps}


def routed(providers: list[tuple[str, float, Callable[[str], str]]], prompt: str, budget: float) -> tuple[str, str]:
    """(provider, text) from the cheapest provider within the budget that answers; the next one if it fails."""
    problems = []
    for name, cost, complete in sorted(providers, key=lambda p: (p[1], p[0])):
        if cost > budget:
            problems.append(f"{name} costs {cost}")
            continue
        try:
            return name, complete(prompt)
        except Exception as error:  # a provider that fails is passed over
            problems.append(f"{name}: {error}")
    raise ToolError("no provider answered: " + "; ".join(problems))


def answers(rows, limit: int = 10) -> list[str]:
    """Rows as short texts for a conversation."""
    return [json.dumps(r.asDict(True), default=str) for r in rows.orderBy(F.col(rows.columns[0])).limit(limit).collect()]
