"""Dataflow graphs: built in Python, checked on the driver, stored as JSON, drawn as Mermaid, listed as small tables."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from braid.functions.scalars import mermaid_escape
from braid.operators.reducers import REDUCERS
from braid.plans.predicate import PredicateError, compiled

END = "END"


class GraphError(ValueError):
    """A graph that cannot run."""


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    when: str = ""
    goto: bool = False
    for_each: str = ""
    item: str = ""
    on_error: bool = False
    switch: bool = False

    @property
    def control(self) -> bool:
        """Chosen by the task at run time, and so no branch of a fan-out."""
        return self.goto or self.on_error or self.switch


class Graph:
    """Nodes in order of registration, edges in order of registration, fan-in nodes and reducers."""

    def __init__(self, name: str, entry: str = ""):
        self.name, self.entry = name, entry
        self.urls: dict[str, str] = {}
        self.edges: list[Edge] = []
        self.fan_ins: set[str] = set()
        self.reducers: dict[str, str] = {}

    # ---- building

    def node(self, name: str, url: str = "") -> Graph:
        if name != END:
            self.urls[name] = url or self.urls.get(name) or name
            self.entry = self.entry or name
        return self

    def edge(self, source: str, target: str, **kind) -> Graph:
        self.node(source).node(target)
        self.edges.append(Edge(source, target, **kind))
        return self

    def chain(self, *names: str) -> Graph:
        for a, b in zip(names, names[1:]):
            self.edge(a, b)
        return self

    def fan_out(self, source: str, *targets: str) -> Graph:
        for t in targets:
            self.edge(source, t)
        return self

    def fan_in(self, *names: str) -> Graph:
        self.fan_ins.update(names)
        return self

    def reduce(self, **reducers: str) -> Graph:
        self.reducers |= reducers
        return self

    # ---- looking

    def leaving(self, node: str) -> list[Edge]:
        return [e for e in self.edges if e.source == node]

    def error_edge(self, node: str) -> Edge | None:
        return next((e for e in self.leaving(node) if e.on_error), None)

    def fans_out(self, node: str) -> bool:
        plain = [e for e in self.leaving(node) if not e.control]
        return len(plain) > 1 or any(e.for_each for e in plain)

    # ---- checking

    def problems(self) -> Iterator[str]:
        """What is wrong with the parts; an empty list does not yet mean that branches converge."""
        if not self.name:
            yield "the graph has no name"
        if not self.urls:
            yield "the graph has no tasks"
            return
        if self.entry not in self.urls:
            yield f"entry point {self.entry!r} is no node"
        yield from (f"fan-in {n!r} is no node" for n in sorted(self.fan_ins - self.urls.keys()))
        yield from (f"field {f!r} has the unknown reducer {r!r}" for f, r in self.reducers.items() if r not in REDUCERS)
        for e in self.edges:
            yield from (f"{e.source} -> {e.target}: {what}" for what in self._edge_problems(e))
        for n in self.urls:
            leaving = self.leaving(n)
            if sum(e.on_error for e in leaving) > 1:
                yield f"{n} has several error edges"
            if any(e.switch for e in leaving) and any(not e.control for e in leaving):
                yield f"{n} mixes switch edges with others on its success path"
        lost = self.urls.keys() - self.reachable()
        yield from (f"{n} cannot be reached" for n in self.urls if n in lost)
        if not any(e.target == END for e in self.edges):
            yield "nothing leads to the end"

    def _edge_problems(self, e: Edge) -> Iterator[str]:
        kinds = [k for k, on in (("forEach", e.for_each), ("goto", e.goto), ("onError", e.on_error), ("switch", e.switch)) if on]
        if e.source == END:
            yield "the end has no way out"
        if len(kinds) > 1:
            yield f"cannot be {' and '.join(kinds)} at once"
        if e.item and not e.for_each:
            yield "names an item without forEach"
        if e.on_error and e.when:
            yield "an error edge is unconditional"
        if e.on_error and e.source == e.target:
            yield "an error edge to itself never ends"
        if e.switch and not e.when:
            yield "a switch edge needs a condition"
        if e.when:
            try:
                compiled(e.when)
            except PredicateError as x:
                yield f"condition {e.when!r}: {x}"

    def reachable(self) -> set[str]:
        seen, todo = set(), [self.entry]
        while todo:
            if (n := todo.pop()) not in seen and n != END:
                seen.add(n)
                todo += [e.target for e in self.leaving(n)]
        return seen

    def convergence(self) -> dict[str, str]:
        """Fan-in of each fan-out. A node is known by the open fan-outs on the way to it, which must be the same on all."""
        open_at: dict[str, tuple[str, ...]] = {self.entry: ()}
        found: dict[str, str] = {}
        todo = deque([self.entry])
        while todo:
            n = todo.popleft()
            for e in self.leaving(n):
                frames = open_at[n]
                if e.target in self.fan_ins:
                    if self.fans_out(n):
                        frames = (*frames, n)
                    if not frames:
                        raise GraphError(f"{n} -> {e.target}: no fan-out is open there")
                    *rest, source = frames
                    if found.setdefault(source, e.target) != e.target:
                        raise GraphError(f"branches of {source} meet in {found[source]} and in {e.target}")
                    frames = tuple(rest)
                elif self.fans_out(n) and not e.control:
                    frames = (*frames, n)
                if e.target == END:
                    if frames:
                        raise GraphError(f"{n} -> end: the branches of {', '.join(frames)} have not met")
                elif e.target not in open_at:
                    open_at[e.target] = frames
                    todo.append(e.target)
                elif open_at[e.target] != frames:
                    raise GraphError(f"{e.target} is reached inside of different fan-outs; give it another name on one way")
        if left := [n for n in open_at if self.fans_out(n) and n not in found]:
            raise GraphError(f"the branches of {left[0]} never meet")
        return found

    def validate(self) -> Graph:
        if first := next(self.problems(), None):
            raise GraphError(f"{self.name or 'graph'}: {first}")
        self.convergence()
        return self

    # ---- JSON

    def to_json(self) -> str:
        named = {"source": "from", "target": "to", "when": "when", "goto": "withGoto", "for_each": "forEach", "item": "as", "on_error": "onError", "switch": "switch"}
        return json.dumps({
            "name": self.name, "entryPoint": self.entry,
            "tasks": [{"name": n, "url": u} | ({"fanIn": True} if n in self.fan_ins else {}) for n, u in self.urls.items()],
            "transitions": [{named[k]: v for k, v in asdict(e).items() if v} for e in self.edges], "reducers": self.reducers,
        })

    @classmethod
    def from_json(cls, text: str) -> Graph:
        raw = json.loads(text)
        g = cls(raw["name"], raw.get("entryPoint", ""))
        for t in raw.get("tasks") or ():
            g.node(t["name"], t.get("url", ""))
            if t.get("fanIn"):
                g.fan_in(t["name"])
        for t in raw.get("transitions") or ():
            g.edge(t["from"], t["to"], when=t.get("when", ""), goto=t.get("withGoto", False), for_each=t.get("forEach", ""), item=t.get("as", ""), on_error=t.get("onError", False), switch=t.get("switch", False))
        return g.reduce(**(raw.get("reducers") or {}))

    # ---- tables and drawing

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, transitions, reducers), small and fixed for a run."""
        return (
            spark.createDataFrame([(n, u, n in self.fan_ins, self.fans_out(n)) for n, u in self.urls.items()], "name string, url string, fan_in boolean, fan_out boolean"),
            spark.createDataFrame([(i, e.source, e.target, e.when, e.goto, e.for_each, e.item, e.on_error, e.switch) for i, e in enumerate(self.edges)], "ordinal int, from_task string, to_task string, when string, goto boolean, for_each string, item string, on_error boolean, switch boolean"),
            spark.createDataFrame(sorted(self.reducers.items()), "field string, reducer string"),
        )

    def mermaid(self) -> str:
        ids = {n: f"n{i}" for i, n in enumerate([*self.urls, END])}
        lines = ["flowchart TD"]
        for n in self.urls:
            text = f'"{mermaid_escape(n)}"'
            choice = any(e.switch or e.when for e in self.leaving(n))
            lines.append(f"  {ids[n]}" + (f"(({text}))" if n in self.fan_ins else "{" + text + "}" if choice else f"[{text}]"))
        lines.append(f"  {ids[END]}([end])")
        for e in self.edges:
            label = "goto" if e.goto else "error" if e.on_error else f"for each {e.for_each}" if e.for_each else ("default" if e.when == "true" else f"case {e.when}") if e.switch else f"when {e.when}" if e.when else ""
            arrow = f'-->|"{mermaid_escape(label)}"|' if label else "-->"
            lines.append(f"  {ids[e.source]} {arrow} {ids[e.target]}")
        return "\n".join(lines)
