"""Graphs and tasks by name, and calls of one graph by another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.functions import state as st
from braid.plans.executor import Task, run, run_maps
from braid.plans.graph import Graph
from braid.sources.staging import by_key


class Registry:
    """What a host offers: graphs by name and tasks by node."""

    def __init__(self):
        self.graphs: dict[str, Graph] = {}
        self.tasks: dict[str, Task] = {}

    def graph(self, g: Graph) -> Registry:
        self.graphs[g.name] = g.validate()
        return self

    def task(self, node: str, task: Task) -> Registry:
        self.tasks[node] = task
        return self

    def run(self, name: str, flows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(outcomes, steps) of a graph for flows (flow_id, state)."""
        return run(self.graphs[name], flows, self._tasks(name))

    def _tasks(self, name: str) -> dict[str, Task]:
        return {n: t for n, t in self.tasks.items() if n in self.graphs[name].urls}

    def call(self, name: str, rows: DataFrame, inputs: dict[str, str], outputs: dict[str, str]) -> DataFrame:
        """Rows (flow_id, state, ...) with a child graph's fields in their state, and ``error`` where the child failed.

        inputs: child field -> field of the caller; outputs: field of the caller -> child field. Nothing else crosses.
        """
        own = st.entries(F.col("state"))
        given = F.map_from_arrays(F.array(*[F.lit(k) for k in inputs]), F.array(*[F.element_at(own, v) for v in inputs.values()])) if inputs else F.map_filter(own, lambda k, v: F.lit(False))
        out, _ = run_maps(self.graphs[name], rows.select("flow_id", F.map_filter(given, lambda k, v: v.isNotNull()).alias("state")), self._tasks(name))
        # of what the child ended with, only the fields that cross are parsed
        crossing = F.transform_values(F.map_filter("state", lambda k, v: k.isin(*outputs.values())), lambda k, v: F.to_json(F.try_parse_json(v)))
        back = out.select("flow_id", F.col("status").alias("s_"), crossing.alias("r_"), F.col("error").alias("e_"))
        # Spark may take either side for small by its compressed bytes, so both are shuffled into tasks of bounded rows
        joined = by_key(rows, "flow_id").join(by_key(back, "flow_id").hint("merge"), "flow_id", "left")
        taken = F.map_from_arrays(F.array(*[F.lit(k) for k in outputs]), F.array(*[F.element_at("r_", v) for v in outputs.values()])) if outputs else F.map_filter("r_", lambda k, v: F.lit(False))
        new = st.encode(st.overlay(own, F.map_filter(taken, lambda k, v: v.isNotNull())))
        return joined.select(*[c for c in rows.columns if c not in ("state", "error")], F.when(F.col("s_") == "completed", new).otherwise(F.col("state")).alias("state"), F.when(F.col("s_") == "failed", F.col("e_")).alias("error"))
