"""Edges of a dataflow graph as filters over whole levels of steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braid.sources.staging import small


def when_edges(steps: DataFrame, edges: Sequence[tuple[str, Column | None]], target: str = "target") -> DataFrame:
    """A row for every edge whose predicate holds (none: always), with its target and ordinal. One scan for all edges.

    A null predicate does not hold.
    """
    hits = F.filter(
        F.array(*[F.struct(F.lit(i).alias("edge"), F.lit(to).alias("target"), F.coalesce(cond, F.lit(False)).alias("ok") if cond is not None else F.lit(True).alias("ok")) for i, (to, cond) in enumerate(edges)]),
        lambda e: e["ok"],
    )
    return steps.withColumn("edge_", F.explode(hits)).select(*steps.columns, F.col("edge_.edge").alias("edge"), F.col("edge_.target").alias(target))


def switch_edge(steps: DataFrame, edges: Sequence[tuple[str, Column]], target: str = "target") -> DataFrame:
    """Every row with the target of the first case that holds, in order; null where none does (the flow ends)."""
    choice = F
    for to, cond in edges:
        choice = choice.when(cond, F.lit(to))
    return steps.withColumn(target, choice)


def goto_edges(steps: DataFrame, wanted: str, edges: DataFrame, target: str = "target", error: str = "error") -> DataFrame:
    """Rows that ask for a goto get its target; an edge that does not exist fails the step. edges: (from_task, to_task)."""
    known = edges.select(F.col("from_task").alias("f_"), F.col("to_task").alias("t_"))
    out = steps.join(small(known, "edges"), (F.col("task_name") == F.col("f_")) & (F.col(wanted) == F.col("t_")), "left")
    return out.select(*steps.columns, F.col("t_").alias(target), F.when(F.col(wanted).isNotNull() & F.col("t_").isNull(), F.concat(F.lit("no goto edge to "), F.col(wanted))).alias(error))


def for_each(spawns: DataFrame, items: Column, name: str = "item") -> DataFrame:
    """A branch for each element: <name>, <name>Index, <name>Count, and the fan-out ordinal.

    An absent, null or empty array spawns none; the fan-in of such a spawn fires by itself (``reducers.fan_in``).
    """
    at, item = f"{name}Index", name
    out = spawns.withColumn(f"{name}Count", F.size(items)).select("*", F.posexplode(items).alias(at, item))
    return out.withColumn("fan_out_ordinal", F.col(at))


def strip(branches: DataFrame, name: str) -> DataFrame:
    """Branches without the bookkeeping of one ``for_each``."""
    return branches.drop(name, f"{name}Index", f"{name}Count")


def on_error(steps: DataFrame, error: Column, changes: Sequence[str], handler: str, onward: str, target: str = "target") -> DataFrame:
    """Failed steps go to the handler with ``onErr``, their changes void; others go on."""
    failed = error.isNotNull()
    out = steps.withColumn("onErr", error).withColumn(target, F.when(failed, F.lit(handler)).otherwise(F.lit(onward)))
    return out.withColumns({c: F.when(F.col("onErr").isNotNull(), None).otherwise(F.col(c)) for c in changes})


def dead_ends(steps: DataFrame, routed: DataFrame, key: str = "step_id") -> DataFrame:
    """Steps without an onward edge: inside a cohort (lineage_id <> 0) they fail, outside their flow is complete."""
    left = steps.join(routed.select(key).distinct(), key, "left_anti")
    return left.withColumn("outcome", F.when(F.col("lineage_id") != 0, "failed").otherwise("completed"))


def exit_steps(steps: DataFrame, predecessors: Sequence[str]) -> DataFrame:
    return steps.filter(F.col("task_name").isin(*predecessors) & (F.col("successor_id") == 0))


def retry(steps: DataFrame, error: Column, max_attempts: int) -> DataFrame:
    """Failed steps with attempts left are rewound in place; the others fail. The attempt counts from 0."""
    again = error.isNotNull() & (F.col("attempt") + 1 < max_attempts)
    return steps.withColumn("status", F.when(again, "pending").when(error.isNotNull(), "failed").otherwise("completed")).withColumn("attempt", F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")))
