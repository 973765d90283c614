"""Runs a graph over many flows at once: each level of steps of all flows is one DataFrame.

A task is a function from a state column (MAP of field to JSON text) to a column of changes, so it stays in the JVM; the
changes may hold ``$error`` (the task failed, its other changes are void) or ``$goto`` (JSON text of a node name). A level
evaluates the tasks of all its nodes in one projection, routes by one array of branches per step, and is staged; those tables
are the log of steps, and only the members of open cohorts are carried on. A fan-in fires when no branch of its cohort is
under way: the changes of its completed members, in fold order, are reduced onto the state of the spawn in one aggregation
for all cohorts of the level. What a flow ends with is the merge of its last steps, of all flows at once; in a graph without
fan-outs and reducers it is what its one last step left.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braid.functions import state as st
from braid.operators import states as sts
from braid.plans.graph import END, Edge, Graph
from braid.plans.predicate import compiled
from braid.sources.staging import appended, batches, staged

Task = Callable[[Column], Column]

#: Levels at which no cohort meets, before what waits is written again: until then it is a union of that many staged tables.
UNSTAGED = 8

_FRAME = "array<struct<spawn:string,ordinal:int>>"
_WAITING = "flow_id long, path string, node string, frames " + _FRAME + ", depth int, state map<string,string>, delta map<string,string>"
_MEMBER = "flow_id long, spawn string, o struct<ordinal:int,depth:int,path:string>, delta map<string,string>, status string, error string"


def _chosen(g: Graph, e: Edge, earlier: list[Edge], state: Column, goto: Column, failed: Column) -> Column:
    """Whether a step of the edge's source takes it."""
    here = (F.col("node") == e.source) & (failed if e.on_error else ~failed)
    if e.on_error:
        return here
    if e.goto:
        return here & F.coalesce(goto == e.target, F.lit(False))
    here &= goto.isNull()
    text = st.encode(state)
    if e.when:
        here &= compiled(e.when)(text)
    for x in earlier if e.switch else ():
        here &= ~compiled(x.when)(text)
    return here


def _each(items: Column, one: Callable[..., Column]) -> Column:
    return F.transform(items, lambda x, k: one(x, k, F.size(items)))


def _branches(g: Graph, state: Column, goto: Column, failed: Column) -> Column:
    """array of (target, item, name, at, count, push), in order of edges and elements."""
    out = []
    for i, e in enumerate(g.edges):
        earlier = [x for x in g.edges[:i] if x.source == e.source and x.switch]
        push = g.fans_out(e.source) and not e.control
        one = lambda item, at, n, e=e, push=push: F.struct(F.lit(e.target).alias("target"), item.alias("item"), F.lit(e.item or "item").alias("name"), at.alias("at"), n.alias("count"), F.lit(push).alias("push"), F.lit(bool(e.for_each)).alias("each"), F.lit(e.on_error).alias("error"))
        if e.for_each:
            value = F.element_at(state, e.for_each)
            items = F.when(F.coalesce(value.startswith("["), F.lit(False)), sts.elements(value)).otherwise(F.array().cast("array<string>"))
            rows = _each(items, one)
        else:
            rows = F.array(one(F.lit(None).cast("string"), F.lit(0), F.lit(0)))
        out.append(F.when(_chosen(g, e, earlier, state, goto, failed), rows).otherwise(F.filter(rows, lambda x: F.lit(False))))
    return F.flatten(F.array(*out))


def _unspread(g: Graph, state: Column, goto: Column, failed: Column) -> Column:
    """JSON text of the error of a step whose forEach field is no array; null where all are (or are absent or null)."""
    out = [F.lit(None).cast("string")]
    for i, e in enumerate(g.edges):
        if e.for_each:
            earlier = [x for x in g.edges[:i] if x.source == e.source and x.switch]
            value = F.coalesce(F.element_at(state, e.for_each), F.lit("null"))
            out.append(F.when(_chosen(g, e, earlier, state, goto, failed) & (value != "null") & ~value.startswith("["), sts.quoted(F.lit(f"forEach field '{e.for_each}' is not an array"))))
    return F.coalesce(*out)


def _spreads(g: Graph) -> dict[str, list[str]]:
    """The fields that a node's fan-out gives to each of its branches."""
    return {n: [f"{e.item or 'item'}{x}" for e in g.leaving(n) if e.for_each for x in ("", "Index", "Count")] for n in g.urls if any(e.for_each for e in g.leaving(n))}


def _straight(g: Graph) -> bool:
    """Whether every step is followed by one step at most, and what a flow ends with is no fold by reducers."""
    gotos = [(e.source, e.target) for e in g.edges if e.goto]
    return not g.reducers and not any(g.fans_out(n) for n in g.urls) and len(set(gotos)) == len(gotos)


def _outcomes(ends: DataFrame) -> DataFrame:
    return ends.select("flow_id", "status", "state", sts.text_of(F.when(F.col("status") == "failed", F.col("error"))).alias("error"))


def run(graph: Graph, flows: DataFrame, tasks: dict[str, Task], max_levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, steps) of a graph for flows (flow_id, state as JSON text); outcomes hold states as JSON text, else as in ``run_maps``."""
    out, steps = run_maps(graph, flows.withColumn("state", st.entries(F.col("state"))), tasks, max_levels)
    return out.withColumn("state", st.encode(F.col("state"))), steps


def run_maps(graph: Graph, flows: DataFrame, tasks: dict[str, Task], max_levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, steps) of a graph for flows (flow_id, state as MAP of field to JSON text).

    outcomes: flow_id, status (completed or failed), state as such a MAP, error. A node without a task changes nothing.
    A failed branch fails its cohort when the last branch of it has arrived, and so on outward; the flow fails with the
    first error by branch. Levels run until no flow is under way; a stated ``max_levels`` that is reached before is an error.
    """
    graph.validate()
    meets, spark, spreads, straight = graph.convergence(), flows.sparkSession, _spreads(graph), _straight(graph)
    empty, frame = sts.no_fields(), F.try_element_at(F.col("frames"), F.lit(-1))
    log, ends = batches(spark, "log"), appended(spark, "ends", "flow_id long, status string, error string")
    level = flows.select(F.col("flow_id").cast("long").alias("flow_id"), F.lit(graph.entry).alias("path"), F.lit(graph.entry).alias("node"), F.array().cast(_FRAME).alias("frames"), F.lit(1).alias("depth"), F.coalesce("state", empty).alias("state"))
    waiting, members = spark.createDataFrame([], _WAITING), spark.createDataFrame([], _MEMBER)
    # the expressions of a level are the same for every level, so they are built once
    task_changes = F
    for node, task in tasks.items():
        task_changes = task_changes.when(F.col("node") == node, task(F.col("state")))
    delta = F.coalesce(task_changes.otherwise(empty) if tasks else empty, empty)
    error, goto = F.element_at("delta", "$error"), sts.text_of(F.element_at("delta", "$goto"))
    kept = F.when(F.col("error").isNotNull(), empty).otherwise(st.without(F.col("delta"), "$goto", "$error"))
    following = st.without_deleted(st.overlay(F.col("state"), F.col("delta")))
    unspread, branches = _unspread(graph, F.col("next"), F.col("goto"), F.col("failed")), _branches(graph, F.col("next"), F.col("goto"), F.col("failed"))
    spread = F.when(F.col("unspread").isNull(), F.col("branches")).otherwise(F.filter("branches", lambda b: F.lit(False)))
    handled = F.col("failed") & F.exists("branches", lambda b: b["error"])
    inside = F.size("frames") > 0
    spawner = F.col("node").isin(*meets) & ~F.col("failed") & F.col("goto").isNull() & F.col("unspread").isNull()
    stuck = ~F.col("failed") & (F.size("branches") == 0) & ~spawner & (inside | F.col("goto").isNotNull())  # a dead end inside a cohort, or a goto without its edge
    broken = stuck | (F.col("failed") & ~handled) | F.col("unspread").isNotNull()
    into = lambda b: b["target"].isin(*graph.fan_ins, "")
    flags = {"status": F.when(broken, "failed").otherwise("completed"), "error": F.coalesce("error", "unspread", F.when(stuck, sts.quoted(F.lit("no way on")))), "spawns": spawner, "arrives": F.exists("branches", into), "onward": F.exists("branches", lambda b: ~into(b) & (b["target"] != END))}
    over = ~inside & ((F.col("status") == "failed") | ~F.col("onward") & ~F.col("spawns"))
    extra = F.when(F.col("b.each"), F.map_from_arrays(F.array(F.col("b.name"), F.concat(F.col("b.name"), F.lit("Index")), F.concat(F.col("b.name"), F.lit("Count"))), F.array("b.item", F.col("b.at").cast("string"), F.col("b.count").cast("string")))).when(F.col("b.error"), F.create_map(F.lit("onErr"), F.col("error"))).otherwise(empty)
    pushed = F.concat("frames", F.array(F.struct(F.col("path").alias("spawn"), F.col("ordinal"))))
    branch = [F.concat("path", F.lit("/"), F.col("b.target"), F.lit("."), F.col("ordinal").cast("string")).alias("path"), F.col("b.target").alias("node"), F.when(F.col("b.push"), pushed).otherwise(F.col("frames")).alias("frames"), (F.col("depth") + 1).alias("depth"), st.overlay(F.col("next"), extra).alias("state")]
    for at in count(1):
        done = level.withColumn("delta", delta).withColumns({"error": error, "goto": goto}).withColumn("delta", kept).withColumns({"next": following, "failed": F.col("error").isNotNull()})
        done = done.withColumns({"unspread": unspread, "branches": branches}).withColumn("branches", spread)
        done = log.add(done.withColumns(flags))
        # flows that end here, and branches that go on; those into a fan-in have arrived
        if not straight:
            ends.add(done.filter(over).select("flow_id", "status", "error"))
        on = done.filter("status = 'completed'").select("*", F.posexplode("branches").alias("ordinal", "b")).filter((F.col("b.target") != END) & ~F.col("b.target").isin(*graph.fan_ins, ""))
        level = staged(on.select("flow_id", *branch), "level")
        if meets:
            # open cohorts: their spawns wait, the changes of their members are kept until they meet
            waiting = waiting.unionByName(done.filter("spawns").select("flow_id", "path", "node", "frames", "depth", "state", "delta"))
            members = members.unionByName(done.filter(inside).select("flow_id", frame["spawn"].alias("spawn"), F.struct(frame["ordinal"].alias("ordinal"), "depth", "path").alias("o"), "delta", "status", "error"))
            # cohorts of which nothing is under way, innermost first
            busy = level.select("flow_id", F.explode("frames").alias("f")).unionByName(waiting.select("flow_id", F.explode("frames").alias("f"))).select("flow_id", F.col("f.spawn").alias("path")).distinct()
            ready = staged(waiting.join(busy, ["flow_id", "path"], "left_anti"), "ready")
            if ready.isEmpty():
                if at % UNSTAGED == 0:
                    members, waiting = staged(members, "members"), staged(waiting, "waiting")
            else:
                cohort = ready.select("flow_id", F.col("path").alias("spawn"))
                here = staged(members.join(cohort, ["flow_id", "spawn"], "left_semi"), "here")
                fold = here.filter("status = 'completed'").select("flow_id", "spawn", "o", "delta").unionByName(ready.select("flow_id", F.col("path").alias("spawn"), F.struct(F.lit(-1).alias("ordinal"), "depth", "path").alias("o"), "delta"))
                merged = sts.reduce_states(ready.select("flow_id", F.col("path").alias("spawn"), F.col("state").alias("base")), fold, ["flow_id", "spawn"], graph.reducers)
                seen = here.groupBy("flow_id", "spawn").agg(F.max("o.depth").alias("deepest"), F.min_by("error", F.when(F.col("status") == "failed", F.col("o"))).alias("lost"), F.count_if(F.col("status") == "failed").alias("failures"))
                met = ready.drop("state", "delta").withColumnRenamed("path", "spawn").join(merged, ["flow_id", "spawn"]).join(seen, ["flow_id", "spawn"], "left")
                met = staged(met.withColumn("error", F.when(F.col("failures") > 0, F.col("lost")).otherwise(F.when(F.col("error").isNotNull(), sts.quoted(F.col("error"))))).withColumn("failed", (F.coalesce("failures", F.lit(0)) > 0) | F.col("error").isNotNull()), "met")
                meet, names = F, F
                for source, target in meets.items():
                    meet = meet.when(F.col("node") == source, F.lit(target))
                    names = names.when(F.col("node") == source, F.array(*map(F.lit, spreads.get(source, ()))).cast("array<string>"))
                met = met.withColumn("names", names.otherwise(F.array().cast("array<string>")))
                fired = met.filter("NOT failed").select("flow_id", F.concat("spawn", F.lit(">")).alias("path"), meet.alias("node"), "frames", (F.coalesce("deepest", "depth") + 1).alias("depth"), F.map_filter(st.without_deleted(F.col("state")), lambda k, v: ~F.array_contains(F.col("names"), k)).alias("state"))
                level = staged(level.unionByName(fired), "level")
                # a cohort that failed fails as a branch of the one around it, or with its flow
                lost = met.filter("failed")
                ends.add(lost.filter(~inside).select("flow_id", F.lit("failed").alias("status"), "error"))
                climbs = lost.filter(inside).select("flow_id", frame["spawn"].alias("spawn"), F.struct(frame["ordinal"].alias("ordinal"), "depth", F.concat("spawn", F.lit("!")).alias("path")).alias("o"), empty.alias("delta"), F.lit("failed").alias("status"), "error")
                members = staged(members.join(cohort, ["flow_id", "spawn"], "left_anti").unionByName(climbs), "members")
                waiting = staged(waiting.join(ready.select("flow_id", "path"), ["flow_id", "path"], "left_anti"), "waiting")
        if level.isEmpty() and waiting.isEmpty():
            break
        if at == max_levels:
            raise ValueError(f"flows are under way after {max_levels} levels")
    steps = log.read()
    log_rows = steps.select("flow_id", "path", "node", "frames", "depth", "state", "delta", "status")
    if straight:  # the step that a flow ends with is its only tail, so its changes need no fold
        last = F.map_filter("delta", lambda k, v: ~k.startswith("$"))
        return _outcomes(steps.filter(over).select("flow_id", "status", "error", st.without_deleted(st.overlay(F.col("state"), last)).alias("state"))), log_rows
    # a step whose cohort met, and a spawn whose branches did, are followed by the fan-in
    follows = F.when(F.col("spawns"), F.concat("path", F.lit(">"))).when(F.col("arrives"), F.concat(frame["spawn"], F.lit(">")))
    met = steps.filter(F.col("path").endswith(">")).select("flow_id", F.col("path").alias("follows"), F.lit(True).alias("met"))
    stored = steps.withColumn("follows", follows).join(met, ["flow_id", "follows"], "left")
    stored = stored.select("flow_id", F.col("path").alias("step_id"), frame["spawn"].alias("lineage_id"), frame["ordinal"].alias("fan_out_ordinal"), F.col("depth").alias("step_depth"), "status", F.col("node").alias("task_name"), (~F.col("onward") & F.col("met").isNull()).alias("tail"), "state", F.col("delta").alias("changes"))
    final = sts.final_states(stored, graph.reducers, spreads, ("step_depth", "step_id"))
    out = ends.read().join(final, "flow_id", "left")
    return _outcomes(out), log_rows
