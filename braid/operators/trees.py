"""Chains and copies of execution trees: ancestors, forks with new ids, resumed leaves, navigation, thread turns."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braid.operators.relational import descendants, earliest
from braid.sources.staging import by_key, staged


def ancestors(edges: DataFrame, starts: DataFrame, parent: str, child: str, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth) from each start upward: the chain of its parents. Cycles end at the first repeat."""
    return descendants(edges.select(F.col(child).alias(parent), F.col(parent).alias(child)), starts, parent, child, max_depth)


def heights(edges: DataFrame, starts: DataFrame, parent: str, child: str) -> DataFrame:
    """(root, depth): how many parents lie above each start, without the list of them; one row for each distinct start.

    Where every node has one parent at most, jumps are doubled over the nodes that are parents themselves: a chain of n takes
    log2(n) rounds, each a join of those nodes. Other graphs, and those with cycles, are walked by ``ancestors``.
    """
    ids = starts.select(F.col(starts.columns[0]).alias("root")).distinct()
    up = by_key(edges.select(F.col(child).alias("id"), F.col(parent).alias("to")).filter("id IS NOT NULL AND to IS NOT NULL"), "id")
    up = staged(up.groupBy("id").agg(F.min("to").alias("to"), F.max("to").alias("q_")), "up")
    walked = lambda: ancestors(edges, starts, parent, child).groupBy("root").agg(F.max("depth").alias("depth"))
    if not up.filter("to <> q_").isEmpty():
        return walked()
    up = up.drop("q_")
    # nodes without children are looked up by nobody
    active = staged(up.join(up.select(F.col("to").alias("id")).distinct(), "id", "left_semi").withColumn("d", F.lit(1)), "jumps")
    over, nodes = [], active.count()
    left = nodes
    for most in count():
        if not left:
            break
        if 2**most > 2 * nodes:  # longer than all nodes in a row: a cycle
            return walked()
        table = active
        for x in over:
            table = table.unionByName(x)
        far = table.select(F.col("id").alias("to"), F.col("to").alias("to_"), F.col("d").alias("d_"))
        moved = staged(active.join(far, "to", "left").select("id", F.coalesce("to_", "to").alias("to"), (F.col("d") + F.coalesce("d_", F.lit(0))).alias("d"), F.col("to_").isNull().alias("over")), "jumps")
        over.append(moved.filter("over").drop("over"))
        active = moved.filter("NOT over").drop("over")
        left = active.count()
    known = active
    for x in over:
        known = known.unionByName(x)
    first = ids.join(up.withColumnRenamed("id", "root"), "root", "left")
    return first.join(known.select(F.col("id").alias("to"), "d"), "to", "left").select("root", F.when(F.col("to").isNull(), 0).otherwise(1 + F.coalesce("d", F.lit(0))).cast("int").alias("depth"))


def lineage_fields(spawns: DataFrame, chain: DataFrame) -> DataFrame:
    """(root, names): the bookkeeping fields of all spawns on a chain. spawns: (node, names); chain: of ``ancestors``."""
    return chain.join(spawns, "node").groupBy("root").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))


def fork(steps: DataFrame, at: int, overrides: dict[str, str], next_id: int) -> DataFrame:
    """A copy of a flow's steps without what follows step ``at``, which is pending again with the overridden columns.

    New ids run from ``next_id`` in order of the old ones; links follow. steps: step_id, predecessor_id, status, ...
    """
    links = steps.filter("predecessor_id <> 0").select("predecessor_id", "step_id")
    start = steps.filter(F.col("step_id") == at).select("step_id")
    gone = descendants(links, start, "predecessor_id", "step_id").filter("depth > 0").select(F.col("node").alias("step_id"))
    kept = steps.join(gone, "step_id", "left_anti")
    # an id's new number is that of its rank; ids are spread over ranges, so no task sorts them all
    ids = staged(kept.select("step_id").repartitionByRange("step_id").sortWithinPartitions("step_id").withColumn("part_", F.spark_partition_id()), "ids")
    counts = ids.groupBy("part_").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn("first_", F.coalesce(F.sum("n").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part_", "first_")
    rank = F.row_number().over(Window.partitionBy("part_").orderBy("step_id"))
    new = ids.withColumn("r_", rank).join(F.broadcast(starts), "part_").select("step_id", (F.lit(next_id) + F.col("first_") + F.col("r_") - 1).cast("long").alias("new_id"))
    before = new.select(F.col("step_id").alias("predecessor_id"), F.col("new_id").alias("new_predecessor"))
    out = kept.join(new, "step_id").join(before, "predecessor_id", "left")
    again = F.col("step_id") == at
    out = out.withColumns({c: F.when(again, F.lit(v)).otherwise(F.col(c)) for c, v in overrides.items()})
    return out.withColumn("status", F.when(again, "pending").otherwise(F.col("status"))).withColumn("forked_from", F.col("step_id")).withColumn("step_id", F.col("new_id")).withColumn("predecessor_id", F.coalesce("new_predecessor", F.lit(0)).cast("long")).drop("new_id", "new_predecessor")


def recounted(spawns: DataFrame, members: DataFrame, rewound: DataFrame) -> DataFrame:
    """Cohort counters of a fork: arrivals and failures of the branches that do not hold the rewound step.

    One row for each lineage_id of spawns, however often it is there; a member without an ordinal is no branch. What belongs
    to a cohort meets in one task after a single shuffle, in partitions of bounded size.
    """
    branch, is_ = ["lineage_id", "fan_out_ordinal"], lambda k: F.col("kind") == k
    rows = members.select(*branch, F.when(F.col("status") == "failed", "failed").otherwise("member").alias("kind")).filter("fan_out_ordinal IS NOT NULL")
    rows = rows.unionByName(rewound.select(*branch, F.lit("rewound").alias("kind"))).unionByName(spawns.select("lineage_id", F.lit(None).cast(members.schema["fan_out_ordinal"].dataType).alias("fan_out_ordinal"), F.lit("spawn").alias("kind")))
    branches = by_key(rows, "lineage_id").groupBy(*branch).agg(F.count_if(is_("failed")).alias("failed"), F.bool_or(is_("failed") | is_("member")).alias("arrived"), F.bool_or(is_("rewound")).alias("rewound"), F.bool_or(is_("spawn")).alias("spawn"))
    counts = F.col("arrived") & ~F.col("rewound")
    out = branches.groupBy("lineage_id").agg(F.count_if(counts).alias("cohort_arrivals"), F.sum(F.when(counts, F.col("failed")).otherwise(0)).alias("cohort_failures"), F.bool_or("spawn").alias("spawn"))
    return out.filter("spawn").drop("spawn")


def resumed(steps: DataFrame, data: DataFrame) -> DataFrame:
    """Steps with the earliest interrupted one of each flow pending again, with its resume data. data: (flow_id, resume_data)."""
    leaf = earliest(steps.filter("status = 'interrupted'"), ["flow_id"], ["updated_at", "step_id"]).select("flow_id", "step_id")
    given = leaf.join(data.select("flow_id", F.col("resume_data").alias("given_")), "flow_id").select("step_id", "given_")
    out = steps.join(given, "step_id", "left")
    hit = F.col("given_").isNotNull()
    return out.withColumn("status", F.when(hit, "pending").otherwise(F.col("status"))).withColumn("resume_data", F.when(hit, F.col("given_")).otherwise(F.col("resume_data"))).drop("given_")


def history(flows: DataFrame, steps: DataFrame, roots: DataFrame) -> DataFrame:
    """The steps of each root's flow and of the flows called below it: columns of steps, root, level and sub_flow_id.

    A caller that was tried again has the child that it launched last; sub_flow_id is null where that has no steps yet.
    roots: flow_id. flows: flow_id, surgraph_step_id (0 for roots).
    """
    callers = steps.select(F.col("step_id").alias("caller"), F.col("flow_id").alias("parent"))
    called = flows.filter("surgraph_step_id <> 0").groupBy(F.col("surgraph_step_id").alias("caller")).agg(F.max("flow_id").alias("child")).join(callers, "caller")
    called = staged(called, "calls")
    tree = descendants(called, roots.select("flow_id"), "parent", "child").select("root", F.col("node").alias("flow_id"), F.col("depth").alias("level"))
    begun = called.join(steps.select(F.col("flow_id").alias("child")).distinct(), "child").select(F.col("caller").alias("step_id"), F.col("child").alias("sub_flow_id"))
    return tree.join(steps, "flow_id").join(begun, "step_id", "left")


def nested(history_rows: DataFrame, columns: list[str]) -> DataFrame:
    """(root, history): the rows of ``history`` as one JSON text for each root, in order of depth and id; callers hold the
    history of the flow that they called. A round for each level, deepest first."""
    deepest = history_rows.agg(F.max("level")).first()[0]
    below = None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        rows = history_rows.filter(F.col("level") == level)
        rows = rows.join(below, ["root", "sub_flow_id"], "left") if below is not None else rows.withColumn("sub_history", F.lit(None).cast("string"))
        text = F.to_json(F.struct(*columns))
        whole = F.when(F.col("sub_history").isNull(), text).otherwise(F.concat(F.substr(text, F.lit(1), F.length(text) - 1), F.lit(',"sub_history":'), F.col("sub_history"), F.lit("}")))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("step_depth", "step_id", whole.alias("t")))), lambda x: x["t"])
        out = rows.groupBy("root", "flow_id").agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("sub_history"))
        below = staged(out.withColumnRenamed("flow_id", "sub_flow_id"), "nested")
    if below is None:
        return history_rows.select("root", F.lit("").alias("history"))
    return below.select("root", F.col("sub_history").alias("history"))


def navigation(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """(step_id, previous, next) across subgraphs: the entry of a called flow follows its caller, its exit comes before the caller's successor.

    steps: step_id, flow_id, predecessor_id, successor_id; calls: (flow_id, caller) of called flows.
    """
    own = steps.select("step_id", "flow_id", "predecessor_id", "successor_id")
    callers = own.select(F.col("step_id").alias("caller"), F.col("successor_id").alias("after_"))
    out = own.join(calls, "flow_id", "left").join(callers, "caller", "left")
    zero = lambda c: F.nullif(F.col(c), F.lit(0))
    return out.select("step_id", F.coalesce(zero("predecessor_id"), "caller", F.lit(0)).alias("previous"), F.coalesce(zero("successor_id"), zero("after_"), F.lit(0)).alias("next"))
