"""Queries over flows, steps and peers: listing, search, paging, history, detectors and gauges."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braid.functions import scalars as sc
from braid.sources.staging import MAX_BROADCAST, batches, by_key, staged

DEFAULT_LIMIT = 100


@dataclass(frozen=True)
class Query:
    """Filters of a listing; what is empty or None does not filter. All of them hold together."""

    status: str = ""
    workflow_url: str = ""
    workflow_name: str = ""
    thread_id: int = 0
    task_name: str = ""
    fairness_key: str = ""
    priority: int = 0
    older_than_ms: int = 0
    newer_than_ms: int = 0
    search: str = ""
    include_subgraphs: bool = False
    limit: int = 0
    cursor: str = ""

    def filters(self) -> bool:
        """Whether anything but the form of the listing is asked for."""
        return any((self.status, self.workflow_url, self.workflow_name, self.thread_id, self.task_name, self.fairness_key, self.priority, self.older_than_ms, self.newer_than_ms, self.search))


def predicate(q: Query, now: datetime) -> Column:
    """One condition over flows joined with their current step (columns of flows, and task_name)."""
    if q.status and q.status not in sc.STATUSES:
        raise ValueError(f"unknown status {q.status!r}")
    out = F.col("delete_after_ms") == 0
    if not q.include_subgraphs:
        out &= F.col("surgraph_flow_id") == 0
    for name in ("status", "workflow_url", "workflow_name", "thread_id", "task_name", "fairness_key", "priority"):
        if value := getattr(q, name):
            out &= F.col(name) == value
    age = sc.diff_millis(F.lit(now).cast("timestamp"), F.col("updated_at"))
    if q.older_than_ms:
        out &= age > q.older_than_ms
    if q.newer_than_ms:
        out &= age <= q.newer_than_ms
    if q.search:
        key = sc.flow_key(F.col("shard"), F.col("flow_id"), F.col("flow_token"))
        out &= F.coalesce(*[F.lit(None).cast("boolean")], F.array_contains(F.transform(F.array("workflow_url", "workflow_name", "task_name", "error", "cancel_reason", key), lambda c: F.coalesce(sc.contains_literal(c, q.search), F.lit(False))), True))
    return out


def with_current_step(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """Flows with the task of their current step; flows with several live branches (step_id 0) have none."""
    now = steps.select("shard", "step_id", "task_name")
    return flows.join(now, ["shard", "step_id"], "left")


def summaries(flows: DataFrame) -> DataFrame:
    """The columns of a listing: keys made, texts trimmed, whether it is a subgraph, the trace's id."""
    trimmed = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("workflow_url", "workflow_name", "cancel_reason") if c in flows.columns}
    out = flows.withColumns(trimmed).withColumn("error", F.trim("error")).withColumn("flow_key", sc.flow_key(F.col("shard"), F.col("flow_id"), F.col("flow_token"))).withColumn("subgraph", F.col("surgraph_flow_id") != 0)
    return out.withColumn("trace_id", sc.trace_id(F.coalesce("trace_parent", F.lit("")))).drop("flow_token", "trace_parent")


def of_keys(flows: DataFrame, keys: DataFrame) -> DataFrame:
    """The flows that flow keys (key) name, each on its key's shard."""
    k = F.col("key")
    asked = keys.select(sc.key_shard(k).alias("shard"), sc.key_id(k).alias("flow_id"), sc.key_token(k).alias("flow_token"))
    return flows.join(asked, ["shard", "flow_id", "flow_token"], "left_semi")


def of_thread(flows: DataFrame, keys: DataFrame) -> DataFrame:
    """The flows of the threads that flow keys (key) belong to, each on its key's shard; keys of no flow find nothing."""
    threads = of_keys(flows, keys).select("shard", "thread_id").distinct()
    return flows.join(threads, ["shard", "thread_id"], "left_semi")


def cursor_of(rows: list) -> str:
    """Where the next page begins: the least flow_id of each shard."""
    least: dict[int, int] = {}
    for r in rows:
        least[r["shard"]] = min(r["flow_id"], least.get(r["shard"], r["flow_id"]))
    return ",".join(f"{s}={i}" for s, i in sorted(least.items()))


def parse_cursor(text: str) -> dict[int, int]:
    out = {}
    for part in filter(None, text.split(",")):
        shard, _, flow = part.partition("=")
        if not shard.isdigit() or not flow.lstrip("-").isdigit():
            raise ValueError(f"malformed cursor {text!r}")
        out[int(shard)] = int(flow)
    return out


def per_shard_limit(limit: int, shards: int) -> int:
    return max(-(-(limit or DEFAULT_LIMIT) // max(1, shards)), 1)


def list_flows(flows: DataFrame, steps: DataFrame, q: Query, now: datetime, shards: int) -> DataFrame:
    """Newest first within each shard, shards in order; the limit is shared out among the shards."""
    out = with_current_step(flows, steps).filter(predicate(q, now))
    for shard, before in parse_cursor(q.cursor).items():
        out = out.filter((F.col("shard") != shard) | (F.col("flow_id") < before))
    newest = Window.partitionBy("shard").orderBy(F.desc("flow_id"))
    return out.withColumn("at_", F.row_number().over(newest)).filter(F.col("at_") <= per_shard_limit(q.limit, shards)).drop("at_").orderBy("shard", F.desc("flow_id"))


def purgeable(flows: DataFrame, steps: DataFrame, q: Query, now: datetime, shards: int, cap: int = 4096) -> DataFrame:
    """Roots that a purge marks as due: needs a filter, no subgraphs, nothing that runs; interrupted become cancelled."""
    if not q.filters() or q.include_subgraphs:
        raise ValueError("a purge needs a filter and takes roots only")
    out = with_current_step(flows, steps).filter(predicate(q, now) & ~F.col("status").isin("running", "pending"))
    first = Window.partitionBy("shard").orderBy("flow_id")
    out = out.withColumn("at_", F.row_number().over(first)).filter(F.col("at_") <= per_shard_limit(cap, shards)).drop("at_")
    return out.withColumn("status", F.when(F.col("status") == "interrupted", "cancelled").otherwise(F.col("status"))).withColumn("delete_after_ms", F.lit(1))


def reapable(flows: DataFrame, now: datetime, batch: int = 4096) -> DataFrame:
    """Roots whose grace is over, in order of their ids."""
    due = (F.col("delete_after_ms") > 0) & (sc.add_millis(F.col("updated_at"), F.col("delete_after_ms")) <= F.lit(now).cast("timestamp"))
    return flows.filter(due & (F.col("surgraph_flow_id") == 0)).orderBy("flow_id").limit(batch)


def without_trees(flows: DataFrame, roots: DataFrame) -> DataFrame:
    """What is left when the trees of ``roots`` are deleted."""
    return flows.join(roots.select("shard", F.col("flow_id").alias("root_flow_id")), ["shard", "root_flow_id"], "left_anti")


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each group, by ``by``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in by])
    return rows.withColumn("at_", F.row_number().over(w)).filter("at_ = 1").drop("at_")


def earliest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*by)
    return rows.withColumn("at_", F.row_number().over(w)).filter("at_ = 1").drop("at_")


def fingerprint(steps: DataFrame, keys: list[str]) -> DataFrame:
    """A digest of (status, number, last update) that changes whenever a step of the group does."""
    out = steps.groupBy(*keys).agg(F.max("status").alias("status"), F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("last"))
    return out.select(*keys, F.sha2(F.concat_ws("|", "status", F.col("n").cast("string"), sc.epoch_millis(F.col("last")).cast("string")), 256).alias("fingerprint"))


# ---- trees


def _form(links: DataFrame) -> tuple[str, DataFrame]:
    """("forest", links) if no node has two parents, ("chains", links) if none has two children, else ("graph", links)."""
    to_child = staged(by_key(links, "c_").groupBy("c_").agg(F.min("p_").alias("p_"), F.max("p_").alias("q_")), "links")
    if to_child.filter("p_ <> q_").isEmpty():
        return "forest", to_child.select("p_", "c_")
    to_parent = staged(by_key(links, "p_").groupBy("p_").agg(F.min("c_").alias("c_"), F.max("c_").alias("q_"), F.bool_or(F.col("c_").isNull()).alias("none_")), "links")
    if to_parent.filter("c_ <> q_ OR none_").isEmpty():
        return "chains", to_parent.select("p_", "c_")
    return "graph", links


def descendants(edges: DataFrame, roots: DataFrame, parent: str, child: str, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth) below each root, level by level; a level that finds nothing new ends it.

    A stated ``max_depth`` that is reached with nodes below it is an error. Each level joins only the frontier with the
    edges, and a small frontier (counted) is broadcast. Cycles end: where no node has two parents, only the root itself can
    come up again; where none has two children, each walk remembers the node at the last depth that is a power of two, ends
    when that comes up again, and the least depth of each node counts. Only in other graphs, or with ``max_depth``, is each
    level held against all nodes that were visited.
    """
    spark, links = edges.sparkSession, edges.select(F.col(parent).alias("p_"), F.col(child).alias("c_"))
    top = roots.select(F.col(roots.columns[0]).alias("root"), F.col(roots.columns[0]).alias("node")).withColumn("depth", F.lit(0))
    form, links = ("graph", links) if max_depth is not None else _form(links)
    level, size, levels, closed = top.distinct().withColumn("mark", F.col("root")), None, batches(spark, "levels"), 0
    for d in count(1):
        near = F.broadcast(level) if size is not None and size <= MAX_BROADCAST else level
        found = near.join(links, F.col("node") == F.col("p_"))
        if form == "graph":
            seen = top if d == 1 else top.unionByName(levels.read().select(*top.columns))
            found = found.select("root", F.col("c_").alias("node"), F.lit(d).alias("depth"), "mark", F.lit(False).alias("closed")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        else:
            found = found.select("root", F.col("c_").alias("node"), F.lit(d).alias("depth"), "mark", F.coalesce(F.col("c_") == F.col("mark"), F.lit(False)).alias("closed"))
        level = levels.add(found)
        size, ended = level.agg(F.count_if(~F.col("closed")), F.count_if("closed")).first()
        closed += ended
        if not size:
            break
        if max_depth is not None and d > max_depth:
            raise ValueError(f"nodes lie below depth {max_depth}")
        level = level.filter(~F.col("closed")).drop("closed")
        if form == "chains" and d & (d - 1) == 0:
            level = level.withColumn("mark", F.col("node"))
    below = levels.read().filter(~F.col("closed")).select(*top.columns)
    if form == "chains" and closed:
        below = below.groupBy("root", "node").agg(F.min("depth").alias("depth")).filter(F.col("root") != F.col("node"))
    return top.unionByName(below)


# ---- detectors


def orphans(flows: DataFrame, min_age_ms: int, now: datetime) -> DataFrame:
    """Live flows whose parent has ended."""
    parents = flows.filter(sc.is_terminal(F.col("status"))).select("shard", F.col("flow_id").alias("surgraph_flow_id"))
    old = sc.diff_millis(F.lit(now).cast("timestamp"), F.col("updated_at")) >= min_age_ms
    return flows.filter(~sc.is_terminal(F.col("status")) & (F.col("surgraph_flow_id") != 0) & old).join(parents, ["shard", "surgraph_flow_id"], "left_semi")


def stalled(flows: DataFrame, steps: DataFrame, quiet_ms: int = 0, now: datetime | None = None) -> DataFrame:
    """Running flows without a live step; with ``quiet_ms`` only those that nothing has changed in for so long."""
    live = ~sc.is_terminal(F.col("status"))
    out = flows.filter(F.col("status") == "running")
    if quiet_ms:
        since = sc.diff_millis(F.lit(now).cast("timestamp"), F.col("updated_at"))
        live, out = live | (since <= quiet_ms), out.filter(since > quiet_ms)
    return out.join(steps.filter(live).select("shard", "flow_id"), ["shard", "flow_id"], "left_anti")


def parked_without_child(steps: DataFrame, flows: DataFrame) -> DataFrame:
    live = flows.filter(~sc.is_terminal(F.col("status")) & (F.col("surgraph_step_id") != 0)).select("shard", F.col("surgraph_step_id").alias("step_id"))
    return steps.filter(F.col("parked") == 1).join(live, ["shard", "step_id"], "left_anti")


def recovered_leases(steps: DataFrame, now: datetime) -> DataFrame:
    """Steps with those whose lease ran out back to pending."""
    lost = (F.col("status") == "running") & (F.col("parked") == 0) & (F.col("lease_expires").cast("timestamp") <= F.lit(now).cast("timestamp"))
    return steps.withColumn("status", F.when(lost, "pending").otherwise(F.col("status")))


def invariants(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """(check, violations) of the rules that stored rows keep."""
    own = flows.select("shard", "flow_id", F.col("status").alias("flow_status"))
    both = steps.join(own, ["shard", "flow_id"])
    live = ~sc.is_terminal(F.col("status"))
    links = steps.filter(F.col("successor_id") != 0).select("shard", "flow_id", F.col("successor_id"))
    ends = steps.select("shard", F.col("step_id").alias("successor_id"), F.col("flow_id").alias("other_flow"))
    found = links.join(ends, ["shard", "successor_id"], "left")
    one = lambda df, cond, name: df.agg(F.count_if(cond).alias("violations")).select(F.lit(name).alias("check"), "violations")
    parts = [
        one(both, sc.is_terminal(F.col("flow_status")) & live, "terminal flow with live step"),
        one(steps, (F.col("parked") == 1) & ~live, "parked terminal step"),
        one(stalled(flows, steps), F.lit(True), "running flow without live step"),
        one(steps, (F.col("cohort_size") > 0) & (F.col("cohort_arrivals") > F.col("cohort_size")), "counter overshoot"),
        one(found, F.col("other_flow").isNull(), "dangling link"),
        one(found, F.col("other_flow") != F.col("flow_id"), "cross-flow edge"),
        one(flows, (F.col("surgraph_flow_id") == 0) & (F.col("root_flow_id") != F.col("flow_id")), "bad root"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- gauges and profiles


def pending_by_band(steps: DataFrame, now: datetime) -> DataFrame:
    """(priority, pending, age in whole seconds of the oldest)."""
    out = steps.groupBy("priority").agg(F.count(F.lit(1)).alias("pending"), F.min("created_at").alias("oldest"))
    return out.select("priority", "pending", F.floor(sc.diff_millis(F.lit(now).cast("timestamp"), F.col("oldest")) / 1000).alias("age_s"))


def floor_percentile(rows: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The element at floor(p * (n - 1)) of each group's sorted values, without gathering a group in one task."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_"))
    upto = Window.partitionBy(*keys).orderBy(value)
    ranked = counted.withColumn("to_", F.sum("n_").over(upto)).withColumn("all_", F.sum("n_").over(Window.partitionBy(*keys)))
    return ranked.filter(F.col("to_") > F.floor(F.lit(p) * (F.col("all_") - 1))).groupBy(*keys).agg(F.min(value).alias(value))


def deltas(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """after minus before of each counter; those that did not move drop out."""
    old = before.select(*keys, F.col(value).alias("old_"))
    return after.join(old, keys, "left").withColumn(value, F.col(value) - F.coalesce("old_", F.lit(0))).filter(F.col(value) != 0).drop("old_")


def classify_peers(peers: DataFrame, now: datetime, fresh_ms: int) -> DataFrame:
    """Each replica with whether it is fresh, and the ordinal among the fresh ones by id."""
    seen = peers.groupBy("engine_id").agg(F.max("seen_at").alias("seen_at"))
    seen = seen.withColumn("fresh", sc.diff_millis(F.lit(now).cast("timestamp"), F.col("seen_at")) <= fresh_ms)
    return seen.withColumn("ordinal", F.when(F.col("fresh"), F.row_number().over(Window.partitionBy("fresh").orderBy("engine_id")) - 1))


def peer_view(peers: DataFrame, me: int, now: datetime, fresh_ms: int, dispatch_ms: int, straggler_ms: int) -> DataFrame:
    """One row: replicas (``me`` always counts), dispatchers, the ordinal of ``me`` among them by id (-1: none), dead ids.

    peers: engine_id, seen_at, dispatched_at, a row for each replica. ``me`` is never dead.
    """
    age = lambda c: sc.diff_millis(F.lit(now).cast("timestamp"), F.col(c))
    own, fresh = F.col("engine_id") == me, age("seen_at") <= fresh_ms
    sends = fresh & F.coalesce(age("dispatched_at") <= dispatch_ms, F.lit(False))
    out = peers.agg(F.count_if(fresh).alias("seen"), F.coalesce(F.bool_or(own & fresh), F.lit(False)).alias("here"), F.count_if(sends).alias("dispatchers"), F.coalesce(F.bool_or(own & sends), F.lit(False)).alias("mine"), F.count_if(sends & (F.col("engine_id") < me)).alias("before"), F.array_sort(F.collect_list(F.when((age("seen_at") > straggler_ms) & ~own, F.col("engine_id")))).alias("dead"))
    return out.select((F.col("seen") + F.when(F.col("here"), 0).otherwise(1)).alias("replicas"), "dispatchers", F.when(F.col("mine"), F.col("before")).otherwise(-1).cast("int").alias("ordinal"), "dead")
