"""Changes of stored rows as projections: claims, cancellation, ends of flows, snapshots, references, history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braid.functions import scalars as sc


def claimed(steps: DataFrame, due: Column, now: datetime) -> DataFrame:
    """Due steps as running, with their lease; started_at stays where an attempt was made before."""
    at = F.lit(now).cast("timestamp")
    out = steps.withColumn("due_", due)
    return out.withColumns({
        "status": F.when(F.col("due_"), "running").otherwise(F.col("status")),
        "lease_expires": F.when(F.col("due_"), sc.lease_expiry(at, F.col("time_budget_ms"))).otherwise(F.col("lease_expires").cast("timestamp")),
        "started_at": F.when(F.col("due_") & (F.col("attempt") == 0), at).otherwise(F.col("started_at").cast("timestamp")),
    }).drop("due_")


def fenced(steps: DataFrame, writes: DataFrame) -> DataFrame:
    """Steps with the changes of the attempt that holds their lease; writes of older attempts and to cancelled steps are void.

    writes: step_id, lease_seq, changes, written_at; of writes that were repeated under one lease the first counts.
    """
    first = writes.groupBy("step_id", "lease_seq").agg(F.min_by(F.struct("changes"), F.struct("written_at", "changes")).alias("w_"))
    out = steps.join(first, ["step_id", "lease_seq"], "left")
    take = F.col("w_").isNotNull() & ~sc.is_terminal(F.col("status"))
    return out.withColumns({"changes": F.when(take, F.col("w_.changes")).otherwise(F.col("changes")), "status": F.when(take, "completed").otherwise(F.col("status"))}).drop("w_")


def signal_error(task: Column, interrupt: Column, retry: Column, goto: Column, call: Column, parked_before: Column) -> Column:
    """Error of a step that asks for more than one of four things, or to park again after it was resumed; else null.

    All but ``task`` are flags; a null flag counts as not set.
    """
    flags = [F.coalesce(c, F.lit(False)) for c in (interrupt, retry, goto, call)]
    asked = sum((c.cast("int") for c in flags[1:]), flags[0].cast("int"))
    again = (flags[0] | flags[3]) & F.coalesce(parked_before, F.lit(False))
    return F.when(asked > 1, F.concat(F.lit("several signals at once in "), task)).when(again, F.concat(F.lit("a second park in "), task))


def cancelled(flows: DataFrame, subtree: DataFrame, reason: str = "") -> DataFrame:
    """Flows with the live ones of a subtree (shard, flow_id) cancelled; ended ones stay as they are."""
    hit = subtree.select("shard", "flow_id").distinct().withColumn("hit_", F.lit(True))
    live = F.coalesce("hit_", F.lit(False)) & ~sc.is_terminal(F.col("status"))
    out = flows.join(hit, ["shard", "flow_id"], "left").withColumn("now_", live)
    return out.withColumn("status", F.when(F.col("now_"), "cancelled").otherwise(F.col("status"))).withColumn("cancel_reason", F.when(F.col("now_"), F.lit(reason)).otherwise(F.col("cancel_reason"))).drop("hit_", "now_")


def ended(flows: DataFrame, results: DataFrame) -> DataFrame:
    """Flows with their results (shard, flow_id, outcome, result) delivered once: an ended flow does not change again."""
    out = flows.join(results.select("shard", "flow_id", "outcome", "result"), ["shard", "flow_id"], "left")
    take = F.col("outcome").isNotNull() & ~sc.is_terminal(F.col("status"))
    return out.withColumn("final_state", F.when(take & (F.col("outcome") == "completed"), F.col("result")).otherwise(F.col("final_state"))).withColumn("error", F.when(take & (F.col("outcome") == "failed"), F.col("result")).otherwise(F.col("error"))).withColumn("status", F.when(take, F.col("outcome")).otherwise(F.col("status"))).drop("outcome", "result")


def snapshots(flows: DataFrame, leaves: DataFrame) -> DataFrame:
    """State of each flow by status: the final one of ended flows, the leaf's of interrupted ones, none while running."""
    leaf = leaves.select("shard", "flow_id", F.col("state").alias("leaf_"))
    out = flows.join(leaf, ["shard", "flow_id"], "left")
    return out.withColumn("snapshot", F.when(sc.is_terminal(F.col("status")), F.coalesce("final_state", F.lit("{}"))).when(F.col("status") == "interrupted", F.coalesce("leaf_", F.lit("{}"))).otherwise(F.lit("{}"))).drop("leaf_")


def awaited(flows: DataFrame, keys: DataFrame, now: datetime, window_ms: int) -> DataFrame:
    """Stopped flows that changed lately, and those of the awaited keys (shard, flow_id) that stopped before."""
    recent = sc.diff_millis(F.lit(now).cast("timestamp"), F.col("updated_at")) <= window_ms
    wanted = keys.select("shard", "flow_id").distinct().withColumn("wanted_", F.lit(True))
    return flows.filter(sc.is_stopped(F.col("status"))).join(wanted, ["shard", "flow_id"], "left").filter(recent | F.coalesce("wanted_", F.lit(False))).drop("wanted_")


# ---- large fields stored by reference


def resolved(steps: DataFrame, anchors: DataFrame) -> DataFrame:
    """Steps with referenced fields put back: refs (MAP field -> anchor step), fields from the anchor's changes, then its state.

    One hop: an anchor holds its fields itself. steps: step_id, state, refs; anchors: step_id, state, changes (MAPs).
    """
    asked = steps.select("step_id", F.explode("refs").alias("field", "anchor"))
    held = anchors.select(F.col("step_id").alias("anchor"), F.col("state").alias("s_"), F.col("changes").alias("c_"))
    found = asked.join(held, "anchor").select("step_id", F.struct(F.col("field").alias("key"), F.coalesce(F.element_at("c_", F.col("field")), F.element_at("s_", F.col("field"))).alias("value")).alias("e"))
    fields = found.filter(F.col("e.value").isNotNull()).groupBy("step_id").agg(F.map_from_entries(F.collect_list("e")).alias("f_"))
    own = F.col("state")
    return steps.join(fields, "step_id", "left").withColumn("state", F.when(F.col("f_").isNull(), own).otherwise(F.map_concat(F.map_filter("f_", lambda k, v: ~F.array_contains(F.map_keys(own), k)), own))).drop("f_")


def anchored(candidates: DataFrame, most: int = 4) -> DataFrame:
    """Anchors that a step keeps: pinned ones, then those with the most bytes, ties by id; candidates: step_id, anchor, bytes, pinned."""
    w = Window.partitionBy("step_id").orderBy(F.desc("pinned"), F.desc("bytes"), "anchor")
    return candidates.withColumn("at_", F.row_number().over(w)).filter((F.col("at_") <= most) | F.col("pinned")).drop("at_")


def minted(state: Column, before: Column, anchor: Column, threshold: int) -> Column:
    """MAP of field -> anchor for the fields that did not change and are large enough to be stored by reference."""
    same = F.map_filter(state, lambda k, v: (F.octet_length(v) >= threshold) & (F.element_at(before, k) == v))
    return F.transform_values(same, lambda k, v: anchor)


# ---- metrics and history


def counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A counter of rows by its attributes."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("value"))


def state_bytes(steps: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, column, bytes) written to each column."""
    sums = steps.groupBy(*keys).agg(*[F.sum(F.octet_length(c)).alias(c) for c in columns])
    return sums.unpivot(keys, columns, "column", "bytes")


def histogram(rows: DataFrame, value: str, bounds: list[float], keys: list[str]) -> DataFrame:
    """(keys, bucket, n): bucket is the number of bounds under the value; empty buckets are left out."""
    bucket = F.lit(0)
    for b in bounds:
        bucket = bucket + (F.col(value) > b).cast("int")
    return rows.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def wall_time(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Milliseconds from the first creation to the last update of groups whose steps have all ended; null for others."""
    out = steps.groupBy(*keys).agg(F.bool_and(sc.is_terminal(F.col("status"))).alias("over"), F.min("created_at").alias("a"), F.max("updated_at").alias("b"))
    return out.select(*keys, F.when(F.col("over"), sc.diff_millis(F.col("b"), F.col("a"))).alias("wall_ms"))


def history_mermaid(steps: DataFrame, flow_key: str = "flow_id") -> DataFrame:
    """(flow, diagram): each flow's steps as a Mermaid flowchart, with an edge from each step to its successor."""
    node = F.concat(F.lit("  s"), F.col("step_id").cast("string"), F.lit('["'), F.regexp_replace("task_name", '"', "#quot;"), F.lit(" "), F.col("status"), F.lit('"]'))
    edge = F.when(F.col("successor_id") != 0, F.concat(F.lit("\n  s"), F.col("step_id").cast("string"), F.lit(" --> s"), F.col("successor_id").cast("string"))).otherwise("")
    lines = F.array_sort(F.collect_list(F.struct("step_id", F.concat(node, edge).alias("l"))))
    return steps.groupBy(flow_key).agg(F.concat(F.lit("flowchart TD\n"), F.array_join(F.transform(lines, lambda x: x["l"]), "\n")).alias("diagram"))
