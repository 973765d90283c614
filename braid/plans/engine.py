"""The operations on stored flows by name, over a table of flows and one of steps.

Tables do not change in place: an operation that changes flows or steps gives an ``Engine`` over the changed tables, the
others give rows. A key names a flow on one shard, so an operation on a key reads that shard's partition only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.functions import scalars as sc
from braid.functions import state as st
from braid.operators import lifecycle as lc
from braid.operators import relational as rel
from braid.operators import trees
from braid.plans.registry import Registry
from braid.sources import tables


@dataclass(frozen=True)
class Engine:
    """flows and steps have columns of ``tables.SCHEMAS``; operations need only the columns that they name."""

    registry: Registry
    flows: DataFrame
    steps: DataFrame
    shards: int = 1

    def _on_shard(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.filter(F.col("shard") == sc.key_shard(F.lit(key)))

    def _flow(self, key: str) -> DataFrame:
        """The flow of a key; none where the key is malformed or its token is another one's."""
        k = F.lit(key)
        return self._on_shard(self.flows, key).filter((F.col("flow_id") == sc.key_id(k)) & (F.col("flow_token") == sc.key_token(k)))

    def _steps(self, key: str) -> DataFrame:
        return self._on_shard(self.steps, key).join(self._flow(key).select("shard", "flow_id"), ["shard", "flow_id"], "left_semi")

    def _tree(self, key: str) -> DataFrame:
        """(shard, flow_id) of a flow and of all that were called below it; a called flow is on its caller's shard."""
        links = self._on_shard(self.flows, key).filter("surgraph_flow_id <> 0").select("surgraph_flow_id", "flow_id")
        below = rel.descendants(links, self._flow(key).select("flow_id"), "surgraph_flow_id", "flow_id")
        return below.select(sc.key_shard(F.lit(key)).alias("shard"), F.col("node").alias("flow_id"))

    # ---- operations that change tables

    def create(self, requests: DataFrame) -> Engine:
        """With the flows of ``requests`` and the entry step of each."""
        own, entry = tables.entry_rows(requests)
        return replace(self, flows=self.flows.unionByName(own, allowMissingColumns=True), steps=self.steps.unionByName(entry, allowMissingColumns=True))

    def resume(self, key: str, data: str) -> Engine:
        """With the earliest interrupted step of the flow pending again; nothing changes where there is none."""
        own = self._steps(key)
        given = self._flow(key).select("flow_id", F.lit(data).alias("resume_data"))
        others = self.steps.join(self._flow(key).select("shard", "flow_id"), ["shard", "flow_id"], "left_anti")
        return replace(self, steps=others.unionByName(trees.resumed(own, given).select(*self.steps.columns)))

    def cancel(self, key: str, reason: str = "") -> Engine:
        """With the live flows of the tree cancelled."""
        return replace(self, flows=lc.cancelled(self.flows, self._tree(key), reason).select(*self.flows.columns))

    def delete(self, key: str) -> Engine:
        """Without the flow, all that was called below it, and their steps."""
        gone = self._tree(key)
        return replace(self, flows=self.flows.join(gone, ["shard", "flow_id"], "left_anti"), steps=self.steps.join(gone, ["shard", "flow_id"], "left_anti"))

    def purge(self, q: rel.Query, now: datetime) -> Engine:
        """With the flows that a purge finds marked as due for deletion."""
        due = rel.purgeable(self.flows, self.steps, q, now, self.shards).select(*self.flows.columns)
        return replace(self, flows=self.flows.join(due.select("shard", "flow_id"), ["shard", "flow_id"], "left_anti").unionByName(due))

    # ---- operations that give rows

    def run(self, name: str, requests: DataFrame) -> DataFrame:
        """Outcomes (flow_id, status, state, error) of a graph for requests (flow_id, state)."""
        return self.registry.run(name, requests)[0]

    def continued(self, key: str, state: str = "{}") -> DataFrame:
        """(thread_id, state): the next turn's state, the final one of the thread's latest completed flow under ``state``."""
        named = self._flow(key).select(sc.flow_key(F.col("shard"), F.col("flow_id"), F.col("flow_token")).alias("key"))
        done = rel.of_thread(self._on_shard(self.flows, key), named).filter("status = 'completed'")
        last = done.groupBy("thread_id").agg(F.max_by("final_state", "flow_id").alias("final_state"))
        return last.select("thread_id", st.encode(st.without_deleted(st.overlay(st.entries(F.coalesce("final_state", F.lit("{}"))), st.entries(F.lit(state))))).alias("state"))

    def snapshot(self, key: str) -> DataFrame:
        leaf = rel.earliest(self._steps(key).filter("status = 'interrupted'"), ["shard", "flow_id"], ["updated_at", "step_id"])
        return lc.snapshots(self._flow(key), leaf)

    def fingerprint(self, key: str) -> DataFrame:
        return rel.fingerprint(self._steps(key), ["shard", "flow_id"])

    def fork(self, key: str, at: int, overrides: dict[str, str], next_id: int) -> DataFrame:
        """The steps of a copy of the flow that goes on from step ``at``."""
        return trees.fork(self._steps(key), at, overrides, next_id)

    def history(self, key: str) -> DataFrame:
        """Steps of the flow and of all that were called below it, in order of flow, depth and id."""
        return trees.history(self._on_shard(self.flows, key), self._on_shard(self.steps, key), self._flow(key)).orderBy("flow_id", "step_depth", "step_id")

    def history_mermaid(self, key: str) -> DataFrame:
        return lc.history_mermaid(self._steps(key))

    def step(self, shard: int, step_id: int) -> DataFrame:
        return self.steps.filter((F.col("shard") == shard) & (F.col("step_id") == step_id))

    def list(self, q: rel.Query, now: datetime) -> DataFrame:
        return rel.list_flows(self.flows, self.steps, q, now, self.shards)

    def shard_info(self) -> DataFrame:
        """(shard, flows, steps)."""
        held = self.steps.groupBy("shard").agg(F.count(F.lit(1)).alias("steps"))
        return self.flows.groupBy("shard").agg(F.count(F.lit(1)).alias("flows")).join(held, "shard", "left").fillna(0, ["steps"])

    def poll(self, key: str) -> DataFrame:
        """The flow, if it has stopped."""
        return self._flow(key).filter(sc.is_stopped(F.col("status")))

    def awaited(self, keys: DataFrame, now: datetime, window_ms: int) -> DataFrame:
        """Stopped flows of the keys (key), and all that stopped within the window."""
        return lc.awaited(self.flows, rel.of_keys(self.flows, keys), now, window_ms)
