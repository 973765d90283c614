from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from braid.operators import routing as rt
from braid.operators.relational import Query
from braid.plans.engine import Engine
from braid.plans.registry import Registry
from braid.sources import staging, tables

T0 = datetime(2024, 1, 1)


def frame(spark, name, rows):
    """Rows of dicts as the declared table; columns that are not given are null."""
    declared = spark.createDataFrame([], tables.SCHEMAS[name]).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in declared) for r in rows], declared)


def flow(i, status, shard=1, up=0, thread=1, **more):
    return {"shard": shard, "flow_id": i, "flow_token": f"t{i}", "status": status, "surgraph_flow_id": up, "surgraph_step_id": up * 10, "root_flow_id": up or i, "thread_id": thread, "delete_after_ms": 0, "step_id": i * 10, "created_at": T0, "updated_at": T0, "workflow_url": "u", "priority": 1, "fairness_key": "k", "fairness_weight": 1.0} | more


def step(i, flow_id, status, shard=1, **more):
    return {"shard": shard, "step_id": i, "flow_id": flow_id, "status": status, "step_depth": 1, "task_name": f"s{i}", "predecessor_id": 0, "successor_id": 0, "lineage_id": 0, "created_at": T0, "updated_at": T0, "state": "{}", "changes": "{}"} | more


@pytest.fixture(scope="module")
def engine(spark):
    flows = [
        flow(1, "running"), flow(2, "interrupted", up=1), flow(3, "completed", final_state='{"n":1,"gone":2}'), flow(4, "completed", final_state='{"n":5,"m":6}'),
        flow(1, "completed", shard=2, thread=9, final_state="{}"),
    ]
    steps = [step(10, 1, "completed", successor_id=11), step(11, 1, "running", predecessor_id=10, step_depth=2), step(20, 2, "interrupted", state='{"q":1}'), step(30, 3, "completed"), step(40, 4, "completed"), step(10, 1, "completed", shard=2)]
    return Engine(Registry(), frame(spark, "flows", flows).cache(), frame(spark, "steps", steps).cache(), 2)


def statuses(e):
    return {(r["shard"], r["flow_id"]): r["status"] for r in e.flows.collect()}


def test_a_key_reads_its_own_flow_only(engine):
    assert [r["step_id"] for r in engine.history("1-1-t1").collect()] == [10, 11, 20]
    assert engine.history("1-1-wrong").count() == 0 and engine.history("no key").count() == 0
    assert engine.fingerprint("2-1-t1").count() == 1 and engine.step(2, 10).count() == 1
    assert engine.poll("1-1-t1").count() == 0 and engine.poll("2-1-t1").count() == 1
    assert "s10" in engine.history_mermaid("1-1-t1").first()["diagram"]
    assert engine.snapshot("1-2-t2").first()["snapshot"] == '{"q":1}' and engine.snapshot("1-3-t3").first()["snapshot"] == '{"n":1,"gone":2}'
    assert {(r["shard"], r["flows"], r["steps"]) for r in engine.shard_info().collect()} == {(1, 4, 5), (2, 1, 1)}


def test_a_cancelled_or_deleted_tree_takes_its_called_flows(engine):
    assert statuses(engine.cancel("1-1-t1", "enough")) == {(1, 1): "cancelled", (1, 2): "cancelled", (1, 3): "completed", (1, 4): "completed", (2, 1): "completed"}
    left = engine.delete("1-1-t1")
    assert set(statuses(left)) == {(1, 3), (1, 4), (2, 1)} and left.steps.count() == 3
    assert statuses(engine.delete("1-1-t2")) == statuses(engine)


def test_turns_resume_create_and_purge(spark, engine):
    back = {(r["shard"], r["step_id"]): (r["status"], r["resume_data"]) for r in engine.resume("1-2-t2", '"go"').steps.collect()}
    assert back[(1, 20)] == ("pending", '"go"') and back[(1, 11)] == ("running", None) and len(back) == 6
    assert engine.continued("1-3-t3", '{"m":7}').first()["state"] == '{"m":7,"n":5}'
    more = engine.create(frame(spark, "flows", [flow(7, "pending", thread=0)]))
    assert more.flows.count() == 6 and more.steps.filter("step_id = 7 AND status = 'pending'").count() == 1
    gone = engine.purge(Query(status="completed"), T0 + timedelta(days=1))
    assert gone.flows.filter("delete_after_ms > 0").count() == 3 and gone.flows.count() == 5
    keys = spark.createDataFrame([("1-3-t3",), ("1-1-t1",)], "key string")
    assert {r["flow_id"] for r in engine.awaited(keys, T0 + timedelta(days=9), 1000).collect()} == {3}


def test_beyond_the_limit_nothing_is_broadcast(spark, monkeypatch):
    steps = spark.createDataFrame([(1, "a", "b"), (2, "a", "x"), (3, "a", None)], "step_id long, task_name string, goto string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "from_task string, to_task string")
    plan = lambda: rt.goto_edges(steps, "goto", edges)
    near = plan()
    monkeypatch.setattr(staging, "MAX_BROADCAST", 1)
    far = plan()
    hint = lambda df: "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hint(near) and not hint(far)
    assert sorted(map(str, near.collect())) == sorted(map(str, far.collect()))
    assert {r["step_id"]: (r["target"], r["error"]) for r in far.collect()} == {1: ("b", None), 2: (None, "no goto edge to x"), 3: (None, None)}
