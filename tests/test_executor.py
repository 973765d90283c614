import json

import pytest
from pyspark.sql import functions as F

from braid.plans.executor import run
from braid.plans.graph import END, Graph


def put(**fields):
    """A task that sets fields to JSON texts."""
    return lambda s: F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v(s) if callable(v) else F.lit(json.dumps(v)))])


def outcomes(spark, graph, states, tasks):
    df = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(states)], "flow_id long, state string")
    out, steps = run(graph, df, tasks)
    return {r["flow_id"]: (r["status"], json.loads(r["state"]), r["error"]) for r in out.collect()}, steps


def test_reducers_meet(spark):
    g = Graph("g").fan_out("a", "b", "c", "d").edge("b", "j").edge("c", "j").edge("d", "j").chain("j", END).fan_in("j")
    g.reduce(total="add", tags="append", seen="union", lo="min", ok="and", word="concat", obj="merge")
    tasks = {
        "b": put(total=10, tags=["b"], seen=["x"], lo=5, ok=True, word="a", obj={"k1": 1}),
        "c": put(total=20, tags=["c"], seen=["y", "x"], lo=2, ok=True, word="b", obj={"k2": 2}),
        "d": put(total=30, tags=["d"], seen=["z"], lo=9, ok=False, word="c", obj={"k1": 9}),
        "j": put(done=True),
    }
    got, steps = outcomes(spark, g, [{}, {"total": 5, "tags": ["seed"], "gone": 1}], tasks)
    want = {"total": 60, "tags": ["b", "c", "d"], "seen": ["x", "y", "z"], "lo": 2, "ok": False, "word": "abc", "obj": {"k1": 9, "k2": 2}, "done": True}
    assert got[0] == ("completed", want, None)
    assert got[1][1]["total"] == 65 and got[1][1]["tags"] == ["seed", "b", "c", "d"] and got[1][1]["gone"] == 1
    assert steps.count() == 10


def test_a_bound_with_flows_under_way_is_an_error(spark):
    g, flows = Graph("g").chain("a", "b", "c", END), spark.createDataFrame([(1, "{}")], "flow_id long, state string")
    with pytest.raises(ValueError, match="under way after 2 levels"):
        run(g, flows, {}, max_levels=2)
    assert run(g, flows, {}, max_levels=3)[0].count() == 1


def test_for_each_keeps_order_and_fires_when_empty(spark):
    g = Graph("g").edge("a", "b", for_each="items", item="it").chain("b", "j", END).fan_in("j").reduce(n="add", out="append")
    got, _ = outcomes(spark, g, [{"items": ["x", "y", "z"], "n": 10}, {"items": []}, {}], {"b": put(n=1, out=lambda s: F.element_at(s, "it"))})
    assert got[0] == ("completed", {"items": ["x", "y", "z"], "n": 13, "out": ["x", "y", "z"]}, None)
    assert got[1] == ("completed", {"items": []}, None) and got[2] == ("completed", {}, None)


def test_switch_goto_and_error(spark):
    g = Graph("g").edge("a", "hi", switch=True, when="x >= 10").edge("a", "lo", switch=True, when="x >= 1").edge("a", "h", on_error=True).edge("a", "side", goto=True)
    g.chain("hi", END).chain("lo", END).chain("h", END).chain("side", END)
    task = lambda s: F.when(F.element_at(s, "x") == "13", F.create_map(F.lit("$error"), F.lit('"bad"'), F.lit("y"), F.lit("1"))).when(F.element_at(s, "x") == "7", F.create_map(F.lit("$goto"), F.lit('"side"'))).when(F.element_at(s, "x") == "8", F.create_map(F.lit("$goto"), F.lit('"nowhere"')))
    got, _ = outcomes(spark, g, [{"x": 20}, {"x": 2}, {"x": 0}, {"x": 13}, {"x": 7}, {"x": 8}], {"a": task, **{n: put(at=n) for n in ("hi", "lo", "h", "side")}})
    assert [got[i][1].get("at") for i in range(6)] == ["hi", "lo", None, "h", "side", None]
    assert got[3][1] == {"x": 13, "onErr": "bad", "at": "h"} and got[2][0] == "completed" and got[5][0] == "failed"


def test_nested_and_failing_cohorts(spark):
    g = Graph("g").edge("a", "p", for_each="pages", item="page").edge("p", "c", for_each="chunks", item="chunk").chain("c", "j1", "j2", END).fan_in("j1", "j2").reduce(text="append", pages_done="append")
    tasks = {
        "p": put(chunks=lambda s: F.concat(F.lit("["), F.element_at(s, "page"), F.lit(","), F.element_at(s, "page"), F.lit("]"))),
        "c": lambda s: F.when(F.element_at(s, "chunk") == "9", F.create_map(F.lit("$error"), F.lit('"nine"'))).otherwise(F.create_map(F.lit("text"), F.element_at(s, "chunk"))),
        "j1": put(pages_done=lambda s: F.element_at(s, "page")),
    }
    got, _ = outcomes(spark, g, [{"pages": [1, 2, 3]}, {"pages": [1, 9]}], tasks)
    assert got[0][0] == "completed" and got[0][1]["pages_done"] == [1, 2, 3] and "page" not in got[0][1] and "chunkIndex" not in got[0][1]
    # the failed branch fails its cohort and that the flow; the siblings' pages are there, the loops' own fields are not
    assert got[1] == ("failed", {"pages": [1, 9], "chunks": [9, 9], "pages_done": [1]}, "nine")


def test_siblings_run_on_and_the_failed_cohort_is_folded(spark):
    g = Graph("g").edge("a", "cell", for_each="items", item="it").chain("cell", "enrich", "j", END).fan_in("j").reduce(out="append", n="add")
    tasks = {
        "a": put(n=100),
        "cell": lambda s: F.when(F.element_at(s, "it") == "2", F.create_map(F.lit("$error"), F.lit('"two"'))).otherwise(F.create_map(F.lit("out"), F.element_at(s, "it"))),
        "enrich": put(n=1, itCount=7),
    }
    got, steps = outcomes(spark, g, [{"items": [1, 2, 3], "n": 5}, {"items": [1, 3]}], tasks)
    assert got[0] == ("failed", {"items": [1, 2, 3], "n": 107, "out": [1, 3]}, "two")
    assert got[1] == ("completed", {"items": [1, 3], "n": 102, "out": [1, 3]}, None)
    assert steps.filter("flow_id = 0 AND node = 'enrich'").count() == 2 and steps.filter("flow_id = 0 AND node = 'j'").count() == 0


def test_terminal_merge_reduces_and_type_errors_fail(spark):
    g = Graph("g").edge("a", "b", for_each="items").chain("b", "j", END).fan_in("j").reduce(n="add", tags="append")
    value = lambda s: F.element_at(s, "item")
    got, _ = outcomes(spark, g, [{"items": [1, 2], "n": 10}, {"items": [1, "x"]}, {"items": [1], "n": "text"}, {"items": {"no": "list"}}, {"items": None, "tags": 3}], {"b": put(n=value), "j": put(n=5)})
    assert got[0] == ("completed", {"items": [1, 2], "n": 18}, None)
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["failed", "failed", "failed", "completed"]
    assert got[1][2] == got[2][2] == "reducer 'add' for field 'n': wrong type" and got[3][2] == "forEach field 'items' is not an array"


def test_straight_graphs_end_without_folds(spark, monkeypatch):
    from braid.plans import executor

    g = Graph("g").edge("a", "b", switch=True, when="n > 1").edge("a", "c", switch=True, when="true").edge("a", "d", on_error=True).chain("b", END).chain("c", END).chain("d", END)
    n = lambda s: F.element_at(s, "n")
    tasks = {
        "a": lambda s: F.when(n(s) == "3", F.create_map(F.lit("$error"), F.lit('"three"'))).otherwise(F.create_map(F.lit("m"), n(s), F.lit("$own"), F.lit("1"))),
        "b": lambda s: F.create_map(F.lit("n"), F.lit("null"), F.lit("$x"), F.lit("1")),
        "c": lambda s: F.when(n(s) == "0", F.create_map(F.lit("$error"), F.lit('"zero"'))).otherwise(F.create_map(F.lit("c"), F.lit('"x"'))),
    }
    flows = spark.createDataFrame([(1, '{"n":0}'), (2, '{"n":1,"k":[1]}'), (3, '{"n":2}'), (4, '{"n":3}'), (5, None)], "flow_id long, state string")
    out, _ = executor.run(g, flows, tasks)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(executor, "_straight", lambda g: False)
    want, _ = executor.run(g, flows, tasks)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and out.count() == 5
