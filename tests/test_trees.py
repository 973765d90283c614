import json

import pytest
from pyspark.sql import functions as F

from braid.operators import relational as rel
from braid.operators import trees
from braid.plans.graph import END, Graph
from braid.plans.registry import Registry


def test_chains(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "p long, c long")
    got = trees.ancestors(e, spark.createDataFrame([(3,)], "id long"), "p", "c")
    assert {(r["node"], r["depth"]) for r in got.collect()} == {(3, 0), (2, 1), (1, 2)}
    names = trees.lineage_fields(spark.createDataFrame([(1, ["a"]), (2, ["b", "a"])], "node long, names array<string>"), got).first()
    assert sorted(names["names"]) == ["a", "b"]


def test_chains_of_over_64_levels(spark):
    s = spark.createDataFrame([(i, i - 1, "completed") for i in range(1, 68)], "step_id long, predecessor_id long, status string").coalesce(1)
    assert [r["forked_from"] for r in trees.fork(s, 1, {}, 100).collect()] == [1]
    with pytest.raises(ValueError, match="below depth 2"):
        trees.ancestors(s.limit(5), s.filter("step_id = 5").select("step_id"), "predecessor_id", "step_id", max_depth=2)


def test_fork(spark):
    s = spark.createDataFrame([(10, 0, "completed", "x"), (11, 10, "completed", "y"), (12, 11, "completed", "z"), (13, 10, "failed", "w")], "step_id long, predecessor_id long, status string, state string")
    got = {r["forked_from"]: (r["step_id"], r["predecessor_id"], r["status"], r["state"]) for r in trees.fork(s, 11, {"state": "new"}, 100).collect()}
    assert got == {10: (100, 0, "completed", "x"), 11: (101, 100, "pending", "new"), 13: (102, 100, "failed", "w")}
    members = spark.createDataFrame([(1, 0, "completed"), (1, 1, "failed"), (1, 2, "completed"), (1, 2, "completed")], "lineage_id int, fan_out_ordinal int, status string")
    spawns, rewound = spark.createDataFrame([(1,), (2,)], "lineage_id int"), spark.createDataFrame([(1, 1)], "lineage_id int, fan_out_ordinal int")
    assert {tuple(r) for r in trees.recounted(spawns, members, rewound).collect()} == {(1, 2, 0), (2, 0, 0)}


def test_resume_and_navigation(spark):
    s = spark.createDataFrame([(1, 1, "interrupted", 5, None), (2, 1, "interrupted", 4, None), (3, 2, "interrupted", 1, None)], "step_id int, flow_id int, status string, updated_at int, resume_data string")
    got = {r["step_id"]: (r["status"], r["resume_data"]) for r in trees.resumed(s, spark.createDataFrame([(1, "{}")], "flow_id int, resume_data string")).collect()}
    assert got == {1: ("interrupted", None), 2: ("pending", "{}"), 3: ("interrupted", None)}
    n = spark.createDataFrame([(1, 1, 0, 2), (2, 1, 1, 3), (3, 1, 2, 0), (7, 9, 0, 8), (8, 9, 7, 0)], "step_id int, flow_id int, predecessor_id int, successor_id int")
    nav = {r["step_id"]: (r["previous"], r["next"]) for r in trees.navigation(n, spark.createDataFrame([(9, 2)], "flow_id int, caller int")).collect()}
    assert nav == {1: (0, 2), 2: (1, 3), 3: (2, 0), 7: (2, 8), 8: (7, 3)}


def test_history_is_nested(spark):
    flows = spark.createDataFrame([(1, 0), (2, 11), (3, 11), (4, 31)], "flow_id int, surgraph_step_id int")
    steps = spark.createDataFrame([(10, 1, 1), (11, 1, 2), (20, 2, 1), (30, 3, 2), (31, 3, 1)], "step_id int, flow_id int, step_depth int")
    rows = trees.history(flows, steps, flows.filter("flow_id = 1"))
    assert {(r["step_id"], r["level"], r["sub_flow_id"]) for r in rows.collect()} == {(10, 0, None), (11, 0, 3), (31, 1, None), (30, 1, None)}
    got = {r["root"]: json.loads(r["history"]) for r in trees.nested(rows, ["step_id"]).collect()}
    assert got == {1: [{"step_id": 10}, {"step_id": 11, "sub_history": [{"step_id": 31}, {"step_id": 30}]}]}


def test_subgraph_call(spark):
    child = Graph("child").chain("c", END)
    double = lambda s: F.when(F.element_at(s, "n") == "13", F.create_map(F.lit("$error"), F.lit('"unlucky"'))).otherwise(F.create_map(F.lit("m"), (F.element_at(s, "n").cast("int") * 2).cast("string"), F.lit("private"), F.lit("1")))
    r = Registry().graph(child).task("c", double)
    rows = spark.createDataFrame([(1, '{"x":4}'), (2, '{"x":13}')], "flow_id long, state string")
    got = {x["flow_id"]: (json.loads(x["state"]), x["error"]) for x in r.call("child", rows, {"n": "x"}, {"y": "m"}).collect()}
    assert got == {1: ({"x": 4, "y": 8}, None), 2: ({"x": 13}, "unlucky")}


def test_recount_bounds_the_rows_of_a_task(spark, monkeypatch):
    monkeypatch.setattr("braid.sources.staging.ROWS_A_TASK", 500, raising=False)
    m = spark.range(6000).select((F.col("id") / 4).cast("long").alias("lineage_id"), (F.col("id") % 4).cast("int").alias("fan_out_ordinal"), F.when(F.col("id") % 3 == 0, "failed").otherwise("completed").alias("status"))
    out = trees.recounted(m.select("lineage_id").distinct(), m, m.filter("fan_out_ordinal = 2").select("lineage_id", "fan_out_ordinal"))
    assert max(out.rdd.glom().map(len).collect()) <= 400
    want = {k: (3, sum(i % 3 == 0 for i in range(4 * k, 4 * k + 4) if i % 4 != 2)) for k in range(1500)}
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == want


def test_recount_of_missing_keys(spark):
    m = spark.createDataFrame([(None, 1, "failed"), (None, 2, "failed"), (5, None, "failed"), (5, 2, "failed"), (5, 3, "completed"), (5, 3, "failed")], "lineage_id long, fan_out_ordinal int, status string")
    got = trees.recounted(m.select("lineage_id").distinct(), m, m.filter("fan_out_ordinal = 2").select("lineage_id", "fan_out_ordinal"))
    assert {tuple(r) for r in got.collect()} == {(None, 1, 1), (5, 1, 1)}  # as the SQL of fork_recount counts them


def _walked(edges, starts):
    """(root, node): least depth, by brute force."""
    out = {}
    for s in starts:
        level, d = {s}, 0
        while level:
            out.update({(s, n): d for n in level})
            level, d = {c for n in level for p, c in edges if p == n and (s, c) not in out}, d + 1
    return out


def test_walks_of_all_forms_equal_brute_force(spark):
    forest = [(i // 2, i) for i in range(2, 40)] + [(101, 102), (102, 103), (103, 101), (102, 104), (104, 105)]
    chains = [(c, p) for p, c in forest if c < 40] + [(60, 61), (61, 62), (62, 63), (63, 64), (64, 65), (65, 66), (66, 64), (70, 71), (71, 70), (80, 80)]
    graph = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (3, 5), (5, 6), (6, 6)]
    for form, edges in (("forest", forest), ("chains", chains), ("graph", graph)):
        starts = sorted({n for e in edges for n in e})
        df = spark.createDataFrame(edges + edges[:3], "p long, c long")
        assert rel._form(df.select(F.col("p").alias("p_"), F.col("c").alias("c_")))[0] == form
        got = rel.descendants(df, spark.createDataFrame([(s,) for s in starts], "id long"), "p", "c").collect()
        assert {(r["root"], r["node"]): r["depth"] for r in got} == _walked(edges, starts) and len(got) == len(_walked(edges, starts))


def test_levels_of_trees_are_not_held_against_all_visited_nodes(spark, monkeypatch):
    edges = spark.createDataFrame([(i // 2, i) for i in range(2, 200)], "p long, c long").coalesce(1)
    plans = []
    write = rel.batches.add
    monkeypatch.setattr(rel.batches, "add", lambda self, rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(self, rows))
    rel.descendants(edges, spark.createDataFrame([(1,), (3,)], "id long"), "p", "c").count()
    assert len(plans) == 8 and not any("LeftAnti" in p for p in plans)


def test_heights_equal_chains_in_few_rounds(spark, monkeypatch):
    chains = [(c // 2, c) for c in range(2, 40)] + [(i - 1, i) for i in range(101, 170)] + [(None, 90)]
    loops = [(1, 2), (2, 3), (3, 1), (2, 4)]
    several = [(1, 3), (2, 3), (0, 1)]
    rounds = []
    monkeypatch.setattr(trees, "staged", lambda df, name, one=trees.staged: rounds.append(name) or one(df, name))
    for edges, least in ((chains, 5), (loops, 1), (several, 1)):
        starts = sorted({n for e in edges for n in e if n is not None}) + [7, 7, 999]
        want = {}
        for (s, _), d in _walked([(c, p) for p, c in edges if p is not None], starts).items():
            want[s] = max(d, want.get(s, 0))
        rounds.clear()
        got = trees.heights(spark.createDataFrame(edges, "p long, c long"), spark.createDataFrame([(s,) for s in starts], "id long"), "p", "c").collect()
        assert sorted(map(tuple, got)) == sorted(want.items()) and least <= len(rounds) <= 10


def test_calls_are_not_broadcast_by_compressed_size(spark):
    r = Registry().graph(Graph("child").chain("c", END)).task("c", lambda s: F.create_map(F.lit("m"), F.lit("1")))
    plan = r.call("child", spark.range(50).select(F.col("id").alias("flow_id"), F.lit('{"x":4}').alias("state")), {"n": "x"}, {"y": "m"})._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
