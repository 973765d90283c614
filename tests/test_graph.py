import json

import pytest
from pyspark.sql import functions as F

from braid.plans.graph import END, Graph, GraphError
from braid.plans.predicate import PredicateError, compiled


def diamond():
    return Graph("diamond").fan_out("a", "b", "c").chain("b", "d", END).edge("c", "d").fan_in("d").reduce(total="add")


def test_diamond():
    g = diamond().validate()
    assert g.entry == "a" and g.fans_out("a") and not g.fans_out("b") and g.convergence() == {"a": "d"}


@pytest.mark.parametrize("graph, what", [
    (Graph(""), "no name"),
    (Graph("g"), "no tasks"),
    (Graph("g").chain("a", "b"), "nothing leads to the end"),
    (Graph("g", "x").chain("a", END), "entry point"),
    (Graph("g").chain("a", END).edge("z", END), "cannot be reached"),
    (Graph("g").chain("a", END).fan_in("q"), "is no node"),
    (Graph("g").chain("a", END).reduce(x="median"), "unknown reducer"),
    (Graph("g").edge("a", END, for_each="items", goto=True), "at once"),
    (Graph("g").edge("a", END, item="x"), "without forEach"),
    (Graph("g").edge("a", "a", on_error=True).chain("a", END), "never ends"),
    (Graph("g").edge("a", "b", on_error=True, when="x").chain("a", END).chain("b", END), "unconditional"),
    (Graph("g").edge("a", END, switch=True), "needs a condition"),
    (Graph("g").edge("a", END, switch=True, when="true").edge("a", "b").chain("b", END), "mixes switch"),
    (Graph("g").edge("a", END, when="x >"), "condition"),
    (Graph("g").edge("a", "b", on_error=True).edge("a", "c", on_error=True).chain("a", END).chain("b", END).chain("c", END), "several error edges"),
    (Graph("g").fan_out("a", "b", "c").chain("b", END).chain("c", END), "have not met"),
    (Graph("g").chain("a", "d", END).fan_in("d"), "no fan-out is open"),
    (Graph("g").fan_out("a", "b", "c").chain("b", "d", END).chain("c", "e", END).fan_in("d", "e"), "meet in"),
    (Graph("g").edge("a", "d", goto=True).chain("a", END).chain("d", END).fan_in("d"), "no fan-out is open"),
])
def test_faults(graph, what):
    with pytest.raises(GraphError, match=what):
        graph.validate()


def test_for_each_and_nested():
    g = Graph("g").edge("a", "b", for_each="pages", item="page").edge("b", "c", for_each="chunks", item="chunk").chain("c", "j1", "j2", END).fan_in("j1", "j2").validate()
    assert g.convergence() == {"b": "j1", "a": "j2"}
    Graph("g").edge("a", "b", for_each="x", item="i").edge("a", END, goto=True).chain("b", "j", END).fan_in("j").validate()


def test_json_and_tables(spark):
    g = Graph("g").edge("a", "b", switch=True, when="x > 1").edge("a", END, switch=True, when="true").edge("b", "h", on_error=True).chain("b", END).chain("h", END).reduce(n="add").node("b", "https://b")
    text = g.to_json()
    again = Graph.from_json(text)
    assert again.edges == g.edges and again.urls == g.urls and again.reducers == g.reducers and again.to_json() == text
    assert json.loads(text)["transitions"][0] == {"from": "a", "to": "b", "when": "x > 1", "switch": True}
    nodes, edges, reducers = g.tables(spark)
    assert nodes.count() == 3 and edges.count() == 5 and reducers.collect()[0]["reducer"] == "add"
    drawn = g.mermaid()
    assert drawn.startswith("flowchart TD") and "case x #gt; 1" in drawn and "|\"error\"|" in drawn and "default" in drawn


@pytest.mark.parametrize("text, state, want", [
    ("score >= 50", {"score": 80}, True), ("score >= 50", {"score": 20}, False), ("score >= 50", {}, False), ("score >= 50", {"score": "80"}, False),
    ("a == 'x' && !b", {"a": "x", "b": False}, True), ("a == 'x' || b", {"a": "y", "b": True}, True), ("a != 'x'", {"a": "x"}, False), ("a != 'x'", {"a": 1}, True),
    ("(a > 1 || b > 1) && c", {"a": 0, "b": 2, "c": True}, True), ("o.k == 3", {"o": {"k": 3.0}}, True), ("x == null", {}, True), ("x == null", {"x": 0}, False),
    ("n < -1.5", {"n": -2}, True), ("true", {}, True), ("flag", {"flag": "yes"}, False), ("a <= b", {"a": 2, "b": 2}, True), ("a < 'b'", {"a": "a"}, True),
])
def test_conditions(spark, text, state, want):
    df = spark.createDataFrame([(json.dumps(state),)], "s string")
    assert df.select(compiled(text)(F.col("s"))).first()[0] is want


@pytest.mark.parametrize("text", ["", "a >", "(a", "a b", "a == ==", "1 +", "@", "- a"])
def test_bad_conditions(text):
    with pytest.raises(PredicateError):
        compiled(text)
