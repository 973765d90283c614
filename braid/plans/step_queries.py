"""Queries over stored steps, trees and peers, with the DuckDB SQL that gives the same rows; they join those of ``queries``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from braid.functions import scalars as sc
from braid.functions import state as st
from braid.operators import lifecycle as lc
from braid.operators import relational as rel
from braid.operators import routing as rt
from braid.operators import scheduling as sch
from braid.operators import states as sts
from braid.operators import trees
from braid.plans.graph import END, Graph
from braid.plans.predicate import compiled
from braid.plans.queries import FLOWS, NOW_SQL, STEPS, query
from braid.plans.registry import Registry
from braid.sources import tables
from braid.sources.tables import NOW, flows, read, steps

# ---------------------------------------------------------------- terminal, cohort and final states


def _map(**fields):
    """MAP column of field -> JSON text."""
    return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v if not isinstance(v, str) else F.lit(v))])


def _json(text):
    return F.concat(F.lit('"'), text, F.lit('"'))


def _number(state: str, name: str):
    return F.element_at(state, name).cast("double").cast("long")


def _members(spark, sf_dir):
    """The events of a user as the members of its cohort: steps of flow user_id inside of spawn 0, of which errors failed."""
    status = F.when(F.col("event_type") == "error", "failed").otherwise("completed")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("flow_id"), (F.col("event_id") + 1).alias("step_id"), F.lit(0).cast("long").alias("lineage_id"), F.col("event_id").alias("fan_out_ordinal"), F.lit(2).alias("step_depth"), status.alias("status"), F.lit("event").alias("task_name"), F.lit(True).alias("tail"), "value", "event_type")


def _spawns(spark, sf_dir, **state):
    own = read(spark, sf_dir, "events").select(F.col("user_id").alias("flow_id")).distinct()
    own = own.withColumns({"step_id": F.lit(0).cast("long"), "lineage_id": F.lit(None).cast("long"), "fan_out_ordinal": F.lit(0).cast("long"), "step_depth": F.lit(1), "status": F.lit("completed"), "task_name": F.lit("spawn"), "tail": F.lit(False)})
    return own.withColumns(state)


@query("""WITH t AS (SELECT user_id AS flow_id, event_id, event_type <> 'error' AS ok, event_type AS kind FROM events), f AS (SELECT flow_id, bool_or(ok) AS has FROM t GROUP BY 1),
 u AS (SELECT t.* FROM t JOIN f ON t.flow_id = f.flow_id WHERE ok OR NOT has) SELECT flow_id, CAST(min(event_id) + 1 + count(*) AS BIGINT) AS n, last(kind ORDER BY event_id) AS kind FROM u GROUP BY 1""")
def terminal_merge(spark, sf_dir):
    """The first completed tail's state with all completed tails' changes; of any status where none completed."""
    rows = _members(spark, sf_dir).withColumn("state", _map(n=F.col("step_id").cast("string"))).withColumn("changes", _map(n="1", kind=_json(F.col("event_type"))))
    out = sts.terminal_states(rows, {"n": "add"})
    return out.select("flow_id", _number("state", "n").alias("n"), sts.text_of(F.element_at("state", "kind")).alias("kind"))


@query("""SELECT user_id AS flow_id, CAST(7 + coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_type <> 'error'), 0) AS BIGINT) AS total,
 '<' || coalesce(string_agg(substr(event_type, 1, 1), '' ORDER BY event_id) FILTER (WHERE event_type <> 'error'), '') AS word FROM events GROUP BY 1""")
def failed_cohort(spark, sf_dir):
    """The spawn's state and changes, then the changes of its completed members by branch."""
    spawns = _spawns(spark, sf_dir, state=_map(total="7"), changes=_map(word='"<"'))
    members = _members(spark, sf_dir).withColumn("state", _map(total="99")).withColumn("changes", _map(total=F.floor("value").cast("string"), word=_json(F.substring("event_type", 1, 1))))
    rows = spawns.unionByName(members.select(*spawns.columns))
    out = sts.cohort_states(spawns.select("flow_id", F.col("step_id").alias("lineage_id")), rows, {"total": "add", "word": "concat"})
    return out.select("flow_id", _number("state", "total").alias("total"), sts.text_of(F.element_at("state", "word")).alias("word"))


@query("""SELECT user_id AS flow_id, CASE WHEN user_id % 2 = 0 THEN 3 ELSE 5 + count(*) FILTER (WHERE event_type <> 'error') END AS n, user_id % 2 = 0 AS has_item FROM events GROUP BY 1""")
def final_state(spark, sf_dir):
    """Flows of even id met and ended outside of their cohort, those of odd id failed inside of it."""
    even = F.pmod("flow_id", F.lit(2)) == 0
    spawns = _spawns(spark, sf_dir, state=_map(n="5", item='"spawn"'), changes=_map(other="1"))
    last = _spawns(spark, sf_dir, state=_map(n="1", item='"kept"'), changes=_map(n="2")).filter(even).withColumns({"step_id": F.lit(1 << 40), "tail": F.lit(True), "task_name": F.lit("last")})
    members = _members(spark, sf_dir).withColumns({"state": _map(n="9", item='"x"'), "changes": _map(n="1"), "tail": ~even})
    rows = spawns.unionByName(last).unionByName(members.select(*spawns.columns))
    out = sts.final_states(rows, {"n": "add"}, {"spawn": ["item", "itemIndex", "itemCount"]})
    return out.select("flow_id", _number("state", "n").alias("n"), F.map_contains_key("state", F.lit("item")).alias("has_item"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'O') AS waits FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
 c AS (SELECT o_custkey, count(*) AS size, count(*) FILTER (WHERE r = 0) AS fine, count(*) FILTER (WHERE r > 0 AND waits = 0) AS lost FROM o GROUP BY 1)
 SELECT o_custkey AS flow_id, fine + lost AS arrivals, lost AS failures, lost > 0 AND fine + lost >= size AS failed FROM c""")
def failure_climb(spark, sf_dir):
    """Lines fail in the cohort of their order, complete orders in that of their customer, and that fails the flow."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    bad = F.col("l_returnflag") == "R"
    inner = lines.groupBy("o_custkey", "o_orderkey").agg(F.count(F.lit(1)).alias("cohort_size"), F.count_if(~bad & (F.col("l_linestatus") != "O")).alias("cohort_arrivals"), F.count_if(bad).alias("bad"))
    outer = inner.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("cohort_size"), F.count_if(F.col("bad") == 0).alias("cohort_arrivals"))
    none = F.lit(0).cast("long").alias("cohort_failures")
    spawns = inner.select(F.col("o_orderkey").cast("long").alias("step_id"), F.col("o_custkey").cast("long").alias("flow_id"), (-F.col("o_custkey") - 1).cast("long").alias("lineage_id"), "cohort_size", "cohort_arrivals", none)
    spawns = spawns.unionByName(outer.select((-F.col("o_custkey") - 1).cast("long").alias("step_id"), F.col("o_custkey").cast("long").alias("flow_id"), F.lit(None).cast("long").alias("lineage_id"), "cohort_size", "cohort_arrivals", none))
    after, lost = sts.climbed(spawns, lines.filter(bad).select(F.col("o_orderkey").cast("long").alias("step_id")))
    return after.filter("lineage_id IS NULL").join(lost.withColumn("failed", F.lit(True)), "flow_id", "left").select("flow_id", F.col("cohort_arrivals").alias("arrivals"), F.col("cohort_failures").alias("failures"), F.coalesce("failed", F.lit(False)).alias("failed"))


@query("""SELECT event_type, CASE WHEN event_id % 5 = 0 THEN 'reducer ''add'' for field ''n'': wrong type' END AS error, count(*) AS n, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 1 + event_id % 3 END) AS BIGINT) AS total FROM events GROUP BY ALL""")
def reducer_errors(spark, sf_dir):
    """A4, A10: an operand of the wrong type is an error and leaves the base; a cleared one is none."""
    n = F.when(F.pmod("event_id", F.lit(5)) == 0, F.lit('"text"')).when(F.pmod("event_id", F.lit(3)) == 0, F.lit("null")).otherwise(F.pmod("event_id", F.lit(3)).cast("string"))
    e = read(spark, sf_dir, "events").select("event_id", "event_type", n.alias("v"))
    out = sts.reduce_states(e.select("event_id", _map(n="1").alias("base")), e.select("event_id", F.struct(F.lit(0).alias("at")).alias("o"), _map(n=F.col("v")).alias("delta")), ["event_id"], {"n": "add"})
    return out.join(e.select("event_id", "event_type"), "event_id").groupBy("event_type", "error").agg(F.count(F.lit(1)).alias("n"), F.sum(_number("state", "n")).alias("total"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '1%')""")
def customers_not_waiting(spark, sf_dir):
    """Anti join."""
    waiting = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_orderpriority LIKE '1%'")
    return read(spark, sf_dir, "customer").join(waiting, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# ---------------------------------------------------------------- trees

_CHILDREN = "c AS (SELECT s.flow_id AS parent, max(f.flow_id) AS child FROM flows f JOIN steps s ON s.step_id = f.surgraph_flow_id WHERE f.surgraph_flow_id <> 0 GROUP BY 1)"


def _tree(spark, sf_dir):
    return flows(spark, sf_dir).withColumn("surgraph_step_id", F.col("surgraph_flow_id"))


@query(f"""WITH RECURSIVE {STEPS}, {_CHILDREN}, t AS (SELECT flow_id AS root, flow_id, 0 AS level FROM flows WHERE surgraph_flow_id = 0 UNION ALL SELECT root, child, level + 1 FROM t JOIN c ON parent = flow_id)
 SELECT root, t.flow_id, level, step_id, task_name, CASE WHEN child % 5 <> 0 THEN child ELSE 0 END AS sub_flow_id FROM t JOIN steps s ON s.flow_id = t.flow_id LEFT JOIN c ON parent = t.flow_id""")
def history_tree(spark, sf_dir):
    """The steps below each root, with the latest child of each caller."""
    f, s = _tree(spark, sf_dir), steps(spark, sf_dir)
    out = trees.history(f, s, f.filter("surgraph_flow_id = 0").select("flow_id"))
    return out.select("root", "flow_id", "level", "step_id", "task_name", F.coalesce("sub_flow_id", F.lit(0)).cast("long").alias("sub_flow_id"))


@query(f"""WITH {FLOWS} SELECT surgraph_flow_id, max(flow_id) AS flow_id FROM flows WHERE surgraph_flow_id <> 0 GROUP BY 1""")
def latest_child(spark, sf_dir):
    """The child that a caller launched last."""
    return rel.latest(flows(spark, sf_dir).filter("surgraph_flow_id <> 0"), ["surgraph_flow_id"], ["flow_id"]).select("surgraph_flow_id", "flow_id")


@query("""WITH RECURSIVE t AS (SELECT o_orderkey AS root, o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderpriority LIKE '1%' UNION SELECT root, o_orderkey // 2, depth + 1 FROM t JOIN orders ON o_orderkey = node WHERE o_orderkey > 1)
 SELECT root, max(depth) AS depth FROM t GROUP BY 1""")
def ancestor_chains(spark, sf_dir):
    """How far up the chain of callers of each urgent flow goes."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    return trees.heights(o.filter("id > 1").select(F.floor(F.col("id") / 2).alias("up"), "id"), o.filter("o_orderpriority LIKE '1%'").select("id"), "up", "id")


@query(f"""WITH {STEPS}, r AS (SELECT flow_id, step_id, row_number() OVER (PARTITION BY priority ORDER BY updated_at, step_id) AS rn, status, priority FROM steps WHERE status = 'interrupted')
 SELECT s.step_id, CASE WHEN r.rn = 1 THEN 'pending' ELSE s.status END AS status, CASE WHEN r.rn = 1 THEN 'go' || s.priority END AS resume_data FROM steps s LEFT JOIN r ON r.step_id = s.step_id""")
def resumes(spark, sf_dir):
    """The earliest interrupted leaf of each flow (here: priority) is pending again, with its data."""
    s = steps(spark, sf_dir).withColumn("flow_id", F.col("priority")).withColumn("resume_data", F.lit(None).cast("string"))
    return trees.resumed(s, s.select("flow_id").distinct().withColumn("resume_data", F.concat(F.lit("go"), F.col("flow_id").cast("string")))).select("step_id", "status", "resume_data")


@query("""WITH m AS (SELECT l_orderkey AS lineage_id, l_linenumber AS branch, l_returnflag = 'R' AS bad FROM lineitem) SELECT lineage_id, count(DISTINCT branch) FILTER (WHERE branch <> 2) AS cohort_arrivals, count(*) FILTER (WHERE bad AND branch <> 2) AS cohort_failures FROM m GROUP BY 1""")
def fork_recount(spark, sf_dir):
    """Counters of each cohort without the branch that holds the rewound step."""
    m = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lineage_id"), F.col("l_linenumber").alias("fan_out_ordinal"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("status"))
    return trees.recounted(m.select("lineage_id"), m, m.filter("fan_out_ordinal = 2").select("lineage_id", "fan_out_ordinal"))


@query(f"""WITH {FLOWS} SELECT flow_id, CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN CASE WHEN flow_id % 2 = 0 THEN 'f' || flow_id ELSE '{{}}' END WHEN status = 'interrupted' AND flow_id % 3 = 0 THEN 'l' || flow_id ELSE '{{}}' END AS snapshot FROM flows""")
def snapshots(spark, sf_dir):
    """The final state of ended flows, the leaf's of interrupted ones, none of running ones."""
    f = flows(spark, sf_dir).withColumn("final_state", F.when(F.pmod("flow_id", F.lit(2)) == 0, F.concat(F.lit("f"), F.col("flow_id").cast("string"))))
    leaves = f.filter(F.pmod("flow_id", F.lit(3)) == 0).select("shard", "flow_id", F.concat(F.lit("l"), F.col("flow_id").cast("string")).alias("state"))
    return lc.snapshots(f, leaves).select("flow_id", "snapshot")


# ---------------------------------------------------------------- listing in full (P1, P3, P4, P6), detectors


@query(f"""WITH {FLOWS} SELECT shard || '-' || flow_id || '-' || flow_token AS flow_key, workflow_name, status, trim(error) AS error, surgraph_flow_id <> 0 AS subgraph, md5(CAST(flow_id AS VARCHAR)) AS trace_id, thread_id, priority, fairness_key
 FROM flows WHERE workflow_url = 'https://host/urgent' AND fairness_key = 'k2'""")
def flow_summaries(spark, sf_dir):
    """The listing's own columns of the flows of a workflow and a key."""
    f = flows(spark, sf_dir).withColumn("trace_parent", F.concat(F.lit("00-"), F.md5(F.col("flow_id").cast("string").cast("binary")), F.lit("-00f067aa0ba902b7-01")))
    q = rel.Query(workflow_url="https://host/urgent", fairness_key="k2", include_subgraphs=True)
    found = rel.with_current_step(f.withColumn("delete_after_ms", F.lit(0)), steps(spark, sf_dir)).filter(rel.predicate(q, NOW))
    return rel.summaries(found).select("flow_key", "workflow_name", "status", "error", "subgraph", "trace_id", "thread_id", "priority", "fairness_key")


@query(f"""WITH {FLOWS}, a AS (SELECT thread_id, shard FROM flows WHERE flow_id = (SELECT max(flow_id) FROM flows)) SELECT f.flow_id, f.status FROM flows f JOIN a ON f.thread_id = a.thread_id AND f.shard = a.shard""")
def list_by_thread(spark, sf_dir):
    """The flows of the thread of a flow that a key names, on the key's shard."""
    f = flows(spark, sf_dir)
    key = f.orderBy(F.desc("flow_id")).limit(1).select(sc.flow_key(F.col("shard") + 1, F.col("flow_id"), F.col("flow_token")).alias("key"))
    named = f.withColumn("shard", F.col("shard") + 1)  # keys number shards from 1
    return rel.of_thread(named, key).select("flow_id", "status")


@query(f"""WITH {STEPS} SELECT shard, flow_id FROM flows f WHERE status = 'running' AND NOT EXISTS (SELECT 1 FROM steps s WHERE s.shard = f.shard AND s.flow_id = f.flow_id AND s.status NOT IN ('completed', 'failed', 'cancelled'))
 AND NOT EXISTS (SELECT 1 FROM steps s WHERE s.shard = f.shard AND s.flow_id = f.flow_id AND s.updated_at >= {NOW_SQL} - to_days(400)) AND f.updated_at < {NOW_SQL} - to_days(400)""")
def long_stalled_flows(spark, sf_dir):
    """Running flows without a live step and without a step that changed lately."""
    return rel.stalled(flows(spark, sf_dir), steps(spark, sf_dir), 400 * 86_400_000, NOW).select("shard", "flow_id")


# ---------------------------------------------------------------- peers (S18, S19, A27), choices (L11, D9), graphs

_AT = "TIMESTAMP '2024-01-05 00:00:00'"
_DAY = 86_400_000


def _beats(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(4)).cast("int").alias("shard"), F.col("user_id").alias("engine_id"), F.col("ts").cast("timestamp").alias("seen_at"), F.when(F.col("event_type") == "click", F.col("ts").cast("timestamp")).alias("dispatched_at"), "event_id")


@query(f"""SELECT user_id AS engine_id, epoch_ms(max(ts)) // 1000 AS seen FROM events GROUP BY 1 HAVING epoch_ms({_AT}) - epoch_ms(max(ts)) <= 2 * {_DAY}::BIGINT""")
def heartbeats(spark, sf_dir):
    """Beats upserted in two lots, then the stale replicas pruned."""
    b = _beats(spark, sf_dir)
    now = tables.beats(b.filter("event_id % 2 = 0").drop("event_id"), b.filter("event_id % 2 = 1").drop("event_id"))
    return tables.pruned(now, datetime(2024, 1, 5), 2 * _DAY).select("engine_id", F.call_function("div", sc.epoch_millis(F.col("seen_at")), F.lit(1000)).alias("seen"))


@query(f"""WITH p AS (SELECT user_id AS id, epoch_ms({_AT}) - epoch_ms(max(ts)) AS seen, epoch_ms({_AT}) - epoch_ms(max(CASE WHEN event_type = 'click' THEN ts END)) AS sent FROM events GROUP BY 1),
 f AS (SELECT * FROM p WHERE seen <= {_DAY}), d AS (SELECT * FROM f WHERE sent <= {_DAY}) SELECT (SELECT count(*) FROM f) + CASE WHEN EXISTS (SELECT 1 FROM f WHERE id = 7) THEN 0 ELSE 1 END AS replicas, (SELECT count(*) FROM d) AS dispatchers,
 CAST(CASE WHEN EXISTS (SELECT 1 FROM d WHERE id = 7) THEN (SELECT count(*) FROM d WHERE id < 7) ELSE -1 END AS INT) AS ordinal, (SELECT count(*) FROM p WHERE seen > 2 * {_DAY}::BIGINT AND id <> 7) AS dead""")
def peer_view(spark, sf_dir):
    """What replica 7 sees: replicas (itself always), dispatchers, its ordinal among them, dead ones."""
    b = _beats(spark, sf_dir).groupBy("engine_id").agg(F.max("seen_at").alias("seen_at"), F.max("dispatched_at").alias("dispatched_at"))
    return rel.peer_view(b, 7, datetime(2024, 1, 5), _DAY, _DAY, 2 * _DAY).select("replicas", "dispatchers", "ordinal", F.size("dead").cast("long").alias("dead"))


@query(f"""WITH {STEPS}, c AS (SELECT shard, min(priority) AS band, count(*) AS depth FROM steps GROUP BY 1) SELECT shard FROM c ORDER BY band, depth DESC, shard LIMIT 1""")
def candidate_choice(spark, sf_dir):
    """The shard of the lowest band, then the deepest, then the lowest."""
    return sch.best_candidate(steps(spark, sf_dir).groupBy("shard").agg(F.min("priority").alias("band"), F.count(F.lit(1)).alias("depth")))


@query("""SELECT CASE WHEN json_extract(props, '$.k')::DOUBLE >= 50 AND json_extract(props, '$.k')::DOUBLE < 75 OR json_extract(props, '$.k')::DOUBLE = 3 THEN 'yes' ELSE 'no' END AS taken, count(*) AS n FROM events GROUP BY 1""")
def when_predicates(spark, sf_dir):
    """A condition over a JSON state, compiled to a column."""
    hit = compiled("k >= 50 && k < 75 || k == 3")(F.col("props"))
    return read(spark, sf_dir, "events").groupBy(F.when(hit, "yes").otherwise("no").alias("taken")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',"twice":' || 2 * CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS state FROM events""")
def subgraph_calls(spark, sf_dir):
    """Each flow calls a graph by name; only the named fields cross."""
    child = Graph("double").chain("twice", END)
    task = lambda s: F.create_map(F.lit("out"), (F.element_at(s, "n").cast("long") * 2).cast("string"), F.lit("own"), F.lit("1"))
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("flow_id"), F.col("props").alias("state"))
    out = Registry().graph(child).task("twice", task).call("double", rows, {"n": "k"}, {"twice": "out"})
    return out.select(F.col("flow_id").alias("event_id"), "state")


@query("""SELECT 'a' AS from_task, 'b' AS to_task, 'items' AS for_each, FALSE AS into_fan_in UNION ALL SELECT 'b', 'j', '', TRUE UNION ALL SELECT 'j', 'END', '', FALSE""")
def graph_tables(spark, sf_dir):
    """A graph's transitions as rows, with those into a fan-in marked."""
    nodes, edges, _ = Graph("g").edge("a", "b", for_each="items").chain("b", "j", END).fan_in("j").tables(spark)
    met = nodes.filter("fan_in").select(F.col("name").alias("to_task"), F.lit(True).alias("into"))
    return edges.join(met, "to_task", "left").select("from_task", "to_task", "for_each", F.coalesce("into", F.lit(False)).alias("into_fan_in"))


@query("""SELECT CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS outcome, count(*) AS n FROM orders WHERE o_totalprice < 100000 GROUP BY 1""")
def dead_end_steps(spark, sf_dir):
    """A step without an onward edge fails inside of a cohort and completes its flow outside."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step_id"), "o_totalprice", F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("lineage_id"))
    routed = rt.when_edges(o, [("big", F.col("o_totalprice") >= 100000)])
    return rt.dead_ends(o, routed).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k, replace(event_type || chr(0) || 'x', chr(0), '') AS clean, least(1.0, (event_id % 50 + 1) / (2.0 * least(120.0 * 2, 720.0 * 4 / (event_id % 3 + 1))))::DOUBLE AS every FROM events""")
def raw_fields(spark, sf_dir):
    """a field's JSON text, text that can be stored, the pace of selections."""
    n = F.pmod("event_id", F.lit(50)) + 1
    every = sc.refill_interval(n.cast("double"), F.lit(2.0), F.lit(4.0), (F.pmod("event_id", F.lit(3)) + 1).cast("double"))
    return read(spark, sf_dir, "events").select("event_id", st.raw(F.col("props"), "k").alias("k"), sc.storable(F.concat("event_type", F.lit("\x00x"))).alias("clean"), every.alias("every"))


# ---------------------------------------------------------------- fencing, signal guards, reports


@query("""SELECT event_id AS step_id, CASE WHEN event_type = 'error' THEN 'cancelled' WHEN user_id % 3 = event_id % 3 THEN 'completed' ELSE 'running' END AS status,
 CASE WHEN event_type <> 'error' AND user_id % 3 = event_id % 3 THEN 'c' || event_id END AS changes FROM events""")
def fenced_writes(spark, sf_dir):
    """Every event is written twice under a lease of its own, and once under an older one."""
    e = read(spark, sf_dir, "events")
    held = e.select(F.col("event_id").alias("step_id"), F.pmod("user_id", F.lit(3)).alias("lease_seq"), F.when(F.col("event_type") == "error", "cancelled").otherwise("running").alias("status"), F.lit(None).cast("string").alias("changes"))
    write = lambda mark, late, older: e.select(F.col("event_id").alias("step_id"), (F.pmod("event_id", F.lit(3)) - older).alias("lease_seq"), F.concat(F.lit(mark), F.col("event_id").cast("string")).alias("changes"), (F.col("event_id") + late).alias("written_at"))
    writes = write("c", 0, 0).unionByName(write("d", 1, 0)).unionByName(write("old", 0, 3))
    return lc.fenced(held, writes).select("step_id", "status", "changes")


@query("""SELECT event_id AS step_id, CASE WHEN (event_id % 2 = 0)::int + (event_id % 3 = 0)::int + (event_type = 'error')::int + (event_id % 7 = 0)::int > 1 THEN 'several signals at once in ' || event_type
 WHEN (event_id % 2 = 0 OR event_id % 7 = 0) AND user_id % 2 = 0 THEN 'a second park in ' || event_type END AS error FROM events""")
def signal_guards(spark, sf_dir):
    """X5."""
    every = lambda n: F.pmod("event_id", F.lit(n)) == 0
    error = lc.signal_error(F.col("event_type"), every(2), every(3), F.col("event_type") == "error", every(7), F.pmod("user_id", F.lit(2)) == 0)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("step_id"), error.alias("error"))


@query("""WITH r AS (SELECT user_id % 4 AS shard, event_id // 7 AS scan, event_type AS fairness_key, count(*) AS n FROM events GROUP BY ALL)
 SELECT shard, scan, fairness_key, n FROM r WHERE scan = (SELECT max(scan) FROM r x WHERE x.shard = r.shard) AND (scan + shard) % 3 <> 1""")
def shard_reports(spark, sf_dir):
    """The last scan of each shard; failed scans clear."""
    e = read(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(4)).alias("shard"), F.floor(F.col("event_id") / 7).alias("scan"), F.col("event_type").alias("fairness_key"))
    r = e.groupBy("shard", "scan", "fairness_key").agg(F.count(F.lit(1)).alias("n")).withColumn("ok", F.pmod(F.col("scan") + F.col("shard"), F.lit(3)) != 1)
    return sch.last_reports(r).select("shard", "scan", "fairness_key", "n")
