"""Headline queries over the projected tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.functions import scalars as sc
from braid.functions import state as st
from braid.operators import lifecycle as lc
from braid.operators import reducers as rd
from braid.operators import relational as rel
from braid.operators import routing as rt
from braid.operators import scheduling as sch
from braid.sources.tables import NOW, SHARDS, flows, read, steps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FLOWS = """flows AS (SELECT CAST(o_orderkey % 4 AS INT) AS shard, o_orderkey AS flow_id, 't' || o_orderkey AS flow_token,
 'https://host/' || lower(substr(o_orderpriority, 3, 20)) AS workflow_url, o_orderpriority AS workflow_name,
 CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey % 10 = 0 THEN 'failed' ELSE 'completed' END WHEN o_orderstatus = 'P' THEN 'interrupted'
  WHEN o_custkey % 2 = 0 THEN 'running' ELSE 'pending' END AS status,
 CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey END AS step_id,
 CASE WHEN o_orderkey % 3 = 0 AND o_orderkey > 1 THEN o_orderkey // 2 ELSE 0 END AS surgraph_flow_id, o_custkey AS thread_id,
 CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS delete_after_ms,
 CASE WHEN o_orderstatus = 'F' AND o_custkey % 10 = 0 THEN 'Error 50%_off at ' || o_orderkey END AS error,
 CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, 'k' || (o_custkey % 7) AS fairness_key, (o_custkey % 7) * 0.5::DOUBLE AS fairness_weight,
 o_orderdate AS created_at, o_orderdate + to_hours(CAST(o_custkey % 72 AS INT)) AS updated_at FROM orders)"""
STEPS = FLOWS + """, steps AS (SELECT shard, step_id, flow_id, 'task' || (flow_id % 6) AS task_name, status, priority, fairness_key, fairness_weight,
 CASE WHEN flow_id % 13 = 0 THEN 1 ELSE 0 END AS parked, updated_at AS not_before, created_at AS lease_expires, created_at, updated_at FROM flows WHERE step_id <> 0)"""
NOW_SQL = f"TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- cohort folds

_MEMBERS = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM events"


def _members(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.round("value", 4).alias("value"), (F.col("value") > 10).alias("big"), "props")


@query("""SELECT user_id, round(sum(value), 2) AS total, min(value) AS lo, max(value) AS hi, bool_and(value > 10) AS all_big, bool_or(value > 10) AS any_big,
 string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS word, last(event_type ORDER BY ts, event_id) AS last_type
 FROM (SELECT * REPLACE (round(value, 4) AS value) FROM events) GROUP BY user_id""".replace("value > 10", "value > 10"))
def cohort_fold(spark, sf_dir):
    """The branches of a cohort folded by reducer."""
    rows = _members(spark, sf_dir).withColumn("letter", F.substring("event_type", 1, 1)).withColumn("big", F.col("value") > 10)
    out = rd.fold(rows, ["user_id"], ["ts", "event_id"], {"total": ("add", "value"), "lo": ("min", "value"), "hi": ("max", "value"), "all_big": ("and", "big"), "any_big": ("or", "big"), "word": ("concat", "letter"), "last_type": ("replace", "event_type")})
    return out.withColumn("total", F.round("total", 2))


@query("""WITH u AS (SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY ALL)
 SELECT user_id, string_agg(event_type, ',' ORDER BY t) AS kinds FROM u GROUP BY user_id""")
def cohort_union(spark, sf_dir):
    """A3: union in order of first sight."""
    rows = _members(spark, sf_dir)
    spawns = rows.select("user_id").distinct().withColumn("kinds", F.lit(None).cast("array<string>"))
    out = rd.fan_in(spawns, rows.withColumn("status", F.lit("completed")), ["user_id"], ["ts", "event_id"], {"kinds": ("union", "event_type")})
    return out.select("user_id", F.array_join("kinds", ",").alias("kinds"))


@query("""SELECT user_id, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id""")
def cohort_append(spark, sf_dir):
    """Append in fold order."""
    out = rd.fold(_members(spark, sf_dir), ["user_id"], ["ts", "event_id"], {"ids": ("append", "event_id")})
    return out.select("user_id", F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("""SELECT user_id, event_type AS k, last(event_id ORDER BY ts, event_id) AS v FROM events GROUP BY ALL""")
def cohort_merge(spark, sf_dir):
    """Shallow map merge, the later entry of a key wins."""
    rows = _members(spark, sf_dir).withColumn("m", F.create_map("event_type", F.col("event_id").cast("string")))
    out = rd.fold(rows, ["user_id"], ["ts", "event_id"], {"m": ("merge", "m")})
    return out.select("user_id", F.explode("m").alias("k", "v")).withColumn("v", F.col("v").cast("long"))


@query("""SELECT o_orderkey, round(o_totalprice + coalesce(s, 0), 2) AS total, greatest(0, coalesce(q, 0)) AS most, coalesce(n, 0) AS members FROM orders LEFT JOIN
 (SELECT l_orderkey, sum(l_extendedprice) AS s, max(l_quantity) AS q, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def fan_in_with_base(spark, sf_dir):
    """Members that completed, folded onto what the spawn had; spawns without members stay."""
    spawns = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("total"), F.lit(0.0).alias("most"), F.lit(0.0).alias("members"))
    members = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_extendedprice", "l_quantity", F.lit(1).alias("one"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("status"))
    out = rd.fan_in(spawns, members, ["o_orderkey"], ["l_linenumber"], {"total": ("add", "l_extendedprice"), "most": ("max", "l_quantity"), "members": ("add", "one")})
    return out.select("o_orderkey", F.round("total", 2).alias("total"), "most", F.col("members").cast("long").alias("members"))


@query("""SELECT l_orderkey, count(*) AS arrivals, count(*) FILTER (WHERE l_returnflag = 'R') AS failures, count(*) FILTER (WHERE l_returnflag = 'R') = 0 AS succeeded FROM lineitem GROUP BY 1""")
def cohort_counters(spark, sf_dir):
    """Arrivals and failures of each cohort."""
    return rd.cohort_counters(read(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R")


# ---------------------------------------------------------------- routing


@query("""SELECT target, edge, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM (
 SELECT 'bulk' AS target, 0 AS edge, l_quantity FROM lineitem WHERE l_quantity >= 30 UNION ALL SELECT 'discount', 1, l_quantity FROM lineitem WHERE l_discount > 0.05
 UNION ALL SELECT 'audit', 2, l_quantity FROM lineitem) GROUP BY ALL""")
def when_routing(spark, sf_dir):
    """Independent predicates, several of which may hold."""
    rows = rt.when_edges(read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount"), [("bulk", F.col("l_quantity") >= 30), ("discount", F.col("l_discount") > 0.05), ("audit", None)])
    return rows.groupBy("target", "edge").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""SELECT CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid' WHEN o_totalprice >= 50000 THEN 'low' END AS target, count(*) AS n FROM orders GROUP BY 1""")
def switch_routing(spark, sf_dir):
    """The first match in order; none ends the flow (null)."""
    price = F.col("o_totalprice")
    rows = rt.switch_edge(read(spark, sf_dir, "orders").select("o_totalprice"), [("high", price >= 300000), ("mid", price >= 100000), ("low", price >= 50000)])
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type AS task_name, CASE WHEN event_type IN ('click', 'view') THEN 'retry' END AS target, CASE WHEN event_type NOT IN ('click', 'view') THEN 'no goto edge to retry' END AS error, count(*) AS n FROM events GROUP BY ALL""")
def goto_routing(spark, sf_dir):
    """An explicit request; a missing edge is an error."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("task_name"), F.lit("retry").alias("wanted"))
    edges = spark.createDataFrame([("click", "retry"), ("view", "retry")], "from_task string, to_task string")
    return rt.goto_edges(rows, "wanted", edges).groupBy("task_name", "target", "error").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents) SELECT doc_id, CAST(i - 1 AS INT) AS "wordIndex", CAST(len(ws) AS INT) AS "wordCount", ws[i] AS word
 FROM w, unnest(range(1, len(ws) + 1)) AS t(i)""")
def for_each_words(spark, sf_dir):
    """All branches of all documents."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("ws"))
    return rt.for_each(rows, F.col("ws"), "word").select("doc_id", "wordIndex", "wordCount", "word")


@query("""SELECT CASE WHEN event_type = 'error' THEN 'handler' ELSE 'next' END AS target, count(*) AS n, count(v) AS kept FROM (SELECT event_type, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) GROUP BY 1""")
def error_routing(spark, sf_dir):
    """A failed task's changes are void and its flow goes to the handler."""
    rows = read(spark, sf_dir, "events").select("event_type", "value")
    rows = rt.on_error(rows, F.when(F.col("event_type") == "error", F.lit("failed")), ["value"], "handler", "next")
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("kept"))


@query("""SELECT CASE WHEN value > 50 AND event_id % 4 < 2 THEN 'pending' WHEN value > 50 THEN 'failed' ELSE 'completed' END AS status,
 CASE WHEN value > 50 AND event_id % 4 < 2 THEN event_id % 4 + 1 ELSE event_id % 4 END AS attempt, count(*) AS n FROM events GROUP BY ALL""")
def retries(spark, sf_dir):
    """Rewind in place while attempts are left."""
    rows = read(spark, sf_dir, "events").select("value", F.pmod("event_id", F.lit(4)).alias("attempt"))
    return rt.retry(rows, F.when(F.col("value") > 50, F.lit("e")), 3).groupBy("status", "attempt").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- state and scalars


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS DOUBLE) AS d, json_extract_string(props, '$.k') AS s, TRUE AS has_k, FALSE AS has_z, 1 AS n FROM events""")
def state_fields(spark, sf_dir):
    """Typed readers of a JSON state."""
    p = F.col("props")
    return read(spark, sf_dir, "events").select("event_id", st.typed(p, "k", "bigint").alias("k"), st.get(p, "k", "double").alias("d"), st.get(p, "k").alias("s"), st.has(p, "k").alias("has_k"), st.has(p, "z").alias("has_z"), F.size(st.names(p)).alias("n"))


@query("""SELECT event_id, '{"a":' || (event_id % 3) || ',"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS state, event_id % 3 <> 1 AS differs FROM events""")
def state_overlay(spark, sf_dir):
    """A delta over a state, tombstones removed, and which fields changed."""
    rows = read(spark, sf_dir, "events")
    base = F.map_concat(st.entries(F.col("props")), F.create_map(F.lit("a"), F.lit("1"), F.lit("gone"), F.lit("2")))
    delta = F.create_map(F.lit("a"), F.pmod("event_id", F.lit(3)).cast("string"), F.lit("gone"), F.lit("null"))
    rows = rows.select("event_id", base.alias("b"), delta.alias("d"))
    new = st.without_deleted(st.overlay(F.col("b"), F.col("d")))
    return rows.select("event_id", st.encode(new).alias("state"), F.array_contains(F.map_keys(st.changed(F.col("b"), new)), "a").alias("differs"))


@query("""SELECT event_id, least(100 * power(2.0, event_id % 8), 3000.0) AS delay, 50 * (event_id % 8) + least(100 * power(2.0, event_id % 8), 3000.0) >= 2000 AS gives_up,
 greatest(event_id % 5 - 2, 0) AS sleep, 745 * (CASE WHEN event_id % 8 <= 2 THEN 1 ELSE 0 END) + (CASE WHEN event_id % 8 > 2 THEN 450 * (event_id % 8) ELSE 0 END) AS capacity,
 greatest(64, 1024 // (event_id % 8 + 1)) AS candidate, CASE WHEN event_id % 8 > 0 THEN greatest(64, least(4096, 23552 // (event_id % 8 + 1))) // 5 ELSE 4096 END AS open,
 event_id % 10 < 3 AS burst FROM events""")
def scalar_formulas(spark, sf_dir):
    """F20-F22, F31-F34, F36."""
    n = F.pmod("event_id", F.lit(8))
    delay = sc.backoff(F.lit(100), F.lit(2.0), n, F.lit(3000))
    return read(spark, sf_dir, "events").select(
        "event_id", delay.alias("delay"), sc.gives_up(50 * n, delay, F.lit(2000)).alias("gives_up"), sc.sleep_clamp(F.pmod("event_id", F.lit(5)) - 2).alias("sleep"),
        sc.capacity_weight(n).cast("long").alias("capacity"), sc.candidate_floor(n + 1).cast("long").alias("candidate"), sc.open_threshold(n + 1).cast("long").alias("open"), sc.in_burst(F.col("event_id"), 3, 7).alias("burst"))


@query("""SELECT page_id, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare, split_part(split_part(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '/', 1), '?', 1) AS host FROM pages""")
def url_helpers(spark, sf_dir):
    """F26."""
    return read(spark, sf_dir, "pages").select("page_id", sc.strip_protocol(F.col("url")).alias("bare"), sc.host_of(F.col("url")).alias("host"))


@query(f"""WITH {FLOWS} SELECT (shard + 1) || '-' || flow_id || '-' || flow_token AS key, shard + 1 AS shard, flow_id, flow_token AS token, (shard + 1) || '-' || flow_id AS correlation,
 epoch_ms(updated_at) - epoch_ms(created_at) AS age_ms, status IN ('completed', 'failed', 'cancelled') AS terminal, status NOT IN ('created', 'pending') AS started FROM flows""")
def key_codec(spark, sf_dir):
    """Keys made and parsed, ages, status sets."""
    f = flows(spark, sf_dir).withColumn("shard", F.col("shard") + 1)  # keys number shards from 1
    f = f.withColumn("key", sc.flow_key(F.col("shard"), F.col("flow_id"), F.col("flow_token")))
    k, s = F.col("key"), F.col("status")
    return f.select("key", sc.key_shard(k).alias("shard"), sc.key_id(k).alias("flow_id"), sc.key_token(k).alias("token"), sc.correlation_id(F.col("shard"), F.col("flow_id")).alias("correlation"), sc.diff_millis(F.col("updated_at"), F.col("created_at")).alias("age_ms"), sc.is_terminal(s).alias("terminal"), sc.has_started(s).alias("started"))


@query("""WITH d AS (SELECT event_id, event_id * event_id * 7 AS ms FROM events) SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN CAST(((ms + 5) // 10) / 100.0::DOUBLE AS VARCHAR) || 's'
 WHEN ms < 3600000 THEN (ms // 60000) || 'm' || (ms // 1000 % 60) || 's' WHEN ms < 86400000 THEN (ms // 3600000) || 'h' || (ms // 60000 % 60) || 'm' ELSE (ms // 86400000) || 'd' || (ms // 3600000 % 24) || 'h' END AS text FROM d""")
def durations(spark, sf_dir):
    """F25."""
    return read(spark, sf_dir, "events").select("event_id", sc.duration_text(F.col("event_id") * F.col("event_id") * 7).alias("text"))


# ---------------------------------------------------------------- listing

_LISTED = f"WITH {STEPS}, j AS (SELECT f.*, s.task_name FROM flows f LEFT JOIN steps s ON f.shard = s.shard AND f.step_id = s.step_id)"
_COLS = ["shard", "flow_id", "workflow_name", "status", "task_name", "priority"]


def _listing(spark, sf_dir, q):
    return rel.list_flows(flows(spark, sf_dir).withColumn("flow_token", F.col("flow_token")), steps(spark, sf_dir), q, NOW, SHARDS).select(*_COLS)


def _list_sql(where: str, limit: int) -> str:
    return f"{_LISTED}, r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY flow_id DESC) AS pos FROM j WHERE delete_after_ms = 0 AND {where}) SELECT {', '.join(_COLS)} FROM r WHERE pos <= {limit} ORDER BY shard, flow_id DESC"


@query(_list_sql("surgraph_flow_id = 0 AND status = 'completed' AND priority = 2", 25))
def list_flows(spark, sf_dir):
    """P1-P3, P6, P8, P9, P11, J1, L1, L2, L4, S1, U1."""
    return _listing(spark, sf_dir, rel.Query(status="completed", priority=2))


@query(_list_sql("surgraph_flow_id = 0 AND task_name = 'task2' AND fairness_key = 'k3'", 10))
def list_by_task(spark, sf_dir):
    """Flows with several live branches have no current task and never match."""
    return _listing(spark, sf_dir, rel.Query(task_name="task2", fairness_key="k3", limit=40))


@query(_list_sql(f"epoch_ms({NOW_SQL}) - epoch_ms(updated_at) > 86400000::BIGINT * 400 AND epoch_ms({NOW_SQL}) - epoch_ms(updated_at) <= 86400000::BIGINT * 700", 25))
def list_by_age(spark, sf_dir):
    """Both age filters, subgraphs included."""
    return _listing(spark, sf_dir, rel.Query(older_than_ms=86400000 * 400, newer_than_ms=86400000 * 700, include_subgraphs=True))


@query(_list_sql("surgraph_flow_id = 0 AND (contains(lower(coalesce(error, '')), '50%_off at 1') OR contains(lower(workflow_url), '50%_off at 1'))", 25))
def list_search(spark, sf_dir):
    """A literal, whatever wildcards it holds."""
    return _listing(spark, sf_dir, rel.Query(search="50%_OFF at 1"))


@query(_list_sql("surgraph_flow_id = 0 AND (shard <> 1 OR flow_id < 3001) AND (shard <> 2 OR flow_id < 2002)", 25))
def list_next_page(spark, sf_dir):
    """L3: keyset paging, a cursor for each shard."""
    return _listing(spark, sf_dir, rel.Query(cursor="1=3001,2=2002"))


@query("""SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), lower('ER#00000001'))""")
def text_search(spark, sf_dir):
    return read(spark, sf_dir, "customer").filter(sc.contains_literal(F.col("c_name"), "ER#00000001")).select("c_custkey", "c_name")


@query(f"{_LISTED}, r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY flow_id) AS pos FROM j WHERE delete_after_ms = 0 AND surgraph_flow_id = 0 AND priority = 3 AND status NOT IN ('running', 'pending')) SELECT shard, flow_id, CASE WHEN status = 'interrupted' THEN 'cancelled' ELSE status END AS status, 1 AS delete_after_ms FROM r WHERE pos <= 50")
def purge(spark, sf_dir):
    """G35, L8, A26."""
    return rel.purgeable(flows(spark, sf_dir), steps(spark, sf_dir), rel.Query(priority=3), NOW, SHARDS, cap=200).select("shard", "flow_id", "status", "delete_after_ms")


@query(f"WITH {FLOWS} SELECT shard, flow_id FROM flows WHERE delete_after_ms > 0 AND surgraph_flow_id = 0 AND updated_at + to_milliseconds(delete_after_ms) <= {NOW_SQL} ORDER BY flow_id LIMIT 4096")
def reap(spark, sf_dir):
    """S17, L9."""
    return rel.reapable(flows(spark, sf_dir), NOW).select("shard", "flow_id")


# ---------------------------------------------------------------- latest, fingerprints, detectors


@query("""SELECT conv_id, turn, role, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1""")
def latest_turn(spark, sf_dir):
    """The latest turn of each thread."""
    return rel.latest(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query(f"""WITH {FLOWS} SELECT shard, thread_id, flow_id FROM (SELECT *, row_number() OVER (PARTITION BY shard, thread_id ORDER BY updated_at, flow_id) AS rn FROM flows WHERE status = 'interrupted') WHERE rn = 1""")
def earliest_interrupted(spark, sf_dir):
    """The leaf that a resume takes."""
    return rel.earliest(flows(spark, sf_dir).filter("status = 'interrupted'"), ["shard", "thread_id"], ["updated_at", "flow_id"]).select("shard", "thread_id", "flow_id")


@query(f"""WITH {STEPS} SELECT fairness_key, sha256(max(status) || '|' || count(*) || '|' || epoch_ms(max(updated_at))) AS fingerprint FROM steps GROUP BY 1""")
def fingerprints(spark, sf_dir):
    """A24."""
    return rel.fingerprint(steps(spark, sf_dir), ["fairness_key"])


@query(f"""WITH {STEPS}, s AS (SELECT shard, count(*) AS steps FROM steps GROUP BY 1), f AS (SELECT shard, count(*) AS flows FROM flows GROUP BY 1) SELECT f.shard, flows, coalesce(steps, 0) AS steps FROM f LEFT JOIN s ON f.shard = s.shard""")
def shard_info(spark, sf_dir):
    """A25, S1."""
    f = flows(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("flows"))
    return f.join(steps(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("steps")), "shard", "left").fillna(0, ["steps"])


@query(f"""WITH {FLOWS} SELECT c.flow_id FROM flows c WHERE c.status NOT IN ('completed', 'failed', 'cancelled') AND c.surgraph_flow_id <> 0 AND epoch_ms({NOW_SQL}) - epoch_ms(c.updated_at) >= 300000
 AND EXISTS (SELECT 1 FROM flows p WHERE p.flow_id = c.surgraph_flow_id AND p.status IN ('completed', 'failed', 'cancelled'))""")
def orphaned_flows(spark, sf_dir):
    """J3, D11 (here over all shards: the projection's parents are on other shards)."""
    f = flows(spark, sf_dir).withColumn("shard", F.lit(1))
    return rel.orphans(f, 300_000, NOW).select("flow_id")


@query(f"""WITH {STEPS} SELECT shard, flow_id FROM flows f WHERE status = 'running' AND NOT EXISTS (SELECT 1 FROM steps s WHERE s.shard = f.shard AND s.flow_id = f.flow_id AND s.status NOT IN ('completed', 'failed', 'cancelled'))""")
def stalled_flows(spark, sf_dir):
    """J5, D11."""
    return rel.stalled(flows(spark, sf_dir), steps(spark, sf_dir)).select("shard", "flow_id")


@query(f"""WITH {STEPS} SELECT shard, step_id FROM steps s WHERE parked = 1 AND NOT EXISTS (SELECT 1 FROM flows f WHERE f.shard = s.shard AND f.surgraph_flow_id = s.step_id AND f.surgraph_flow_id <> 0 AND f.status NOT IN ('completed', 'failed', 'cancelled'))""")
def parked_without_child(spark, sf_dir):
    """J4."""
    return rel.parked_without_child(steps(spark, sf_dir), flows(spark, sf_dir).withColumn("surgraph_step_id", F.col("surgraph_flow_id"))).select("shard", "step_id")


@query(f"""WITH {STEPS} SELECT CASE WHEN status = 'running' AND parked = 0 AND lease_expires <= {NOW_SQL} THEN 'pending' ELSE status END AS status, count(*) AS n FROM steps GROUP BY 1""")
def lease_recovery(spark, sf_dir):
    """D10, T2, P17."""
    return rel.recovered_leases(steps(spark, sf_dir), NOW).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {STEPS} SELECT 'terminal flow with live step' AS "check", 0 AS violations UNION ALL SELECT 'parked terminal step', (SELECT count(*) FROM steps WHERE parked = 1 AND status IN ('completed', 'failed', 'cancelled'))
 UNION ALL SELECT 'running flow without live step', (SELECT count(*) FROM flows f WHERE status = 'running' AND NOT EXISTS (SELECT 1 FROM steps s WHERE s.shard = f.shard AND s.flow_id = f.flow_id AND s.status NOT IN ('completed', 'failed', 'cancelled')))
 UNION ALL SELECT 'counter overshoot', (SELECT count(*) FROM steps WHERE flow_id % 17 = 0) UNION ALL SELECT 'dangling link', (SELECT count(*) FROM steps s WHERE (flow_id + 4) % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM steps t WHERE t.step_id = s.step_id + 4 AND t.shard = s.shard))
 UNION ALL SELECT 'cross-flow edge', (SELECT count(*) FROM steps s WHERE (flow_id + 4) % 5 <> 0 AND EXISTS (SELECT 1 FROM steps t WHERE t.step_id = s.step_id + 4 AND t.shard = s.shard)) UNION ALL SELECT 'bad root', 0""")
def invariants(spark, sf_dir):
    """Rules of the stored rows (links of the projection lead four ids on)."""
    f = flows(spark, sf_dir).withColumn("root_flow_id", F.col("flow_id"))
    s = steps(spark, sf_dir).withColumns({"cohort_size": F.lit(2), "cohort_arrivals": F.when(F.pmod("flow_id", F.lit(17)) == 0, 3).otherwise(2), "successor_id": F.when(F.pmod(F.col("flow_id") + 4, F.lit(5)) != 0, F.col("step_id") + 4).otherwise(0)})
    return rel.invariants(f, s)


# ---------------------------------------------------------------- trees


@query("""WITH RECURSIVE t AS (SELECT o_orderkey AS root, o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderkey IN (1, 5, 9) UNION
 SELECT root, o_orderkey, depth + 1 FROM t JOIN orders ON o_orderkey // 2 = node AND o_orderkey > 1) SELECT root, node, depth FROM t""")
def subtree(spark, sf_dir):
    """All descendants, level by level."""
    edges = read(spark, sf_dir, "orders").filter("o_orderkey > 1").select(F.floor(F.col("o_orderkey") / 2).alias("parent"), F.col("o_orderkey").alias("child"))
    roots = read(spark, sf_dir, "orders").filter(F.col("o_orderkey").isin(1, 5, 9)).select("o_orderkey")
    return rel.descendants(edges, roots, "parent", "child")


@query("""WITH RECURSIVE t AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey = 3 UNION SELECT o_orderkey FROM t JOIN orders ON o_orderkey // 2 = node AND o_orderkey > 1)
 SELECT o_orderkey AS kept FROM orders WHERE o_orderkey NOT IN (SELECT node FROM t)""")
def fork_kept_steps(spark, sf_dir):
    """What a fork keeps, all but the subtree of the chosen step."""
    orders = read(spark, sf_dir, "orders")
    edges = orders.filter("o_orderkey > 1").select(F.floor(F.col("o_orderkey") / 2).alias("parent"), F.col("o_orderkey").alias("child"))
    gone = rel.descendants(edges, orders.filter("o_orderkey = 3").select("o_orderkey"), "parent", "child")
    return orders.select(F.col("o_orderkey").alias("kept")).join(gone.select(F.col("node").alias("kept")), "kept", "left_anti")


# ---------------------------------------------------------------- scheduling

_DUE = f"status = 'pending' AND parked = 0 AND not_before <= {NOW_SQL} AND lease_expires <= {NOW_SQL}"


def _due(spark, sf_dir):
    return steps(spark, sf_dir).filter(sch.due(NOW))


@query(f"""WITH {STEPS}, d AS (SELECT * FROM steps WHERE {_DUE}), b AS (SELECT *, row_number() OVER (PARTITION BY fairness_key ORDER BY created_at, step_id) AS rn FROM d WHERE priority = (SELECT min(priority) FROM d))
 SELECT fairness_key, priority, least(count(*), 10) AS n, max(CASE WHEN rn = 1 THEN created_at END) AS oldest, max(CASE WHEN rn = 1 THEN CASE WHEN fairness_weight <= 0 THEN 1.0 ELSE fairness_weight END END) AS weight FROM b GROUP BY ALL""")
def band_scan(spark, sf_dir):
    """The tally of the minimum band."""
    return sch.scan_band(_due(spark, sf_dir), 10).withColumn("oldest", F.col("oldest").cast("timestamp_ntz"))


@query(f"""WITH {STEPS}, d AS (SELECT * FROM steps WHERE {_DUE}), b AS (SELECT *, row_number() OVER (PARTITION BY fairness_key ORDER BY created_at, step_id) AS rn FROM d WHERE priority = (SELECT min(priority) FROM d) AND fairness_key IN ('k1', 'k2', 'k3'))
 SELECT fairness_key, step_id, rn FROM b WHERE rn <= 5""")
def fetch_steps(spark, sf_dir):
    """D2, W2."""
    due = _due(spark, sf_dir)
    wanted = sch.scan_band(due, 10).filter(F.col("fairness_key").isin("k1", "k2", "k3"))
    return sch.fetch_steps(due, wanted, 5).select("fairness_key", "step_id", F.col("rn").cast("long").alias("rn"))


_TALLY = f"""{STEPS}, d AS (SELECT * FROM steps WHERE {_DUE}), t AS (SELECT shard, fairness_key, priority, count(*) AS n, min(created_at) AS oldest, min_by(CASE WHEN fairness_weight <= 0 THEN 1.0 ELSE fairness_weight END, (created_at, step_id)) AS weight
 FROM d WHERE priority = (SELECT min(priority) FROM d x WHERE x.shard = d.shard) GROUP BY ALL)"""


def _tallies(spark, sf_dir):
    rows = sch.minimum_band(_due(spark, sf_dir), ["shard"])
    first = F.min(F.struct("created_at", "step_id", sc.weight_or_one(F.col("fairness_weight")).alias("w")))
    return rows.groupBy("shard", "fairness_key", "priority").agg(F.count(F.lit(1)).alias("n"), first.alias("f")).select("shard", "fairness_key", "priority", "n", F.col("f.created_at").alias("oldest"), F.col("f.w").alias("weight"))


@query(f"""WITH {_TALLY}, g AS (SELECT * FROM t WHERE priority = (SELECT min(priority) FROM t)) SELECT fairness_key, priority, CAST(sum(n) AS BIGINT) AS n, min(oldest) AS oldest, min_by(weight, (oldest, shard)) AS weight FROM g GROUP BY ALL""")
def tally_merge(spark, sf_dir):
    """D3, D6, A22."""
    return sch.merge_tallies(_tallies(spark, sf_dir)).withColumn("oldest", F.col("oldest").cast("timestamp_ntz"))


@query(f"""WITH {_TALLY}, g AS (SELECT shard, fairness_key, n, oldest, least(7, sum(n) OVER (PARTITION BY fairness_key)) AS slots, row_number() OVER (PARTITION BY fairness_key ORDER BY oldest, shard) = 1 AS head FROM t WHERE priority = (SELECT min(priority) FROM t)),
 h AS (SELECT *, n - head::INT AS rest, slots - 1 AS rem, sum(n - head::INT) OVER (PARTITION BY fairness_key) AS total FROM g),
 i AS (SELECT *, CASE WHEN total > 0 THEN rem * rest // total ELSE 0 END AS base, CASE WHEN total > 0 THEN rem * rest % total ELSE 0 END AS part FROM h),
 k AS (SELECT *, rem - sum(base) OVER (PARTITION BY fairness_key) AS extra, row_number() OVER (PARTITION BY fairness_key ORDER BY part DESC, shard) AS rk FROM i)
 SELECT fairness_key, shard, CAST(base + head::INT + (CASE WHEN rk <= extra AND total > 0 THEN 1 ELSE 0 END) AS BIGINT) AS slots FROM k""")
def shard_slices(spark, sf_dir):
    """Slots of a key over its shards by largest remainder."""
    t = sch.minimum_band(_tallies(spark, sf_dir))
    slots = t.select("fairness_key").distinct().withColumn("slots", F.lit(7).cast("long"))
    return sch.slice_plan(t, slots)


@query(f"""WITH {STEPS}, d AS (SELECT * FROM steps WHERE {_DUE}), b AS (SELECT *, row_number() OVER (PARTITION BY fairness_key ORDER BY created_at, step_id) AS rn FROM d WHERE priority = (SELECT min(priority) FROM d)),
 p AS (SELECT i AS slot, 'k' || (i % 3) AS fairness_key, row_number() OVER (PARTITION BY i % 3 ORDER BY i) AS rn FROM range(12) r(i)) SELECT slot, p.fairness_key, step_id FROM p JOIN b ON p.fairness_key = b.fairness_key AND p.rn = b.rn""")
def assembled_slots(spark, sf_dir):
    """The n-th slot of a key gets its n-th step."""
    due = _due(spark, sf_dir)
    slots = spark.range(12).select(F.col("id").alias("slot"), F.concat(F.lit("k"), F.pmod("id", F.lit(3)).cast("string")).alias("fairness_key"))
    return sch.assemble(slots, sch.fetch_steps(due, sch.scan_band(due, 99), 99)).select("slot", "fairness_key", "step_id")


@query(f"""WITH {STEPS} SELECT priority, count(*) AS pending, CAST(floor((epoch_ms({NOW_SQL}) - epoch_ms(min(created_at))) / 1000) AS BIGINT) AS age_s FROM steps WHERE {_DUE} GROUP BY 1""")
def pending_gauge(spark, sf_dir):
    """A23, S15."""
    return rel.pending_by_band(_due(spark, sf_dir), NOW)


@query("""SELECT event_id FROM events WHERE event_id % 4 = 1 OR (event_id % 4 = 2 AND event_id % 100 >= 40) OR event_id % 100 >= 80""")
def stealing(spark, sf_dir):
    """Own class, the next one's after a grace, any after two."""
    return read(spark, sf_dir, "events").filter(sch.claimable(F.col("event_id"), F.pmod("event_id", F.lit(100)), 1, 4, 40)).select("event_id")


@query(f"""WITH e AS (SELECT user_id AS engine_id, max(ts) AS seen FROM events GROUP BY 1), m AS (SELECT max(ts) AS t FROM events), c AS (SELECT engine_id, epoch_ms(TIMESTAMP '2024-01-05 00:00:00') - epoch_ms(seen) <= 86400000 AS fresh FROM e)
 SELECT engine_id, fresh, CASE WHEN fresh THEN CAST(row_number() OVER (PARTITION BY fresh ORDER BY engine_id) - 1 AS INT) END AS ordinal FROM c""")
def peer_classes(spark, sf_dir):
    """Fresh replicas and their ordinals."""
    from datetime import datetime

    beats = read(spark, sf_dir, "events").select(F.col("user_id").alias("engine_id"), F.col("ts").alias("seen_at"))
    return rel.classify_peers(beats, datetime(2024, 1, 5), 86_400_000).select("engine_id", "fresh", "ordinal")


@query("""SELECT event_type, list_sort(list(value))[CAST(floor(0.95 * (count(*) - 1)) AS INT) + 1] AS value FROM events GROUP BY 1""")
def percentiles(spark, sf_dir):
    """The element at floor(p * (n - 1))."""
    return rel.floor_percentile(read(spark, sf_dir, "events"), ["event_type"], "value", 0.95)


@query("""WITH b AS (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bucket, count(*) FILTER (WHERE event_id % 2 = 0) AS n0, count(*) AS n1 FROM events GROUP BY ALL) SELECT event_type, bucket, n1 - n0 AS n FROM b WHERE n1 <> n0""")
def histogram_deltas(spark, sf_dir):
    """A31, A32."""
    rows = read(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") / 10).alias("bucket"), "event_id")
    count = lambda df: df.groupBy("event_type", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return rel.deltas(count(rows.filter(F.pmod("event_id", F.lit(2)) == 0)), count(rows), ["event_type", "bucket"], "n")


@query("""SELECT coalesce(nullif(event_type, 'view'), 'CPU') AS wait, count(*) AS n FROM events GROUP BY 1""")
def wait_profile(spark, sf_dir):
    """A33."""
    return read(spark, sf_dir, "events").groupBy(F.coalesce(F.nullif(F.col("event_type"), F.lit("view")), F.lit("CPU")).alias("wait")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, string_agg(substr(role, 1, 1), '' ORDER BY turn) AS roles, CAST(sum(length(text)) AS DOUBLE) AS chars, last(text ORDER BY turn) AS final FROM conversations GROUP BY 1""")
def thread_fold(spark, sf_dir):
    """The turns of a thread folded one after another."""
    rows = read(spark, sf_dir, "conversations").withColumn("r", F.substring("role", 1, 1)).withColumn("n", F.length("text"))
    return rd.fold(rows, ["conv_id"], ["turn"], {"roles": ("concat", "r"), "chars": ("add", "n"), "final": ("replace", "text")})



# ---------------------------------------------------------------- lifecycle and metrics


@query(f"""WITH {STEPS}, c AS (SELECT step_id, {_DUE} AS due, step_id % 3 AS attempt, created_at, lease_expires FROM steps) SELECT step_id, due, CASE WHEN due THEN {NOW_SQL} + to_milliseconds(31000) ELSE lease_expires END AS lease,
 CASE WHEN due AND attempt = 0 THEN {NOW_SQL} ELSE created_at END AS started FROM c""")
def claims(spark, sf_dir):
    """Due steps become running under a lease."""
    rows = steps(spark, sf_dir).withColumns({"time_budget_ms": F.lit(1000), "attempt": F.pmod("step_id", F.lit(3)), "started_at": F.col("created_at")})
    due = sch.due(NOW)
    out = lc.claimed(rows.withColumn("due", due), due, NOW)
    return out.select("step_id", "due", F.col("lease_expires").cast("timestamp_ntz").alias("lease"), F.col("started_at").cast("timestamp_ntz").alias("started"))


@query(f"""WITH {FLOWS} SELECT CASE WHEN flow_id % 6 = 0 AND status NOT IN ('completed', 'failed', 'cancelled') THEN 'cancelled' ELSE status END AS status,
 CASE WHEN flow_id % 6 = 0 AND status NOT IN ('completed', 'failed', 'cancelled') THEN 'stop' END AS cancel_reason, count(*) AS n FROM flows GROUP BY ALL""")
def cancel(spark, sf_dir):
    """The live flows of a subtree, in one projection."""
    f = flows(spark, sf_dir)
    return lc.cancelled(f, f.filter(F.pmod("flow_id", F.lit(6)) == 0), "stop").groupBy("status", "cancel_reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FLOWS} SELECT flow_id, CASE WHEN status = 'running' THEN CASE WHEN flow_id % 2 = 0 THEN 'completed' ELSE 'failed' END ELSE status END AS status,
 CASE WHEN status = 'running' AND flow_id % 2 = 0 THEN 'r' || flow_id END AS final_state FROM flows""")
def deliveries(spark, sf_dir):
    """Results end live flows once."""
    f = flows(spark, sf_dir).withColumn("final_state", F.lit(None).cast("string"))
    done = f.filter("status IN ('running', 'completed', 'failed')").select("shard", "flow_id", F.when(F.pmod("flow_id", F.lit(2)) == 0, "completed").otherwise("failed").alias("outcome"), F.concat(F.lit("r"), F.col("flow_id").cast("string")).alias("result"))
    return lc.ended(f, done).select("flow_id", "status", "final_state")


@query(f"""WITH {FLOWS} SELECT shard, flow_id FROM flows WHERE status IN ('completed', 'failed', 'cancelled', 'interrupted') AND (epoch_ms({NOW_SQL}) - epoch_ms(updated_at) <= 86400000::BIGINT * 60 OR flow_id % 1000 = 7)""")
def awaited_flows(spark, sf_dir):
    """P18, T5, X14."""
    f = flows(spark, sf_dir)
    return lc.awaited(f, f.filter(F.pmod("flow_id", F.lit(1000)) == 7), NOW, 86400000 * 60).select("shard", "flow_id")


@query("""SELECT a.event_id AS step_id, 'big' || (a.event_id - a.event_id % 10) AS v FROM events a""")
def referenced_fields(spark, sf_dir):
    """Fields stored by reference, put back from their anchor."""
    e = read(spark, sf_dir, "events").select("event_id")
    anchor = F.col("event_id") - F.pmod("event_id", F.lit(10))
    own = F.create_map(F.lit("v"), F.concat(F.lit("big"), F.col("event_id").cast("string")))
    none = F.map_filter(own, lambda k, v: F.lit(False))
    first = F.pmod("event_id", F.lit(10)) == 0
    rows = e.select(F.col("event_id").alias("step_id"), F.when(first, own).otherwise(none).alias("state"), none.alias("changes"), F.when(first, F.map_filter(F.create_map(F.lit("v"), anchor), lambda k, v: F.lit(False))).otherwise(F.create_map(F.lit("v"), anchor)).alias("refs"))
    return lc.resolved(rows.drop("changes"), rows.filter(F.size("refs") == 0)).select("step_id", F.element_at("state", "v").alias("v"))


@query("""SELECT user_id AS step_id, event_id AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error' DESC, floor(value) DESC, event_id) AS rn FROM events) WHERE rn <= 4 OR event_type = 'error'""")
def anchor_choice(spark, sf_dir):
    """Pinned anchors and the largest others."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("step_id"), F.col("event_id").alias("anchor"), F.floor("value").alias("bytes"), (F.col("event_type") == "error").alias("pinned"))
    return lc.anchored(rows).select("step_id", "anchor")


@query(f"""WITH {FLOWS} SELECT workflow_name, status, shard, count(*) AS value FROM flows WHERE status IN ('completed', 'failed', 'cancelled') GROUP BY ALL""")
def flows_terminated(spark, sf_dir):
    """A counter by its attributes."""
    return lc.counters(flows(spark, sf_dir).filter(sc.is_terminal(F.col("status"))), ["workflow_name", "status", "shard"])


@query("""SELECT event_type, (value > 5)::INT + (value > 10)::INT + (value > 25)::INT + (value > 50)::INT AS bucket, count(*) AS n FROM events GROUP BY ALL""")
def wait_histogram(spark, sf_dir):
    """Fixed boundaries."""
    return lc.histogram(read(spark, sf_dir, "events"), "value", [5.0, 10.0, 25.0, 50.0], ["event_type"])


@query("""SELECT role AS task, 'text' AS "column", sum(strlen(text))::BIGINT AS bytes FROM conversations GROUP BY 1""")
def state_write_bytes(spark, sf_dir):
    """Bytes written by column."""
    return lc.state_bytes(read(spark, sf_dir, "conversations").withColumnRenamed("role", "task"), ["text"], ["task"])


@query(f"""WITH {STEPS} SELECT fairness_key, priority, CASE WHEN bool_and(status IN ('completed', 'failed', 'cancelled')) THEN epoch_ms(max(updated_at)) - epoch_ms(min(created_at)) END AS wall_ms FROM steps WHERE status <> 'running' OR priority > 2 GROUP BY ALL""")
def wall_times(spark, sf_dir):
    """Only over groups that have ended."""
    return lc.wall_time(steps(spark, sf_dir).filter("status <> 'running' OR priority > 2"), ["fairness_key", "priority"])


@query("""SELECT conv_id AS flow_id, 'flowchart TD' || chr(10) || string_agg('  s' || turn || '["' || role || ' completed"]' || CASE WHEN turn % 2 = 0 THEN chr(10) || '  s' || turn || ' --> s' || (turn + 1) ELSE '' END, chr(10) ORDER BY turn) AS diagram FROM conversations GROUP BY 1""")
def history_diagrams(spark, sf_dir):
    """A diagram of each history."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("flow_id"), F.col("turn").alias("step_id"), F.col("role").alias("task_name"), F.lit("completed").alias("status"), F.when(F.pmod("turn", F.lit(2)) == 0, F.col("turn") + 1).otherwise(0).alias("successor_id"))
    return lc.history_mermaid(rows)
