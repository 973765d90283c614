import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from braid.functions import scalars as sc
from braid.functions import state as st
from braid.operators import reducers as rd
from braid.operators import relational as rel
from braid.operators import routing as rt
from braid.operators import scheduling as sch
from braid.sources import tables

MEMBER = "g int, ord int, n double, tags array<string>, seen array<string>, ok boolean, w string, m map<string,string>, status string"


def members(spark):
    return spark.createDataFrame([
        (1, 2, 30.0, ["d"], ["z"], False, "c", {"k1": "9"}, "completed"), (1, 0, 10.0, ["b"], ["x"], True, "a", {"k1": "1"}, "completed"),
        (1, 1, 20.0, ["c"], ["y", "x"], True, "b", {"k2": "2"}, "completed"), (1, 3, None, None, None, None, None, None, "completed"), (1, 4, 99.0, ["no"], ["no"], False, "no", {"no": "no"}, "failed"),
    ], MEMBER)


FIELDS = {"total": ("add", "n"), "lo": ("min", "n"), "hi": ("max", "n"), "tags": ("append", "tags"), "seen": ("union", "seen"), "all_ok": ("and", "ok"), "any_ok": ("or", "ok"), "word": ("concat", "w"), "obj": ("merge", "m"), "last": ("replace", "w")}


def test_golden_folds(spark):
    r = rd.fold(members(spark).filter("status = 'completed' AND ord < 4"), ["g"], ["ord"], FIELDS).first().asDict()
    assert (r["total"], r["lo"], r["hi"], r["tags"], r["all_ok"], r["any_ok"], r["word"], r["obj"]) == (60, 10, 30, ["b", "c", "d"], False, True, "abc", {"k1": "9", "k2": "2"})
    assert list(dict.fromkeys(r["seen"])) == ["x", "y", "z"]


def test_fan_in_folds_onto_the_base_and_keeps_empty_cohorts(spark):
    schema = "g int, total double, tags array<string>, seen array<string>, obj map<string,string>, word string"
    spawns = spark.createDataFrame([(1, 5.0, ["seed"], ["q", "q", "x"], {"k1": "0", "k0": "0"}, "_"), (2, 7.0, ["only"], None, None, None), (3, None, None, None, None, None)], schema)
    some = {k: FIELDS[k] for k in ("total", "tags", "seen", "obj", "word")}
    out = {r["g"]: r.asDict() for r in rd.fan_in(spawns, members(spark), ["g"], ["ord"], some).collect()}
    assert out[1] == {"g": 1, "total": 65.0, "tags": ["seed", "b", "c", "d"], "seen": ["q", "q", "x", "y", "z"], "obj": {"k1": "9", "k2": "2", "k0": "0"}, "word": "_abc"}
    assert out[2]["total"] == 7.0 and out[2]["tags"] == ["only"] and out[3]["total"] is None
    with pytest.raises(ValueError):
        rd.reducer("median")


def test_state(spark):
    df = spark.createDataFrame([('{"a":1,"b":null,"c":"x","d":[1,2],"e":1.5,"f":"1"}',)], "s string")
    s = F.col("s")
    r = df.select(st.has(s, "a"), st.has(s, "b"), st.is_deleted(s, "b"), st.is_deleted(s, "z"), st.get(s, "a", "bigint"), st.get(s, "e", "bigint"), st.get(s, "c"), st.raw(s, "d"), st.typed(s, "z", "double"), F.size(st.names(s))).first()
    assert tuple(r) == (True, False, True, False, 1, None, "x", "[1,2]", 0.0, 6)
    with pytest.raises(Exception, match="is no bigint"):
        df.select(st.typed(s, "e", "bigint")).collect()
    m = df.select(st.entries(s).alias("m")).first()["m"]
    assert m["b"] == "null" and m["d"] == "[1,2]" and m["c"] == '"x"'
    text = df.select(st.encode(st.without_deleted(st.overlay(st.entries(s), F.create_map(F.lit("a"), F.lit("null"), F.lit("n"), F.lit("2")))))).first()[0]
    assert text == '{"c":"x","d":[1,2],"e":1.5,"f":"1","n":2}'
    kinds = spark.createDataFrame([("",), ("null",), ("[1]",), ("{}",), (None,)], "s string").select(st.parsed(F.col("s")).isNull()).collect()
    assert [r[0] for r in kinds] == [False, False, True, False, False]


def test_scalars(spark):
    one = spark.range(1)
    ms = [0, 999, 1500, 61_000, 3_660_000, 90_000_000]
    assert [one.select(sc.duration_text(F.lit(m))).first()[0] for m in ms] == ["0ms", "999ms", "1.5s", "1m1s", "1h1m", "1d1h"]
    assert sc.like_escape("50%_~") == "50~%~_~~" and sc.mermaid_escape('a"#') == "a#quot;#35;"
    r = one.select(sc.key_shard(F.lit("2--7-a-b")), sc.key_id(F.lit("2--7-a-b")), sc.key_token(F.lit("2--7-a-b")), sc.key_shard(F.lit("0-1-x")), sc.trace_id(F.lit("00-" + "a" * 32 + "-b-01")), sc.strip_port(F.lit("h:80")), sc.refill_interval(F.lit(60.0), F.lit(1.0), F.lit(2.0), F.lit(1.0)), sc.storable(F.lit("a\x00b"))).first()
    assert tuple(r) == (2, -7, "a-b", None, "a" * 32, "h", 0.25, "ab")


def test_routing(spark):
    df = spark.createDataFrame([(1, 80, [1, 2]), (2, None, []), (3, 50, None)], "id int, score int, items array<int>")
    got = rt.when_edges(df, [("high", F.col("score") >= 50), ("low", F.col("score") < 50), ("log", None)]).select("id", "target").collect()
    assert Counter(r["target"] for r in got) == {"high": 2, "log": 3}
    each = rt.for_each(df, F.col("items"), "x").collect()
    assert [(r["id"], r["x"], r["xIndex"], r["xCount"]) for r in each] == [(1, 1, 0, 2), (1, 2, 1, 2)]
    assert rt.strip(rt.for_each(df, F.col("items"), "x"), "x").columns == [*df.columns, "fan_out_ordinal"]
    ends = rt.dead_ends(spark.createDataFrame([(1, 0), (2, 7), (3, 7)], "step_id int, lineage_id int"), spark.createDataFrame([(3,)], "step_id int"))
    assert {(r["step_id"], r["outcome"]) for r in ends.collect()} == {(1, "completed"), (2, "failed")}


def test_cursor_covers_every_row_once(spark):
    f, s = tables.flows(spark, "/root/testdata/sf0.001").cache(), tables.steps(spark, "/root/testdata/sf0.001").cache()
    want = {(r["shard"], r["flow_id"]) for r in f.filter("delete_after_ms = 0 AND surgraph_flow_id = 0").collect()}
    seen, cursor = [], {}
    while True:
        text = ",".join(f"{a}={b}" for a, b in cursor.items())
        rows = rel.list_flows(f, s, rel.Query(limit=1200, cursor=text), tables.NOW, 4).collect()
        if not rows:
            break
        seen += [(r["shard"], r["flow_id"]) for r in rows]
        cursor |= rel.parse_cursor(rel.cursor_of(rows))
    assert len(seen) == len(set(seen)) and set(seen) == want
    for bad in ("x", "1=", "=2", "1=2;3"):
        with pytest.raises(ValueError):
            rel.parse_cursor(bad)
    with pytest.raises(ValueError):
        rel.predicate(rel.Query(status="odd"), tables.NOW)
    with pytest.raises(ValueError):
        rel.purgeable(f, s, rel.Query(), tables.NOW, 4)


def test_tables_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.create(spark, path)
    flows = spark.createDataFrame([(1, 5, 0, 0, 3), (2, 6, 4, 2, 3)], "shard int, flow_id long, thread_id long, root_flow_id long, priority int").withColumns({"fairness_key": F.lit("k"), "fairness_weight": F.lit(1.0), "created_at": F.lit(datetime(2024, 1, 1))})
    own, entry = tables.entry_rows(flows)
    tables.append(own, path, "flows")
    tables.append(entry, path, "steps")
    back = {r["flow_id"]: r for r in tables.open_table(spark, path, "flows").collect()}
    assert back[5]["thread_id"] == back[5]["root_flow_id"] == 5 and back[6]["thread_id"] == 4 and back[6]["root_flow_id"] == 2
    assert tables.open_table(spark, path, "steps").filter("status = 'pending'").count() == 2


def test_descendants_end_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (9, 10)], "p long, c long")
    got = rel.descendants(edges, spark.createDataFrame([(1,)], "id long"), "p", "c").collect()
    assert {(r["node"], r["depth"]) for r in got} == {(1, 0), (2, 1), (4, 1), (3, 2)}


def test_picks_follow_weights_not_backlogs():
    rng = random.Random(4)
    got = Counter(sch.pick([("a", 10**6, 3.0), ("b", 10**6, 1.0), ("c", 2, 1.0)], 4000, rng))
    assert got["c"] == 2 and 2.6 < got["a"] / got["b"] < 3.4
    assert sch.pick([("a", 2, 0.0)], 9, rng) == ["a", "a"]
    shards = [(1, 1.0, False), (2, 3.0, False), (3, 9.0, True)]
    assert [sch.placement(shards, d) for d in (0.0, 0.24, 0.26, 0.99)] == [1, 1, 2, 2]


def test_slices_and_placement(spark):
    t = spark.createDataFrame([(1, "a", 10, 5), (2, "a", 3, 1), (3, "a", 3, 2), (1, "b", 1, 1)], "shard int, fairness_key string, n long, oldest int")
    got = {(r["fairness_key"], r["shard"]): r["slots"] for r in sch.slice_plan(t, spark.createDataFrame([("a", 8), ("b", 8)], "fairness_key string, slots long")).collect()}
    assert got[("b", 1)] == 1 and sum(v for (k, _), v in got.items() if k == "a") == 8 and got[("a", 2)] >= 1 and got[("a", 1)] > got[("a", 3)]
    n = Counter(r["shard"] for r in sch.placed(spark.range(20000), F.col("id"), [(1, 1.0, False), (2, 3.0, False)]).collect())
    assert 0.2 < n[1] / 20000 < 0.3
    best = sch.best_candidate(spark.createDataFrame([(1, 2, 9), (2, 1, 3), (3, 1, 5), (4, 1, 5)], "shard int, band int, depth int"))
    assert best.first()["shard"] == 3


def test_milliseconds_are_those_of_sql(spark):
    import duckdb

    us = [0, 499, 500, 999, 1500, -1, -499, -500, -501, -1500, 1706654933999959, None]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(us)], "i int, us long").select("i", sc.epoch_millis(F.timestamp_micros("us")).alias("ms"))
    assert {r["i"]: r["ms"] for r in got.collect()} == {i: None if u is None else duckdb.execute("SELECT epoch_ms(make_timestamp(?::BIGINT))", [u]).fetchone()[0] for i, u in enumerate(us)}


def test_heartbeats_round_to_the_nearest_millisecond(spark, tmp_path):
    import duckdb

    from braid.plans import step_queries  # noqa: F401
    from braid.plans.queries import ORACLES, QUERIES

    rows = [(0, datetime(2024, 1, 30, 22, 48, 53, 999959), 318), (1, datetime(2024, 1, 2, 23, 59, 59, 999500), 1), (2, datetime(2024, 1, 2, 23, 59, 59, 999499), 2)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").withColumn("event_type", F.lit("view")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["heartbeats"](spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLES["heartbeats"]).fetchall())
