import time
from datetime import datetime, timedelta, timezone

from braid.streaming import cohorts

SCHEMA = "lineage_id long, cohort_size int, fan_out_ordinal int, status string, value double"


def stream(spark, path, batches, transform, name, mode):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in/b{i}")
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    q = transform(df).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{path}/ck").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_barrier(spark, tmp_path):
    batches = [[(1, 3, 0, "completed", 1.0), (2, 2, 0, "failed", 5.0)], [(1, 3, 2, "completed", 4.0), (3, 2, 0, "completed", 9.0)], [(2, 2, 1, "completed", 2.0), (1, 3, 1, "completed", 2.0)]]
    got = {r["lineage_id"]: r for r in stream(spark, f"file://{tmp_path}", batches, cohorts.barrier, "resolved", "append").collect()}
    assert set(got) == {1, 2}  # 3 still waits
    assert (got[1]["resolved"], got[1]["total"], got[1]["arrivals"], got[1]["last_ordinal"]) == ("completed", 7.0, 3, 2)
    assert (got[2]["resolved"], got[2]["failures"], got[2]["total"]) == ("failed", 1, 2.0)


def test_upsert_is_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write = cohorts.upsert(path, ["id"], "seq")
    one, two = (spark.createDataFrame(r, "id int, seq int, v string") for r in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]))
    write(one, 0)
    write(two, 1)
    write(two, 1)
    now = spark.read.parquet(spark.read.text(f"{path}/current").first()[0])
    assert {(r["id"], r["v"]) for r in now.collect()} == {(1, "c"), (2, "b")}


def test_turns(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "conv_id int, turn int, text string")
    assert {(r["conv_id"], r["turns"], r["last_text"]) for r in cohorts.turns(df).collect()} == {(1, 2, "b"), (2, 1, "c")}


def until(ready, seconds=90):
    end = time.time() + seconds
    while not ready():
        assert time.time() < end
        time.sleep(0.5)


def test_a_step_that_is_not_yet_due_comes_out_later_and_once(spark, tmp_path):
    path, schema = f"file://{tmp_path}", "step_id long, not_before timestamp, note string"
    began = datetime.now(timezone.utc)
    put = lambda rows, name: spark.createDataFrame([(i, began + timedelta(seconds=s), n) for i, s, n in rows], schema).coalesce(1).write.parquet(f"{path}/in/{name}")
    put([(1, 25, "later"), (2, -5, "now")], "a")
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    q = cohorts.due_work(df).writeStream.format("memory").queryName("due").option("checkpointLocation", f"{path}/ck").start()
    try:
        until(lambda: spark.table("due").count())
        if datetime.now(timezone.utc) < began + timedelta(seconds=20):
            assert [r["note"] for r in spark.table("due").collect()] == ["now"]
        put([(1, 25, "again"), (3, -1, "third")], "b")
        until(lambda: spark.table("due").count() >= 3)
        assert sorted((r["step_id"], r["note"], r["not_before"].timestamp() - began.timestamp()) for r in spark.table("due").collect())[0][:2] == (1, "later")
        assert datetime.now(timezone.utc) >= began + timedelta(seconds=25) or spark.table("due").count() < 3
        time.sleep(2)
        assert spark.table("due").count() == 3
    finally:
        q.stop()
