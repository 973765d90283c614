"""Stored-row tables: declared schemas, readers, and a projection of star-schema tables onto them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.functions import scalars as sc

NOW = datetime(1998, 9, 1)
SHARDS = 4

FLOWS = "shard int, flow_id long, flow_token string, workflow_url string, workflow_name string, graph string, baggage string, status string, step_id long, surgraph_flow_id long, surgraph_step_id long, root_flow_id long, forked_from_step long, thread_id long, thread_token string, trace_parent string, delete_on_completion boolean, delete_after_ms int, final_state string, error string, cancel_reason string, priority int, fairness_key string, fairness_weight double, time_budget_ms int, engine_id long, created_at timestamp, started_at timestamp, updated_at timestamp"
STEPS = "shard int, step_id long, flow_id long, step_depth int, step_token string, task_name string, task_url string, state string, changes string, interrupt_payload string, state_refs string, status string, error string, time_budget_ms int, attempt int, lineage_id long, cohort_size int, cohort_arrivals int, cohort_failures int, fan_out_ordinal int, predecessor_id long, successor_id long, priority int, fairness_key string, fairness_weight double, interrupt_done boolean, resume_data string, subgraph_done boolean, subgraph_result string, subgraph_error string, parked int, not_before timestamp, lease_expires timestamp, lease_seq long, engine_id long, created_at timestamp, started_at timestamp, updated_at timestamp"
PEERS = "shard int, engine_id long, seen_at timestamp, dispatched_at timestamp"
SCHEMAS = {"flows": FLOWS, "steps": STEPS, "peers": PEERS}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def create(spark: SparkSession, path: str) -> None:
    """Empty tables, partitioned by shard."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("errorifexists").partitionBy("shard").parquet(f"{path}/{name}")


def open_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def append(rows: DataFrame, path: str, name: str) -> None:
    """Rows with missing columns filled by null, in the declared types, partitioned by shard."""
    declared = rows.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared])
    full.write.mode("append").partitionBy("shard").parquet(f"{path}/{name}")


def entry_rows(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flows with their self-defaults, and the entry step of each (one deeper than its caller, here depth 1)."""
    own = flows.withColumn("thread_id", F.coalesce(F.nullif(F.col("thread_id"), F.lit(0)), "flow_id")).withColumn("root_flow_id", F.coalesce(F.nullif(F.col("root_flow_id"), F.lit(0)), "flow_id"))
    steps = own.select("shard", F.col("flow_id").alias("step_id"), "flow_id", F.lit(1).alias("step_depth"), F.lit("pending").alias("status"), "priority", "fairness_key", "fairness_weight", F.lit(0).alias("lineage_id"), F.lit(0).alias("parked"), "created_at", F.col("created_at").alias("updated_at"))
    return own, steps


def beats(peers: DataFrame, more: DataFrame) -> DataFrame:
    """Heartbeats upserted: the last of each replica."""
    return peers.unionByName(more).groupBy("shard", "engine_id").agg(F.max("seen_at").alias("seen_at"), F.max("dispatched_at").alias("dispatched_at"))


def pruned(peers: DataFrame, now: datetime, stale_ms: int) -> DataFrame:
    return peers.filter(sc.diff_millis(F.lit(now).cast("timestamp"), F.col("seen_at")) <= stale_ms)


# ---- projections; the SQL of the same names is in braid.plans.queries


def _hours(ts: str, n: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(F.col(ts).cast("timestamp")) + n * 3_600_000)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow for each order; every third one is a subgraph of the order with half its key."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    sub = (F.pmod(key, F.lit(3)) == 0) & (key > 1)
    status = F.when(F.col("o_orderstatus") == "F", F.when(F.pmod(cust, F.lit(10)) == 0, "failed").otherwise("completed")).when(F.col("o_orderstatus") == "P", "interrupted").otherwise(F.when(F.pmod(cust, F.lit(2)) == 0, "running").otherwise("pending"))
    return read(spark, sf_dir, "orders").select(
        F.pmod(key, F.lit(SHARDS)).cast("int").alias("shard"), key.alias("flow_id"), F.concat(F.lit("t"), key.cast("string")).alias("flow_token"),
        F.concat(F.lit("https://host/"), F.lower(F.substring("o_orderpriority", 3, 20))).alias("workflow_url"), F.col("o_orderpriority").alias("workflow_name"),
        status.alias("status"), F.when(F.pmod(key, F.lit(5)) == 0, F.lit(0)).otherwise(key).cast("long").alias("step_id"),
        F.when(sub, F.floor(key / 2)).otherwise(0).cast("long").alias("surgraph_flow_id"), cust.alias("thread_id"),
        F.when(F.pmod(key, F.lit(11)) == 0, 1).otherwise(0).alias("delete_after_ms"),
        F.when(status == "failed", F.concat(F.lit("Error 50%_off at "), key.cast("string"))).alias("error"), F.lit(None).cast("string").alias("cancel_reason"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.concat(F.lit("k"), F.pmod(cust, F.lit(7)).cast("string")).alias("fairness_key"),
        (F.pmod(cust, F.lit(7)) * 0.5).alias("fairness_weight"), F.col("o_orderdate").cast("timestamp").alias("created_at"), _hours("o_orderdate", F.pmod(cust, F.lit(72))).alias("updated_at"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current step of each flow that has one."""
    f = flows(spark, sf_dir)
    return f.filter("step_id <> 0").select("shard", "step_id", "flow_id", F.concat(F.lit("task"), F.pmod("flow_id", F.lit(6)).cast("string")).alias("task_name"), "status", "priority", "fairness_key", "fairness_weight", F.when(F.pmod("flow_id", F.lit(13)) == 0, 1).otherwise(0).alias("parked"), F.col("updated_at").alias("not_before"), F.col("created_at").alias("lease_expires"), "created_at", "updated_at")
