"""Streams of branch results: a barrier for each cohort, delayed work, leases and thread turns.

State is kept by key in Structured Streaming; checkpoints make it survive lost executors, and sinks write by key so that
a batch that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COHORT = "lineage_id long, arrivals long, failures long, total double, last_ordinal long, resolved string"
_STATE = "arrivals long, failures long, total double, last_ordinal long, done boolean"


def barrier(branches: DataFrame, size: str = "cohort_size", timeout_ms: int = 0, grace_ms: int = 0) -> DataFrame:
    """One row for each cohort when all of its branches have arrived: completed, or failed if any did.

    branches: lineage_id, cohort_size, fan_out_ordinal, status, value. A late branch of a failed cohort still counts, so a
    cohort resolves once, after its last arrival. With a timeout, a cohort that waits longer is resolved as timed out.
    What is kept of a resolved cohort, so that a repeated branch does not open it again, goes after ``grace_ms`` (0: never).
    """

    def arrive(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        arrivals, failures, total, last, done = state.get if state.exists else (0, 0, 0.0, -1, False)
        resolved, wanted = "", 0
        if state.hasTimedOut and done:
            state.remove()
            return
        if state.hasTimedOut:
            resolved = "timed out"
        else:
            for pdf in batches:
                ok = pdf["status"] == "completed"
                arrivals, failures = arrivals + len(pdf), failures + int((~ok).sum())
                total, last = total + float(pdf["value"].where(ok, 0).sum()), max(last, int(pdf["fan_out_ordinal"].max()))
                wanted = max(wanted, int(pdf[size].max()))
            if not done and wanted and arrivals >= wanted:
                resolved = "failed" if failures else "completed"
        if resolved and not done:
            yield pd.DataFrame([(key[0], arrivals, failures, total, last, resolved)], columns=[c.split()[0] for c in COHORT.split(", ")])
        done = done or bool(resolved)
        state.update((arrivals, failures, total, last, done))
        if wait := grace_ms if done else timeout_ms:
            state.setTimeoutDuration(wait)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms or grace_ms else GroupStateTimeout.NoTimeout
    return branches.groupBy("lineage_id").applyInPandasWithState(arrive, COHORT, _STATE, "append", timeout)


def due_work(steps: DataFrame, grace_ms: int = 3_600_000) -> DataFrame:
    """Each step of a stream once, when its not_before is reached: one that is still ahead waits in the state of its key.

    A timer at not_before lets it out in the first trigger after that, whether or not more steps come. Repeats (deliveries
    are at least once) drop out by step; that a step was let out is kept for ``grace_ms``. A step without not_before is due.
    """

    def wait(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        payload, at, out = state.get if state.exists else (None, 0, False)
        if state.hasTimedOut and out:
            state.remove()
            return
        if not state.hasTimedOut:
            for pdf in batches:  # of repeats the first counts
                if payload is None and len(pdf):
                    payload, at = pdf["payload"].iloc[0], int(pdf["at"].iloc[0])
        now = state.getCurrentProcessingTimeMs()
        if not out and at <= now:
            yield pd.DataFrame({"payload": [payload]})
            out = True
        state.update((payload if not out else "", at, out))
        state.setTimeoutDuration(grace_ms if out else at - now)

    rows = steps.select("step_id", F.coalesce(F.unix_millis(F.col("not_before").cast("timestamp")), F.lit(0)).alias("at"), F.to_json(F.struct("*")).alias("payload"))
    due = rows.groupBy("step_id").applyInPandasWithState(wait, "payload string", "payload string, at long, out boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return due.select(F.from_json("payload", steps.schema).alias("step")).select("step.*")


def turns(messages: DataFrame) -> DataFrame:
    """The running fold of each thread: number of turns and the last text."""
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max_by("text", "turn").alias("last_text"))


def upsert(path: str, keys: list[str], order: str):
    """A ``foreachBatch`` sink that keeps the last row of each key in a table; running a batch again changes nothing.

    Each batch writes a new version beside the old one and then names it as current.
    """
    current = str(PurePosixPath(path) / "current")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        versions = spark.read.text(current).collect() if _exists(spark, current) else []
        rows = batch if not versions else spark.read.parquet(versions[0][0]).unionByName(batch)
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        target = f"{path}/v{epoch}"
        if versions and versions[0][0] == target:
            return
        best.write.mode("overwrite").parquet(target)
        spark.createDataFrame([(target,)], "value string").coalesce(1).write.mode("overwrite").text(current)

    return write


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
