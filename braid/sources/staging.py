"""Where intermediate tables go: the shared folder that the session names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset in a local run one of our own, removed at the end."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    app = spark.sparkContext.applicationId
    if app not in _own:
        path = tempfile.mkdtemp(prefix="braid-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[app] = f"file://{path}"
    return _own[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a side that is known to be small: only up to here is it sent to every executor.
MAX_BROADCAST = 100_000


def small(df: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """``df`` staged, and broadcast in joins if it has at most ``limit`` (MAX_BROADCAST) rows; else Catalyst chooses."""
    out = staged(df, name)
    return F.broadcast(out) if out.count() <= (MAX_BROADCAST if limit is None else limit) else out


#: Rows that a task takes of a table that is shuffled by ``by_key``.
ROWS_A_TASK = 500_000


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` shuffled by ``keys`` into as many partitions as its rows need. By itself Spark fills a task by compressed bytes,
    so that sorted keys make tasks of tens of millions of rows. The rows are counted first."""
    return df.repartition(max(1, -(-df.count() // ROWS_A_TASK)), *keys)


class appended:
    """A table in the shared folder that grows by whole batches; what is there already is never written again."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.schema = spark.createDataFrame([], schema).schema
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


class batches:
    """Tables of one schema in the shared folder, a folder for each round; each is written once, and all are read as one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths, self.schema = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", [], None

    def add(self, rows: DataFrame) -> DataFrame:
        self.schema = self.schema or rows.schema
        self.paths.append(f"{self.name}/{len(self.paths)}")
        rows.select(*self.schema.names).write.parquet(self.paths[-1])
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)
