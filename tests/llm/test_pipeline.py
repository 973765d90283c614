import random

import duckdb
import pytest

import corpus_pipeline
from braid.llm import oracles, queries
from tests.llm import fixtures as fx
from tests.test_queries import rows as plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert plain(queries.queries()[name](spark, SF).toPandas()) == plain(con.execute(oracles.ORACLES[name]).df())


def text(seed, n=80):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghij") + str(r.randrange(10**6)) for _ in range(n))


def write(spark, path):
    items = [(0, text("item", 40)), (1, text("other", 30))]
    clean = [(i, text(i)) for i in range(20)]
    toxic = [(100 + i, text(100 + i, 60) + " you moron and scum") for i in range(40)]
    fine = [(200 + i, text(200 + i)) for i in range(60)]
    short = [(300, "too short"), (301, None), (302, ""), (303, "same words here " * 60)]
    near = [(400, text(7777)), (401, text(7777) + " end"), (402, text(7777))]
    leaked = [(500, text(500, 30) + " " + items[0][1] + " " + text(501, 30))]
    docs = fx.docs(spark, [(*r, "en", f"s{r[0] % 3}") for r in clean + toxic + fine + short + near + leaked])
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, 1) for d, _ in toxic[:30]] + [(d, 1, 0) for d, _ in fine], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    path = f"file://{tmp_path}/sf"
    docs = write(spark, path)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    everything = {r["doc_id"] for r in docs.collect()}
    gone = [set(range(100, 140)), {300, 301, 302, 303}, {401, 402}, {500}]
    now = spark.read.parquet(f"{path}/documents.parquet")
    for k, ((_, stage), lost) in enumerate(zip(corpus_pipeline.STAGES[:-1], gone, strict=True)):
        now = stage(spark, now, path)
        assert now.columns == docs.columns
        now.write.parquet(f"{path}/{k}")
        now = spark.read.parquet(f"{path}/{k}")
        everything -= lost
        assert {r["doc_id"] for r in now.collect()} == everything, k
    packed = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in packed} == everything and corpus_pipeline.ORACLE_SQL is None
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024


def test_hard_cases(spark, tmp_path):
    path = f"file://{tmp_path}/hard"
    df = fx.with_extra(fx.hard(spark).unionByName(fx.docs(spark, [(11, text("kept"))])))
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        for some in (df, df.limit(0)):
            stage(spark, some, path).collect()
    # all words of the long text lie in repeated windows, so the quality rules reject it; the others are too short
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()} == {11}
