import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from braid.llm import feistel_shards as op
from tests.llm import fixtures as fx


def plain_image(x, n, seed):
    """The permutation in plain integers: alternate sides of a near-square, turned until the image is below n."""
    a = math.ceil(math.sqrt(n))
    b = math.ceil(n / a)

    def mixed(side, i):
        h = 42
        for raw in (struct.pack("<q", side), struct.pack("<i", i), struct.pack("<i", seed)):
            h = xxhash.xxh64_intdigest(raw, h)
        return h - (h >> 63 << 64)

    while True:
        left, right = divmod(x, b)
        for i in range(op.ROUNDS):
            if i % 2:
                right = (right + mixed(left, i)) % b
            else:
                left = (left + mixed(right, i)) % a
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 5, 37, 1000])
def test_equals_plain_integers(spark, n):
    for seed in (op.SEED, 7):
        got = {r["id"]: r["y"] for r in spark.range(n).select("id", op.permuted(F.col("id"), n, seed).alias("y")).collect()}
        assert got == {x: plain_image(x, n, seed) for x in range(n)}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 4097, 50_001])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(op.permuted(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n))
    again = [r[0] for r in spark.range(n).repartition(7).select("id", op.permuted(F.col("id"), n)).sort("id").select(F.col(spark.range(1).columns[0])).collect()]
    assert again == list(range(n))
    if n > 100:
        other = [r[0] for r in spark.range(n).select(op.permuted(F.col("id"), n, 7)).collect()]
        assert other != got
        assert sum(abs(a - b) for a, b in zip(got, got[1:])) / n > n / 5  # neighbours part


def test_shards(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op.shard_documents(df).collect()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(texts) and set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s, c in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(c))
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    again = op.shard_documents(df.repartition(13)).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_hard_cases(spark):
    df = fx.with_extra(fx.hard(spark))
    got = op.shard_documents(df).collect()
    assert len(got) == 10 and sorted(r["row_number"] for r in got) == list(range(10))
    assert len({(r["shard"], r["slot"]) for r in got}) == 10
    assert op.shard_documents(df.limit(0)).count() == 0
