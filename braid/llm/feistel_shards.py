"""Operator 9: a reproducible shuffle into shards by a Feistel permutation of global row numbers.

Every row gets a global number from 0 to N-1. A balanced Feistel network over a domain of ``a * b >= N`` numbers
permutes it, and cycle walking (apply the network again while the image is outside of 0..N-1) makes that a permutation
of exactly 0..N-1. The image gives the place: ``shard = image % shards`` and ``slot = image div shards``. Anyone who knows
(N, seed, number) can compute shard and slot, and back (``unpermute``), without a lookup table.

The law is ``rows``: shards differ by one row at most and slots are gapless from 0. Groups of equal texts are not kept
together, as that would break the law for a group of a third of all rows.

Native: DataFrame functions only.

Defined results: null text counts as empty (size 8, CRC 0); null doc_id is a value like any other; repeated rows are
rows of their own and get different slots; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braid.llm.common import staged

SHARDS = 24
SEED = 20240607
ROUNDS = 8
#: Buckets of the row numbering. The number of a row depends on it, so it is fixed and not taken from the cluster.
BUCKETS = 4096


def domain(n: int) -> tuple[int, int]:
    """Sides (a, b) of the Feistel domain, the least near-square with a * b >= n."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def walk_limit(n: int) -> int:
    """Steps that cycle walking may need: fewer than ``a`` numbers lie outside, so ``a`` steps always do.

    Beyond a = 64 the chance that 24 steps do not is under 64**-24 for the whole run, and the expression raises then.
    """
    a, _ = domain(n)
    return a if a <= 64 else 24


def _network(x: Column, n: int, seed: int) -> Column:
    a, b = domain(n)
    low = F.pmod(x, F.lit(b))
    sides = F.struct(((x - low) / F.lit(b)).cast("long").alias("l"), low.alias("r"))  # exact below 2**53

    def turn(s: Column, i: Column) -> Column:
        left = F.struct(F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, F.lit(seed)), F.lit(a)), F.lit(a)).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], i, F.lit(seed)), F.lit(b)), F.lit(b)).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    turns = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(turns, sides, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(x: Column, n: int, seed: int = SEED) -> Column:
    """Image of ``x`` (long, 0..n-1) under the permutation of 0..n-1 that (n, seed) name."""
    steps = F.array(*[F.lit(i) for i in range(walk_limit(n))])
    image = F.aggregate(steps, _network(x, n, seed), lambda y, _: F.when(y < n, y).otherwise(_network(y, n, seed)))
    return F.when(image < n, image).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def numbered(rows: DataFrame, by: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number_`` (0..N-1), and N. ``rows`` must be stable (staged), ``by`` its columns in order.

    Rows are hashed into a fixed number of buckets and numbered within each; the driver sees one count for each
    bucket only. Equal rows share a bucket; they may get their numbers in any order.
    """
    placed = rows.withColumn("bucket_", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    counts = {r["bucket_"]: r["n"] for r in placed.groupBy("bucket_").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, n = [0] * buckets, 0
    for k in range(buckets):
        starts[k], n = n, n + counts.get(k, 0)
    within = Window.partitionBy("bucket_").orderBy(*by)
    start = placed.sparkSession.createDataFrame([(k, s) for k, s in enumerate(starts)], "bucket_ int, start_ long")
    ranked = placed.withColumn("rank_", F.row_number().over(within))
    out = ranked.join(F.broadcast(start), "bucket_").withColumn("row_number_", F.col("start_") + F.col("rank_") - 1)
    return out.drop("bucket_", "rank_", "start_"), n


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = staged(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")), "shards")
    rows, n = numbered(slim, ["doc_id", "size", "text_crc32"])
    image = permuted(F.col("row_number_"), n, seed) if n else F.lit(0).cast("long")
    return rows.withColumn("image_", image).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("image_", F.lit(shards)).cast("int").alias("shard"),
        ((F.col("image_") - F.pmod("image_", F.lit(shards))) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("row_number_").alias("row_number"),
    )
