"""Selection of due steps: strict priority bands, fair shares by key, and their division over shards."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braid.functions import scalars as sc
from braid.sources.staging import small


def due(now: datetime) -> Column:
    at = F.lit(now).cast("timestamp")
    return (F.col("status") == "pending") & (F.col("parked") == 0) & (F.col("not_before").cast("timestamp") <= at) & (F.col("lease_expires").cast("timestamp") <= at)


def in_class(step_id: Column, ordinal: int, classes: int) -> Column:
    """The residue class of a replica; everything where there is no valid one."""
    return F.pmod(step_id, F.lit(classes)) == ordinal if classes >= 2 and 0 <= ordinal < classes else F.lit(True)


def claimable(step_id: Column, due_ms: Column, ordinal: int, classes: int, grace_ms: int) -> Column:
    """Own class; the next replica's after one grace; any after two."""
    if classes < 2 or not 0 <= ordinal < classes:
        return F.lit(True)
    own = in_class(step_id, ordinal, classes)
    if grace_ms <= 0:
        return own
    return own | (in_class(step_id, (ordinal + 1) % classes, classes) & (due_ms >= grace_ms)) | (due_ms >= 2 * grace_ms)


def steal_grace(interval_ms: float, min_gap_ms: float, n: int = 4) -> float:
    return n * max(interval_ms, min_gap_ms, 20.0) if n else 0.0


def minimum_band(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows at the least priority (of each group of ``keys``): a small aggregate joined back, not one window over all."""
    if not keys:
        least = rows.agg(F.min("priority").alias("band_"))
        return rows.join(F.broadcast(least), F.col("priority") == F.col("band_"), "left_semi")
    least = rows.groupBy(*keys).agg(F.min("priority").alias("priority"))
    return rows.join(least, [*keys, "priority"], "left_semi")


def scan_band(steps: DataFrame, capacity: int, keep: Column | None = None) -> DataFrame:
    """(fairness_key, priority, n, oldest, weight) at the minimum band of due steps; n is capped at capacity.

    The band is that of all due steps; ``keep`` restricts the tally to those that a replica may claim.
    """
    rows = minimum_band(steps)
    if keep is not None:
        rows = rows.filter(keep)
    oldest = F.min(F.struct("created_at", "step_id", sc.weight_or_one(F.col("fairness_weight")).alias("w")))
    out = rows.groupBy("fairness_key", "priority").agg(F.count(F.lit(1)).alias("n"), oldest.alias("o_"))
    return out.select("fairness_key", "priority", F.least("n", F.lit(capacity)).alias("n"), F.col("o_.created_at").alias("oldest"), F.col("o_.w").alias("weight"))


def fetch_steps(steps: DataFrame, wanted: DataFrame, per_key: int) -> DataFrame:
    """The oldest ``per_key`` steps of each wanted key (fairness_key, priority) at its band."""
    at = Window.partitionBy("fairness_key").orderBy("created_at", "step_id")
    rows = steps.join(small(wanted.select("fairness_key", "priority"), "wanted"), ["fairness_key", "priority"], "left_semi")
    return rows.withColumn("rn", F.row_number().over(at)).filter(F.col("rn") <= per_key)


def merge_tallies(tallies: DataFrame) -> DataFrame:
    """Tallies (shard, fairness_key, priority, n, oldest, weight) at the global minimum band: counts added, the oldest's weight."""
    rows = minimum_band(tallies)
    first = F.min(F.struct("oldest", "shard", "weight"))
    return rows.groupBy("fairness_key", "priority").agg(F.sum("n").alias("n"), first.alias("f_")).select("fairness_key", "priority", "n", F.col("f_.oldest").alias("oldest"), F.col("f_.weight").alias("weight"))


def last_reports(reports: DataFrame) -> DataFrame:
    """The rows of each shard's last scan; a last scan that failed clears what the shard reported before.

    reports: shard, scan (rises), ok, and the columns of a tally (null in the one row of a failed scan).
    """
    newest = reports.groupBy("shard").agg(F.max("scan").alias("scan"))
    return reports.join(newest, ["shard", "scan"], "left_semi").filter("ok")


def pick(keys: list[tuple[str, int, float]], capacity: int, rng) -> list[str]:
    """A key for each slot, drawn by weight among those with steps left (rng: random() in 0..1).

    The work is slots times keys on the driver, whatever the backlog; a share does not depend on it.
    """
    left = {k: n for k, n, _ in keys}
    out = []
    while len(out) < capacity and (open_keys := [(k, w if w > 0 else 1.0) for k, _, w in keys if left[k] > 0]):
        best = max(open_keys, key=lambda kw: rng.random() ** (1.0 / kw[1]))[0]
        left[best] -= 1
        out.append(best)
    return out


def slice_plan(tallies: DataFrame, slots: DataFrame) -> DataFrame:
    """(fairness_key, shard, slots): the first slot to the shard with the oldest step, the rest by largest remainder.

    tallies: (shard, fairness_key, n, oldest); slots: (fairness_key, slots). Ties go to the lower shard.
    """
    key = Window.partitionBy("fairness_key")
    rows = tallies.join(small(slots, "slots"), "fairness_key").filter((F.col("n") > 0) & (F.col("slots") > 0))
    rows = rows.withColumn("slots", F.least("slots", F.sum("n").over(key)))
    rows = rows.withColumn("head", F.row_number().over(key.orderBy("oldest", "shard")) == 1)
    rows = rows.withColumn("left", F.col("n") - F.col("head").cast("int")).withColumn("rem", F.col("slots") - 1).withColumn("total", F.sum("left").over(key))
    product = F.col("rem") * F.col("left")
    rows = rows.withColumn("base", F.when(F.col("total") > 0, F.floor(product / F.col("total"))).otherwise(0)).withColumn("part", F.when(F.col("total") > 0, F.pmod(product, F.col("total"))).otherwise(0))
    rows = rows.withColumn("over", F.col("rem") - F.sum("base").over(key)).withColumn("rank", F.row_number().over(key.orderBy(F.desc("part"), "shard")))
    more = ((F.col("rank") <= F.col("over")) & (F.col("total") > 0)).cast("int")
    return rows.select("fairness_key", "shard", (F.col("base") + F.col("head").cast("int") + more).cast("long").alias("slots"))


def assemble(slots: DataFrame, fetched: DataFrame) -> DataFrame:
    """The n-th slot of a key gets its n-th fetched step. slots: (slot, fairness_key); fetched has ``rn``."""
    nth = slots.withColumn("rn", F.row_number().over(Window.partitionBy("fairness_key").orderBy("slot")))
    return nth.join(fetched, ["fairness_key", "rn"])


def placement(shards: list[tuple[int, float, bool]], draw: float) -> int:
    """Shard for a draw in 0..1: weighted among those that are not cordoned (all, if all are)."""
    open_shards = [(s, w) for s, w, cordoned in shards if not cordoned] or [(s, w) for s, w, _ in shards]
    at = draw * sum(w for _, w in open_shards)
    for s, w in open_shards:
        at -= w
        if at < 0:
            return s
    return open_shards[-1][0]


def placed(rows: DataFrame, key: Column, shards: list[tuple[int, float, bool]]) -> DataFrame:
    """``rows`` with a shard by weight and the hash of ``key``: the inverse of the cumulative weights, as one expression."""
    open_shards = [(s, w) for s, w, cordoned in shards if not cordoned] or [(s, w) for s, w, _ in shards]
    total, at, choice = sum(w for _, w in open_shards), 0.0, F
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    for s, w in open_shards:
        at += w
        choice = choice.when(draw < at / total, F.lit(s))
    return rows.withColumn("shard", choice.otherwise(F.lit(open_shards[-1][0])))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The shard to take from: lowest band, then deepest, then lowest shard. candidates: (shard, band, depth)."""
    return candidates.agg(F.min_by("shard", F.struct("band", -F.col("depth"), "shard")).alias("shard"))
