"""Operator 7: benchmark decontamination by spaced seeds.

A spaced seed is a fixed mask over consecutive words; words at ignored positions may differ. All windows of the benchmark
items are hashed under each mask, and so are the windows of the documents; equal hashes are found by a join, each of which
names an item and an alignment, and the alignment is verified: a document is contaminated by an item if ``WINDOW`` aligned
words (the whole item, if it is shorter) have at least ``IDENTITY`` of them equal. The masks are chosen so that every pattern
of tolerated substitutions in a window leaves one of them untouched (a test enumerates the patterns), so seeding loses
nothing. Items shorter than a window are seeded under all masks that ignore as many words as are tolerated.

Words are runs of letters, digits and underscores in lower case. Items of under ``LEAST_WORDS`` words prove no leak and
are ignored.

1. The seeds of the items are a table (hash, item, position). Its hashes set bits of a filter of ``FILTER_BITS`` at most
   (32 MB, whatever the size of the benchmark), which is all that the driver and the executors hold of it.
2. Documents are scanned where they are; what the filter lets through goes, as (text key, hash, position), into the join
   with the seeds. A benchmark too large for the filter lets more through, and the join decides.
3. The texts with a hit meet the aligned items, a text first and its items after it, in one sorted stream, and every
   alignment is verified word by word.

Scale: the benchmark is never gathered in one place; documents without a hit are not shuffled; equal texts are looked
up and verified once. Tables of keys are broadcast after their size was checked, and joined by a shuffle beyond.

Defined results: null or empty text matches nothing; null item text is ignored; repeated rows get equal results; an
empty benchmark leaves every document clean; an empty table gives an empty result; further columns are ignored by
``find_leaks`` and pass through ``clean_documents``, whatever their names. Whole texts are scanned, however long.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.llm.common import staged

WINDOW = 13
IDENTITY = 0.8
LEAST_WORDS = 5
#: Fixed masks: 1 is compared, 0 ignored. Together they survive any two substitutions in a window.
MASKS = ("111011101", "1110100111", "1001110111")
#: Bits of the filter at most, and for each seed where there are fewer.
FILTER_BITS = 1 << 28
BITS_A_SEED = 16
#: Text keys (and found overlaps) that may be broadcast.
BROADCAST_ROWS = 500_000
#: Words that a worker scans at once, and words in its memo, which starts anew when full.
CHUNK_WORDS = 1 << 20
MEMO = 400_000

WORD = re.compile(r"\w+")
U = np.uint64
POWERS = np.random.default_rng(7).integers(1, 2**63, WINDOW + 1, dtype=U) | U(1)
LEAKS = "array<struct<item_id:long,first_word:int,end_word:int,equal_words:int>>"


def tolerated(n: int, identity: float = IDENTITY) -> int:
    """Substitutions that a window of n words may have."""
    return n - math.ceil(n * identity - 1e-9)


def masks_for(n: int, window: int = WINDOW, identity: float = IDENTITY) -> list[str]:
    if n >= window:
        return list(MASKS)
    return ["".join("0" if i in gone else "1" for i in range(n)) for gone in itertools.combinations(range(n), tolerated(n, identity))]


class Coder:
    """64-bit codes of the words of a text."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        found, memo = WORD.findall((text or "").lower()), self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(found):
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, found), U, len(found))


def seeds(codes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window under a mask."""
    n = len(codes) - len(mask) + 1
    out = np.full(max(n, 0), xxhash.xxh3_64_intdigest(mask), U)
    if n > 0:
        for i, c in enumerate(mask):
            if c == "1":
                out += codes[i : i + n] * POWERS[i]
    return out ^ (out >> U(29))


def overlaps(w: np.ndarray, its: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(first word, word after the last, equal words) of the stretches of w that match an item at an alignment."""
    size, lo, hi = min(WINDOW, len(its)), max(0, -shift), min(len(its), len(w) - shift)
    if hi - lo < size:
        return []
    same = np.concatenate([[0], np.cumsum(w[lo + shift : hi + shift] == its[lo:hi])])
    good = np.concatenate([[False], same[size:] - same[:-size] >= size - tolerated(size), [False]])
    first, last = np.nonzero(good[1:] & ~good[:-1])[0], np.nonzero(good[:-1] & ~good[1:])[0] - 1
    return [(int(lo + shift + a), int(lo + shift + b + size), int(same[b + size] - same[a])) for a, b in zip(first, last, strict=True)]


# ---------------------------------------------------------------- the benchmark


def _items(benchmark: DataFrame) -> DataFrame:
    """key, item_id, text of the different items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    return items.select(F.xxhash64("item_id", "text").alias("key"), "item_id", "text").dropDuplicates(["key"])


def _item_seeds(items: DataFrame) -> DataFrame:
    """h, key, q (place in the item), size (words that a window of the item has); staged."""

    def run(batches):
        code = Coder()
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                w = code(text)
                if len(w) >= LEAST_WORDS:
                    for mask in masks_for(len(w)):
                        h = seeds(w, mask)
                        yield pd.DataFrame({"h": h.view("i8"), "key": key, "q": np.arange(len(h), dtype="i4"), "size": np.int32(min(len(w), WINDOW))})

    return staged(items.select("key", "text").mapInPandas(run, "h long, key long, q int, size int"), "seeds")


def _filter(found: DataFrame, n: int, most: int) -> np.ndarray:
    """Words of a filter in which two bits are set for each seed."""
    bits = 1 << min(most.bit_length() - 1, max(6, math.ceil(math.log2(BITS_A_SEED * n))))
    at = F.explode(F.array(F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1))))
    words = found.select(at.alias("b")).select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, CAST(b & 63 AS INT))").alias("x")).groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    out = np.zeros(bits >> 6, U)
    out[words["w"].to_numpy()] = words["x"].to_numpy().view(U)
    return out


def _passes(h: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter lets through."""
    top = U(len(held) * 64 - 1)

    def bit(b):
        return (held[(b >> U(6)).astype("i8")] >> (b & U(63))) & U(1)

    at = np.nonzero(bit(h & top))[0]
    return at[np.nonzero(bit((h[at] >> U(32)) & top))[0]]


# ---------------------------------------------------------------- the documents


def _candidates(texts: DataFrame, masks: list[str], held) -> DataFrame:
    """tkey, h, p of the windows of texts (tkey, text) that the filter lets through."""

    def run(batches):
        code, filtered = Coder(), held.value

        def scanned(part):
            codes = [c for _, c in part]
            w, sizes = np.concatenate(codes), [len(c) for c in codes]
            owner, starts = np.repeat(np.arange(len(part)), sizes), np.cumsum([0, *sizes])
            keys = np.array([k for k, _ in part], "i8")
            for mask in masks:
                h = seeds(w, mask)
                if len(h):
                    at = _passes(h, filtered)
                    at = at[owner[at] == owner[at + len(mask) - 1]]
                    if len(at):
                        yield pd.DataFrame({"tkey": keys[owner[at]], "h": h[at].view("i8"), "p": (at - starts[owner[at]]).astype("i4")})

        part, size = [], 0
        for pdf in batches:
            for key, text in zip(pdf["tkey"], pdf["text"], strict=True):
                c = code(text)
                if len(c) >= LEAST_WORDS:
                    part.append((key, c))
                    size += len(c)
                if size >= CHUNK_WORDS:
                    yield from scanned(part)
                    part, size = [], 0
        if part:
            yield from scanned(part)

    return texts.mapInPandas(run, "tkey long, h long, p int")


def _verified(texts: DataFrame, aligned: DataFrame) -> DataFrame:
    """tkey, item_id, first_word, end_word, equal_words; texts: (tkey, text), aligned: (tkey, item_id, text, shift)."""

    def run(batches):
        code, tkey, w, memo = Coder(), None, None, {}
        for pdf in batches:
            out = []
            for key, kind, item_id, text, shift in zip(pdf["tkey"], pdf["kind"], pdf["item_id"], pdf["text"], pdf["shift"], strict=True):
                if kind == 0:
                    tkey, w = key, code(text)
                elif key == tkey:
                    if text not in memo:
                        if len(memo) > 1000:
                            memo.clear()
                        memo[text] = code(text)
                    out += [(key, None if pd.isna(item_id) else int(item_id), *x) for x in overlaps(w, memo[text], int(shift))]
            yield pd.DataFrame({c: pd.array([r[k] for r in out], "Int64") for k, c in enumerate(("tkey", "item_id", "first_word", "end_word", "equal_words"))})

    none = F.lit(None).cast("long")
    both = texts.select("tkey", F.lit(0).alias("kind"), none.alias("item_id"), "text", none.alias("shift")).unionByName(aligned.select("tkey", F.lit(1).alias("kind"), "item_id", "text", F.col("shift").cast("long").alias("shift")))
    return both.repartition("tkey").sortWithinPartitions("tkey", "kind").mapInPandas(run, "tkey long, item_id long, first_word int, end_word int, equal_words int")


def _sized(rows: DataFrame, limit: int, n: int | None = None) -> DataFrame:
    return F.broadcast(rows) if (rows.count() if n is None else n) <= limit else rows


def _leaks(texts: DataFrame, benchmark: DataFrame, filter_bits: int, broadcast_rows: int) -> DataFrame | None:
    """tkey, item_id, first_word, end_word, equal_words of every overlap of texts (tkey, text); staged. None: no seeds."""
    items = _items(benchmark)
    found = _item_seeds(items)
    sizes = {r["size"]: r["n"] for r in found.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    masks = sorted({m for n in sizes for m in masks_for(n)})
    held = texts.sparkSession.sparkContext.broadcast(_filter(found, sum(sizes.values()), filter_bits))
    candidates = _candidates(texts, masks, held).distinct()
    hits = staged(candidates.join(found.select("h", "key", "q").distinct(), "h").select("tkey", "key", (F.col("p") - F.col("q")).alias("shift")).distinct(), "hits")
    wanted = staged(hits.select("tkey").distinct(), "wanted")
    whole = texts.join(_sized(wanted, broadcast_rows), "tkey", "left_semi").dropDuplicates(["tkey"])
    return staged(_verified(whole, hits.join(items, "key").select("tkey", "item_id", "text", "shift")).distinct(), "leaks")


def find_leaks(docs: DataFrame, benchmark: DataFrame, filter_bits: int = FILTER_BITS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document: doc_id, contaminated, leaks (array of item_id, first_word, end_word, equal_words)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")
    leaks = _leaks(keyed.select("tkey", "text"), benchmark, filter_bits, broadcast_rows)
    if leaks is None:
        return keyed.select("doc_id", F.lit(False).alias("contaminated"), F.array().cast(LEAKS).alias("leaks"))
    each = leaks.groupBy("tkey").agg(F.array_sort(F.collect_list(F.struct("item_id", "first_word", "end_word", "equal_words"))).alias("leaks"))
    out = keyed.select("doc_id", "tkey").join(_sized(each, broadcast_rows, leaks.count()), "tkey", "left")
    return out.select("doc_id", F.col("leaks").isNotNull().alias("contaminated"), F.coalesce("leaks", F.array().cast(LEAKS)).alias("leaks"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, filter_bits: int = FILTER_BITS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents without a leak, in their own columns."""
    leaks = _leaks(docs.select(F.xxhash64("text").alias("tkey"), "text"), benchmark, filter_bits, broadcast_rows)
    if leaks is None:
        return docs
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("tkey"))
    return rows.join(_sized(leaks.select("tkey").distinct(), broadcast_rows), "tkey", "left_anti").select("row.*")
