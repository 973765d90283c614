"""Operator 4: quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model of a language is over its characters, of order 4: the last character of each 4-gram given the three before it
(texts start with three start marks). Trusted text are the documents labelled as of good quality, all of them and whole.

1. One pass over all documents gives, for each language, every 4-gram that occurs with its count in trusted text (0 for
   grams that only others have). Tasks count before they send.
2. Continuation counts, context totals and the three discounts of each order are aggregations of that table; the
   probability of every gram follows from joins by (language, gram), shard by shard, from order 1 up to order 4:
   ``max(c - D(c), 0) / n(context) + gamma(context) * p(suffix)``, or ``p(suffix)`` in an unknown context. Order 1 is
   interpolated with the uniform distribution over the language's characters and one unknown.
3. A second pass looks each document's grams up. The probabilities go to all executors if their number is within
   ``BROADCAST_GRAMS`` (12 bytes each); beyond that documents are dealt into blocks of about ``BLOCK_BYTES``, each
   block's distinct grams are joined with their probabilities, and a block meets only its own.
4. A document passes if its perplexity is at most the ``QUANTILE`` quantile of its language's trusted documents.

Grams are packed into longs, 16 bits a character; characters beyond U+FFFE count as one. Scale: shuffles carry a row for
each distinct gram of a task, never one for each character; the number of grams grows with the input as its text varies.

Defined results: null and empty texts have a null perplexity and do not pass; a null language is a language of its own
("und"); languages without trusted text have no model: null perplexity, and their other texts pass; repeated rows count
as often as they are there; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braid.llm.common import staged

ORDER = 4
QUANTILE = 0.99
BROADCAST_GRAMS = 4_000_000
BROADCAST_LABELS = 4_000_000
BLOCK_BYTES = 32 << 20
#: Characters that a worker counts or scores at once.
CHUNK = 1 << 21
START = 1


def grams(text: str) -> np.ndarray:
    """The 4-gram that ends with each character."""
    c = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF).astype(np.uint64)
    padded = np.concatenate([np.full(ORDER - 1, START, np.uint64), c])
    out = np.zeros(len(c), np.uint64)
    for i in range(ORDER):
        out = (out << np.uint64(16)) | padded[i : i + len(c)]
    return out


def _chunks(texts: list[str]):
    """(first, after the last, grams) of runs of texts of about CHUNK characters."""
    first, held, part = 0, 0, []
    for i, t in enumerate(texts):
        part.append(grams(t))
        held += len(part[-1])
        if held >= CHUNK:
            yield first, i + 1, part
            first, held, part = i + 1, 0, []
    if part:
        yield first, len(texts), part


# ---------------------------------------------------------------- counting


def _flagged(docs: DataFrame, labels: DataFrame, broadcast_labels: int) -> DataFrame:
    """doc_id, text, lang ("und" for null) and trusted."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("good_")).filter(F.col("good_").isNotNull()).distinct()
    if good.count() <= broadcast_labels:
        good = F.broadcast(good)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return base.join(good, F.col("doc_id") == F.col("good_"), "left").select("doc_id", "text", "lang", F.col("good_").isNotNull().alias("trusted"))


def counted(flagged: DataFrame) -> DataFrame:
    """(lang, gram, c): every 4-gram of a language with its count in trusted text; staged."""

    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(lang):
            g, c = held.pop(lang)
            return pd.DataFrame({"lang": lang, "gram": g.view("i8"), "c": c})

        for pdf in batches:
            for lang, part in pdf.groupby("lang", sort=False):
                for first, last, gs in _chunks(list(part["text"])):
                    trust = np.repeat(part["trusted"].to_numpy()[first:last].astype("i8"), [len(g) for g in gs])
                    old = held.get(lang, (np.zeros(0, np.uint64), np.zeros(0, "i8")))
                    new, at = np.unique(np.concatenate(gs), return_inverse=True)
                    both, where = np.unique(np.concatenate([old[0], new]), return_inverse=True)
                    held[lang] = both, np.bincount(where, np.concatenate([old[1], np.bincount(at, trust, len(new))]), len(both)).astype("i8")
                    if len(both) > CHUNK // 2:
                        yield rows(lang)
        for lang in list(held):
            yield rows(lang)

    out = flagged.select("lang", "text", "trusted").mapInPandas(run, "lang string, gram long, c long")
    return staged(out.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "grams")


# ---------------------------------------------------------------- probabilities


def _suffix(gram: Column, k: int) -> Column:
    """The last k characters."""
    return gram.bitwiseAND(F.lit((1 << 16 * k) - 1)) if k < 4 else gram


def _discounts(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts from the counts of counts."""
    n = level.groupBy("lang").agg(*[F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = lambda i: F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0), F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.1)), F.lit(float(i)))).otherwise(F.lit(0.75))
    return n.select(F.col("lang"), d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3"))


def _guarded(x: Column, n: Column) -> Column:
    return F.when(n > 0, x / n)


def probabilities(grams_: DataFrame) -> DataFrame:
    """(lang, gram, logp): natural logarithm of the probability of every 4-gram of ``counted``; staged.

    Languages without trusted text have no rows.
    """
    levels = {ORDER: grams_.filter("c > 0").select("lang", "gram", "c")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different characters stand before
        levels[k] = staged(levels[k + 1].groupBy("lang", _suffix(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("c")), f"order{k}")
    sizes = levels[1].groupBy("lang").agg((F.count(F.lit(1)) + 1).cast("double").alias("v"))
    known = F.broadcast(sizes.join(_discounts(levels[1]), "lang"))  # a row for each language
    total = levels[1].join(known, "lang").groupBy("lang").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))).alias("off"), F.first("v").alias("v"), F.first("d1").alias("d1"), F.first("d2").alias("d2"), F.first("d3").alias("d3"))
    asked = {k: grams_.select("lang", _suffix(F.col("gram"), k).alias("gram")).distinct() for k in range(1, ORDER)} | {ORDER: grams_.select("lang", "gram")}
    taken = F.when(F.col("c").isNull(), 0.0).otherwise(F.greatest(F.col("c") - F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")), F.lit(0.0)))
    p = asked[1].join(F.broadcast(total), "lang").join(levels[1], ["lang", "gram"], "left").select("lang", "gram", (taken / F.col("n") + F.col("off") / F.col("n") / F.col("v")).alias("p"))
    for k in range(2, ORDER + 1):
        d = F.broadcast(_discounts(levels[k]))
        context = F.shiftrightunsigned("gram", 16)
        stats = levels[k].groupBy("lang", context.alias("ctx")).agg(F.sum("c").cast("double").alias("n"), *[F.count_if(F.col("c") == i).alias(f"m{i}") for i in (1, 2)], F.count_if(F.col("c") >= 3).alias("m3"))
        lower = staged(p, f"p{k - 1}").withColumnRenamed("gram", "low")
        rows = asked[k].withColumn("ctx", context).withColumn("low", _suffix(F.col("gram"), k - 1))
        rows = rows.join(lower, ["lang", "low"]).join(stats, ["lang", "ctx"], "left").join(levels[k], ["lang", "gram"], "left").join(d, "lang")
        gamma = (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("n")
        p = rows.select("lang", "gram", F.when(F.col("n").isNull(), F.col("p")).otherwise(taken / F.col("n") + gamma * F.col("p")).alias("p"))
    return staged(p.select("lang", "gram", F.log("p").cast("float").alias("logp")), "probabilities")


# ---------------------------------------------------------------- scoring


def _sums(texts: list[str], key: np.ndarray, logp: np.ndarray) -> list[float | None]:
    """Perplexity of each text; key is sorted and holds all of its grams."""
    out: list[float | None] = [None] * len(texts)
    for first, last, gs in _chunks(texts):
        sizes = np.array([len(g) for g in gs])
        values = logp[np.searchsorted(key, np.concatenate(gs))].astype(np.float64)
        sums = np.concatenate([[0.0], np.cumsum(values)])
        ends = np.cumsum(sizes)
        for i, (n, e) in enumerate(zip(sizes, ends, strict=True)):
            if n:
                out[first + i] = float(np.exp(-(sums[e] - sums[e - n]) / n))
    return out


SCORED = "doc_id long, lang string, trusted boolean, n_chars_ long, perplexity double"


def _scored(pdf: pd.DataFrame, tables: dict[str, tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    out = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
    for lang, part in pdf.groupby("lang", sort=False):
        if lang in tables:
            out[part.index] = _sums(list(part["text"]), *tables[lang])
    return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang": pdf["lang"], "trusted": pdf["trusted"], "n_chars_": pdf["text"].map(len), "perplexity": out.astype("Float64")})


def _tables(rows: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for lang, part in rows.groupby("lang", sort=False, observed=True):
        key = part["gram"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        out[lang] = key[order], part["logp"].to_numpy()[order]
    return out


def _by_broadcast(flagged: DataFrame, p: DataFrame) -> DataFrame:
    # as Arrow batches: rows would take the driver some hundred bytes each
    model = flagged.sparkSession.sparkContext.broadcast(_tables(p.toArrow().to_pandas(strings_to_categorical=True)))

    def run(batches):
        for pdf in batches:
            yield _scored(pdf, model.value)

    return flagged.mapInPandas(run, SCORED)


def _by_blocks(flagged: DataFrame, p: DataFrame, block_bytes: int) -> DataFrame:
    total = flagged.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocked = flagged.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(-(-total // block_bytes) or 1)))

    def distinct(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"block": part["block"].iloc[0], "lang": lang, "gram": np.unique(np.concatenate([np.unique(np.concatenate(gs)) for _, _, gs in _chunks(list(part["text"]))])).view("i8")}) for lang, part in pdf.groupby("lang", sort=False)]
        return pd.concat(parts)

    wanted = blocked.select("block", "lang", "text").groupBy("block").applyInPandas(distinct, "block long, lang string, gram long")
    own = wanted.join(p, ["lang", "gram"])
    return blocked.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(lambda docs, rows: _scored(docs, _tables(rows)), SCORED)


def score_documents(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, broadcast_grams: int = BROADCAST_GRAMS, broadcast_labels: int = BROADCAST_LABELS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: doc_id, perplexity, threshold (of its language), kept."""
    flagged = _flagged(docs, labels, broadcast_labels)
    p = probabilities(counted(flagged))
    scored = staged(_by_broadcast(flagged, p) if p.count() <= broadcast_grams else _by_blocks(flagged, p, block_bytes), "perplexity")
    limits = scored.filter("trusted AND perplexity IS NOT NULL").groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))
    out = scored.join(F.broadcast(limits), "lang", "left")
    kept = (F.col("n_chars_") > 0) & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select("doc_id", "perplexity", "threshold", kept.alias("kept"))
