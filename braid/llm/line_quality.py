"""Operator 5: quality rules from the frequency of lines across documents.

Lines are normalised (trimmed, lower case, runs of white space as one space) and hashed. For each host the distinct
documents of a line are counted; copies of one text count as one document, so that a text which was crawled many times
is not taken for boilerplate (the near-duplicate stage deals with it). A line in more than ``MIN_DOCS`` of a host's
documents is boilerplate, however large the host is: it is removed, and a document that has lost more than a stated share of its words by that is depleted and rejected.

Native: DataFrame functions only. The text is read once; what follows works on a slim staged table of hashes and counts.
The frequent lines number ``lines / MIN_DOCS`` at most, as each is in so many documents; they are broadcast only after their number was checked, and joined by a shuffle (split by AQE where skewed) beyond.

Defined results: null text has no lines and no words (base_failed); empty text likewise; null host is a host of its own;
repeated rows get equal verdicts and count once; an empty table gives an empty result; further columns pass through
``clean_documents``, whatever their names, and are ignored by ``score_documents``. A document without words is not depleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braid.llm.common import SPACES, let, staged

#: A line is boilerplate in a host if more documents than this have it.
MIN_DOCS = 10
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.3
#: Frequent lines that may be broadcast (24 bytes each).
BROADCAST_LINES = 100_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in 3-word windows which the text has twice or more.

    Windows are sorted as longs that hold a hash above and the position below; equal neighbours are then compared by
    their words, so that the hash decides only the order.
    """

    def count(w: Column) -> Column:
        n = F.size(w)
        mask = (F.pow(F.lit(2.0), F.length(F.bin(n))) - 1).cast("long")  # the bits of a position
        return F.when(n < 4, F.lit(0)).otherwise(let(mask, lambda m: covered(w, n, m)))

    def covered(w: Column, n: Column, mask: Column) -> Column:
        def tagged(i: Column) -> Column:
            return F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))

        def place(x: Column) -> Column:
            return x.bitwiseAND(mask).cast("int")

        def same(a: Column, b: Column) -> Column:
            near = a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(mask)) == 0
            p, q = place(a), place(b)
            return near & (w[p] == w[q]) & (w[p + 1] == w[q + 1]) & (w[p + 2] == w[q + 2])

        def spread(s: Column) -> Column:
            m = F.size(s)
            again = F.filter(F.sequence(F.lit(0), m - 1), lambda k: ((k > 0) & same(s[k], s[F.greatest(k - 1, F.lit(0))])) | ((k < m - 1) & same(s[F.least(k + 1, m - 1)], s[k])))
            starts = F.transform(again, lambda k: place(s[k]))
            return let(starts, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2)))))

        return let(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), tagged)), spread)

    return let(words, count)


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACES, " ")))


def base_counts(text: Column) -> dict[str, Column]:
    """The columns n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the contract."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words_of(text)).cast("long"),
        "word_chars": F.length(F.regexp_replace(whole, SPACES, "")).cast("long"),
        "n_symbols": (F.size(F.split(whole, r"[#*$%&|<>]", -1)) - 1).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words_of(text)).cast("long"),
    }


def _text_key() -> Column:
    return F.xxhash64("text", F.length("text"))


def _slim(docs: DataFrame) -> DataFrame:
    """doc_id, host, text key, base counts and the hash and words of each line; staged."""
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.size(words_of(x)).alias("n")))
    return staged(docs.select("doc_id", F.col("source").alias("host"), _text_key().alias("tkey"), *[c.alias(k) for k, c in base_counts(F.col("text")).items()], hashed.alias("lines")), "lines")


def frequent_lines(slim: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(host, h, n_docs) of the lines above the limit; staged."""
    texts = slim.select("host", "tkey", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = texts.groupBy("host", "h", "tkey").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.sum("one").alias("n_docs"))
    return staged(counts.filter(F.col("n_docs") > min_docs), "frequent")


def _sized(frequent: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(frequent) if frequent.count() <= limit else frequent


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of ``names`` and ``names_`` (a trailing underscore on the right)."""
    out = F.lit(True)
    for k in names:
        out = out & left[k].eqNullSafe(right[f"{k}_"])
    return out


def _losses(slim: DataFrame, frequent: DataFrame) -> DataFrame:
    """(host_, tkey_, removed_words, removed_lines, bad) of the texts with a frequent line; copies are taken once."""
    lines = slim.select("host", "tkey", F.posexplode("lines").alias("at", "x")).select("host", "tkey", "at", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    named = frequent.select(F.col("host").alias("host_"), F.col("h").alias("h_"))
    hits = lines.join(named, _same(lines, named, ["host", "h"]), "left_semi")
    once = hits.groupBy("host", "tkey", "at").agg(F.max("h").alias("h"), F.max("n").alias("n"))
    return once.groupBy(F.col("host").alias("host_"), F.col("tkey").alias("tkey_")).agg(F.sum("n").alias("removed_words"), F.count(F.lit(1)).alias("removed_lines"), F.collect_set("h").alias("bad"))


def _verdicts(docs: DataFrame, min_docs: int, least_left: float, broadcast_lines: int) -> DataFrame:
    slim = _slim(docs)
    frequent = frequent_lines(slim, min_docs)
    losses = _losses(slim, F.broadcast(frequent) if frequent.count() <= broadcast_lines else frequent)
    out = slim.join(losses, _same(slim, losses, ["host", "tkey"]), "left").fillna(0, ["removed_words", "removed_lines"])
    depleted = (F.col("n_words") - F.col("removed_words")) < F.col("n_words") * least_left
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def score_documents(docs: DataFrame, min_docs: int = MIN_DOCS, least_left: float = LEAST_LEFT, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """One row for each document: the base counts, base_failed, kept, removed_lines and removed_words."""
    out = _verdicts(docs, min_docs, least_left, broadcast_lines)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_lines", "removed_words")


def clean_documents(docs: DataFrame, min_docs: int = MIN_DOCS, least_left: float = LEAST_LEFT, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The kept documents in their own columns, their text without the lines above the limit (n_chars follows)."""
    judged = _verdicts(docs, min_docs, least_left, broadcast_lines)
    kept = judged.filter("kept").groupBy(F.col("host").alias("host_"), F.col("tkey").alias("tkey_")).agg(F.first("bad").alias("bad"))
    keyed = docs.select(F.struct("*").alias("row"), F.col("source").alias("host"), _text_key().alias("tkey"))  # a row's own columns cannot clash in its struct
    out = keyed.join(kept, _same(keyed, kept, ["host", "tkey"]))
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda x: ~F.array_contains(F.col("bad"), F.xxhash64(normalised(x)))), "\n")
    out = out.select("row", F.when(F.col("bad").isNull(), F.col("row.text")).otherwise(left).alias("text"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("row")).select("row.*")
