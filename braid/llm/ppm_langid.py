"""Operator 6: language identification by prediction by partial matching.

Each language has a context tree of bytes (of the text in lower case) up to ``ORDER`` = 3 bytes deep, with frozen counts.
A byte is coded in its longest known context; if it is new there, an escape is coded and the next shorter context is
tried, down to a uniform code over 256 bytes. With n occurrences and d different bytes in a context, a byte seen c times
has probability c / (n + d) and the escape d / (n + d). The language with the least exact code length is predicted.

The trees are laid out as tables, so that the code lengths of all bytes and languages are gathered at once: a table of the
known 3-byte strings, one of the known 4-byte strings, and the escape costs of their contexts.

Learning: whole different texts of each language, in order of a hash of the text, until they have ``TRAIN_BYTES``, among
the rows that are admitted and have a language; so every such language is learned, from one text at least, whatever the
rows' ids. Rows of small hash are drawn first, and more only where these held too little; no more than the texts taken
reach the driver. Scoring covers all rows and whole texts and uses the text alone.

Scale: the model is a few MB whatever the corpus; documents are scored where they are, without a shuffle; a worker holds
``CHUNK`` bytes of text and their costs at once (a longer text is summed chunk by chunk).

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything if nothing could be
learned; rows with equal texts get equal results; of equal code lengths the first language by name wins; an empty table
gives an empty result; further columns are ignored. Texts that are null or empty teach nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = 3
TRAIN_BYTES = 400_000
CHUNK = 1 << 19
#: Bytes that count for the score; the code lengths of longer texts are scaled to it.
SCORE_BYTES = 60

LETTER = re.compile(r"[^\W\d_]")


def _keys(data: np.ndarray, n: int) -> np.ndarray:
    """Each n-byte string of ``data`` as a number, by its last byte's place from n - 1 on."""
    out = np.zeros(max(0, len(data) - n + 1), np.uint32)
    for i in range(n):
        out = (out << np.uint32(8)) | data[i : len(data) - n + 1 + i]
    return out


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(b"   " + text.lower().encode(), np.uint8)


class Tree:
    """Counts of one language's strings of 1 to ORDER + 1 bytes, and the code lengths that follow."""

    def __init__(self, texts):
        self.counts: list[dict[str, np.ndarray]] = []
        for n in range(1, ORDER + 2):
            parts = [np.unique(_keys(_bytes(t), n)[ORDER + 1 - n :], return_counts=True) for t in texts]
            keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint32)
            times = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, int)
            key, at = np.unique(keys, return_inverse=True)
            count = np.bincount(at, times, len(key))
            ctx, first = np.unique(key >> np.uint32(8), return_inverse=True)
            self.counts.append({"key": key, "count": count, "ctx": ctx, "n": np.bincount(first, count, len(ctx)), "d": np.bincount(first, minlength=len(ctx)).astype(float)})

    def cost(self, n: int, strings: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each n-byte string after the others; n = 0: the uniform code."""
        if n == 0:
            return np.full(len(strings), 8.0)
        t = self.counts[n - 1]
        strings = strings.astype(np.uint32)
        out = self.cost(n - 1, strings & np.uint32((1 << 8 * (n - 1)) - 1) if n < 5 else strings) + self.escape(n, strings >> np.uint32(8) if n > 1 else np.zeros(len(strings), np.uint32))
        if len(t["key"]):
            at = np.minimum(np.searchsorted(t["key"], strings), len(t["key"]) - 1)
            hit = t["key"][at] == strings
            c = np.minimum(np.searchsorted(t["ctx"], strings >> np.uint32(8)), len(t["ctx"]) - 1)
            out = np.where(hit, np.log2((t["n"][c] + t["d"][c]) / t["count"][at]), out)
        return out

    def escape(self, n: int, contexts: np.ndarray) -> np.ndarray:
        """Bits of the escape from contexts of n - 1 bytes; none from unknown ones."""
        t = self.counts[n - 1]
        if not len(t["ctx"]):
            return np.zeros(len(contexts))
        at = np.minimum(np.searchsorted(t["ctx"], contexts), len(t["ctx"]) - 1)
        return np.where(t["ctx"][at] == contexts, np.log2((t["n"][at] + t["d"][at]) / t["d"][at]), 0.0)


class Model:
    """The trees of all languages as tables; ``langs`` in order of their names."""

    def __init__(self, trees: dict[str, Tree]):
        self.langs = sorted(trees)
        each = [trees[k] for k in self.langs]
        wide = lambda f: np.stack([f(t) for t in each], axis=1).astype(np.float32) if each else None
        if not each:
            return
        self.key3 = np.unique(np.concatenate([t.counts[2]["key"] for t in each] + [t.counts[3]["ctx"] for t in each]))
        self.key4 = np.unique(np.concatenate([t.counts[3]["key"] for t in each]))
        two = np.arange(1 << 16, dtype=np.uint32)
        self.cost2 = wide(lambda t: t.cost(2, two))
        self.escape2 = wide(lambda t: t.escape(3, two))
        blank = np.zeros((1, len(each)), np.float32)
        self.cost3 = np.concatenate([blank, wide(lambda t: t.cost(3, self.key3))])
        self.escape3 = np.concatenate([blank, wide(lambda t: t.escape(4, self.key3))])
        self.cost4 = np.concatenate([blank, wide(lambda t: t.cost(4, self.key4))])

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of all 3-byte strings in cost3, and of (known 3-byte string, byte before it) in cost4; 0: unknown."""
        if "_tables" not in self.__dict__:
            at3 = np.zeros(1 << 24, np.int32)
            at3[self.key3] = np.arange(1, len(self.key3) + 1)
            at4 = np.zeros((len(self.key3) + 1) * 256, np.int32)
            at4[at3[self.key4 & np.uint32(0xFFFFFF)] * 256 + (self.key4 >> np.uint32(24)).astype(np.int32)] = np.arange(1, len(self.key4) + 1)
            self._tables = at3, at4
        return self._tables

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Code length of each byte from the fourth on, by language."""
        at3, at4 = self.tables()
        k3 = _keys(data, 3)
        id3 = at3[k3]
        now, before, three = id3[1:], id3[:-1], k3[1:]
        id4 = at4[now * 256 + data[: len(now)]]
        out = self.cost4[id4]
        new = np.nonzero(id4 == 0)[0]
        if len(new):
            n3, k = now[new], three[new]
            low = np.where(n3[:, None] > 0, self.cost3[n3], self.escape2[k >> np.uint32(8)] + self.cost2[k & np.uint32(0xFFFF)])
            out[new] = low + self.escape3[before[new]]
        return out

    def lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(code lengths by language, bytes) of each text."""
        out, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        part: list[np.ndarray] = []
        rows: list[int] = []
        held = 0

        def flush():
            nonlocal part, rows, held
            if part:
                data = np.concatenate(part)
                # bytes 4.. of each text count; the three that lead it in, and those that bridge two texts, do not
                starts = np.cumsum([0] + [len(x) for x in part])
                keep = np.ones(len(data), bool)
                for s in starts[:-1]:
                    keep[s : s + ORDER] = False
                bits = self.bits(data) * keep[ORDER:, None]
                total = np.concatenate([np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0, dtype=np.float64)])
                ends = starts - ORDER
                for i, (a, b) in zip(rows, zip(np.maximum(ends[:-1], 0), ends[1:], strict=True), strict=True):
                    out[i] += total[max(b, 0)] - total[a]
            part, rows, held = [], [], 0

        for i, t in enumerate(texts):
            data = _bytes(t)
            sizes[i] = len(data) - ORDER
            for s in range(0, max(1, len(data) - ORDER), CHUNK):
                piece = data[s : s + CHUNK + ORDER]
                part.append(piece)
                rows.append(i)
                held += len(piece)
                if held >= CHUNK:
                    flush()
        flush()
        return out, sizes

    def predict(self, texts) -> tuple[list[str], list[float]]:
        use = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if use:
            bits, sizes = self.lengths([texts[i] for i in use])
            best = bits.argmin(axis=1)
            scaled = -(bits - bits.min(axis=1, keepdims=True)) * np.log(2) * np.minimum(1, SCORE_BYTES / np.maximum(sizes, 1))[:, None]
            p = 1 / np.exp(scaled).sum(axis=1)
            for k, i in enumerate(use):
                langs[i], scores[i] = self.langs[best[k]], float(p[k])
        return langs, scores


def bucket(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3; null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def fit(docs: DataFrame, train: Column | None = None, train_bytes: int = TRAIN_BYTES) -> Model:
    """A model of the languages of the rows that ``train`` admits, by default all."""
    rows = docs.filter((F.lit(True) if train is None else train) & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("text").alias("hash"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    place, texts = F.pmod("hash", F.lit(1 << 20)), {}
    shares = {lang: min(1.0, 2.0 * train_bytes / n) for lang, n in sizes.items()}
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("place", "hash").rowsBetween(Window.unboundedPreceding, -1))
    while shares:  # the texts of least hash up to train_bytes; a language whose share had fewer bytes is drawn anew
        share = F
        for lang, x in shares.items():
            share = share.when(F.col("lang") == lang, F.lit(x))
        some = rows.filter(place < share.otherwise(F.lit(0.0)) * (1 << 20)).groupBy("lang", place.alias("place"), "hash").agg(F.min("text").alias("text"))
        texts |= {k: [] for k in shares}
        for r in some.withColumn("before", before).filter(F.coalesce("before", F.lit(0)) < train_bytes).select("lang", "text").collect():
            texts[r["lang"]].append(r["text"])
        shares = {k: min(1.0, 4 * x) for k, x in shares.items() if x < 1 and sum(len(t.encode()) for t in texts[k]) < train_bytes}
    return Model({k: Tree(x) for k, x in texts.items() if x})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each document: doc_id, lang_pred, score."""

    def run(batches):
        for pdf in batches:
            langs, scores = model.predict(list(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": langs, "score": scores})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")
