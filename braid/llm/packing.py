"""Operator 2: packing of token sequences by linear grouping and configurations, then best fit.

1. Every document becomes its token ids plus an end id. Only longer ones than a sequence are cut, into pieces of full
   length; the first piece takes the rest.
2. The histogram of piece lengths (as many rows as a sequence has tokens, at most) goes to the driver.
3. Linear grouping: lengths above ``capacity / small_part`` are sorted and dealt into groups of equal cardinality, each
   rounded up to its longest. A linear program over configurations (which groups share a sequence) is solved by column
   generation; its solution is rounded down. Actual lengths take the places of the rounded ones, longest first.
   Sequences that are then short by more than a limit (the best of ``SLACKS``) are taken apart again.
4. What is left of the large pieces and all small ones go, longest first, where they fit best: into the sequence with
   the least sufficient room, or a new one.
5. All of that is run-length coded: a plan row says that the pieces of one length with ranks from r to r+n-1 go to
   sequences s to s+n-1 at one offset. Pieces get their rank within their length by a window over hashed buckets, and
   look up their place in the plan by binary search.

Scale: texts are read once and never shuffled, only 40 bytes a piece are; the plan has some thousand rows whatever the
number of documents; a length that holds a third of all pieces is dealt over the buckets.

The ids are those of the tokenizer in ``public_tokenizers.path("byte_bpe_50k.json")``. They are made from the same
vocabulary's rank file by a faster library, whitespace-delimited chunks at a time with a bounded memo (chunks are units
of the tokenizer's own pre-splitting wherever no two white-space characters meet; other texts are encoded whole). Tests
hold them against the tokenizer itself. Strings of special tokens in a text are ordinary text.

Defined results: null text counts as empty, which is one piece of the end id alone; repeated rows are packed each; an
empty table gives an empty result; very long texts give many full pieces; further columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array as pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braid.llm.common import staged

CAPACITY = 1024
END_ID = 2
#: Groups of the linear grouping; lengths up to CAPACITY / SMALL_PART are small.
GROUPS = 128
SMALL_PART = 8
#: The linear program stops within this share of its optimum.
GAP = 0.02
#: Sequences that substitution leaves with more room than this are taken apart again, and their pieces go to the best fit;
#: of no limit and these the one that gives the fewest sequences is taken, of equal ones the first.
SLACKS = (8, 4, 2, 1, 0)
BUCKETS = 4096
#: Chunks in a worker's memo; it starts anew when full.
MEMO = 60_000
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- token ids

_workers: dict[str, Encoder] = {}


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memo: dict[str, bytes] = {}
        self.meets = re.compile(r"\s\s").search
        self.odd = re.compile(r"[^\S \n]").search

    def whole(self, text: str) -> bytes:
        return pack("I", self.encode(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if self.meets(text) or self.odd(text):
            return self.whole(text)
        chunks = text.replace("\n", " \n").replace(" ", "\0 ").replace("\0 \n", "\0\n\0").split("\0") if "\0" not in text else [text]
        memo, out = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        for c in chunks:
            ids = memo.get(c)
            if ids is None:
                ids = memo[c] = self.whole(c)
            out.append(ids)
        return b"".join(out)


def encoder(path: str) -> Encoder:
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece."""

    def run(batches):
        encode = encoder(path or ranks_path())
        end = np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                raw = encode(text or "") + end
                for k, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                    part = raw[4 * s : 4 * (s + n)]
                    rows.append((doc_id, k, s, n, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype("i8"),) if with_ids else ()))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, SCHEMA + ", ids array<long>" * with_ids)


# ---------------------------------------------------------------- the plan


class Bins:
    """``count`` sequences with equal contents: ``lengths`` one after another."""

    __slots__ = ("count", "room", "lengths")

    def __init__(self, count: int, room: int, lengths: tuple[int, ...] = ()):
        self.count, self.room, self.lengths = count, room, lengths

    def split(self, n: int) -> Bins:
        """The first n sequences; self keeps the others."""
        self.count -= n
        return Bins(n, self.room, self.lengths)

    def add(self, length: int, copies: int = 1) -> None:
        self.lengths += (length,) * copies
        self.room -= length * copies


def groups_of(hist: dict[int, int], least: int, k: int) -> list[list[int]]:
    """Lengths above ``least``, longest first, in at most k groups of about equal cardinality."""
    large = sorted((s for s in hist if s > least), reverse=True)
    share, out, filled = sum(hist[s] for s in large) / k, [], 0.0
    for s in large:
        if not out or filled >= share - 1e-9:
            out.append([])
            filled = 0.0
        out[-1].append(s)
        filled += hist[s]
    return out


def inverted(m: np.ndarray) -> np.ndarray:
    """The inverse by elimination, element by element.

    The plan is made in the driver, where threaded linear algebra can wait for ever on threads that were lost when the
    JVM was forked off, so nothing here calls it.
    """
    k = len(m)
    a = np.concatenate([m, np.eye(k)], axis=1)
    for j in range(k):
        i = j + int(np.abs(a[j:, j]).argmax())
        if i != j:
            a[[i, j]] = a[[j, i]]
        a[j] /= a[j, j]
        rest = a[:, j].copy()
        rest[j] = 0
        hit = np.nonzero(rest)[0]
        a[hit] -= rest[hit, None] * a[j]
    return a[:, k:]


def configurations(sizes: list[int], demand: list[int], capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """(copies of each size, how many) of a linear program that covers the demand with the fewest sequences.

    Column generation: a revised simplex over the configurations so far, and a knapsack over the dual values for the
    next one. It stops within ``gap`` of the optimum: no solution is under the present one divided by the best value of
    a configuration. ``sizes`` fall.
    """
    k, s, need = len(sizes), np.array(sizes), np.array(demand, float)
    basis = np.diag([capacity // x for x in sizes]).astype(float)
    inverse = np.diag(1 / basis.diagonal())
    amount = need / basis.diagonal()
    first = np.searchsorted(-s, -np.arange(capacity + 1))  # sizes from there on fit
    for step in range(50 * k):
        value = inverse.sum(axis=0)
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(sizes[-1], capacity + 1):
            each = best[c - s[first[c] :]] + value[first[c] :]
            pick = int(each.argmax())
            if each[pick] > best[c - 1]:
                best[c], took[c] = each[pick], first[c] + pick
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + gap:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                column[took[c]] += 1
                c -= sizes[took[c]]
        used = np.nonzero(column)[0]
        move = (inverse[:, used] * column[used]).sum(axis=1)
        ratio = np.divide(amount, move, out=np.full(k, np.inf), where=move > 1e-9)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        if step % 64 == 63:
            inverse = inverted(basis)
            amount = np.maximum((inverse * need).sum(axis=1), 0)
        else:
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
            taken = ratio[out]
            amount = np.maximum(amount - move * taken, 0)
            amount[out] = taken
    return [(basis[:, j].astype(int), float(amount[j])) for j in range(k)]


def substituted(hist: dict[int, int], capacity: int, k: int, small_part: int) -> list[Bins]:
    """Sequences by the rounded-down linear program, with actual lengths in the places of the rounded ones."""
    groups, out = groups_of(hist, capacity // small_part, k), []
    if not groups:
        return out
    runs = [[[s, hist[s]] for s in g] for g in groups]
    for copies, x in configurations([g[0] for g in groups], [sum(hist[s] for s in g) for g in groups], capacity):
        count = min([int(x + 1e-6), *(sum(n for _, n in runs[g]) // c for g, c in enumerate(copies) if c)])
        whole = [Bins(count, capacity)] if count else []
        for g in (g for g, c in enumerate(copies) for _ in range(c)):
            parts = []
            for b in whole:  # in each slot the next ones of the group, longest first
                while b.count:
                    head = b.split(min(runs[g][0][1], b.count))
                    head.add(runs[g][0][0])
                    runs[g][0][1] -= head.count
                    if not runs[g][0][1]:
                        runs[g].pop(0)
                    parts.append(head)
            whole = parts
        out += whole
    return out


def best_fitted(hist: dict[int, int], kept: list[Bins], capacity: int) -> list[Bins]:
    """``kept`` and the other pieces of ``hist``, longest first, each where the least sufficient room is."""
    left, opened, done, rooms = dict(hist), [[] for _ in range(capacity + 1)], [], 0

    def keep(b: Bins) -> None:
        nonlocal rooms
        if b.count and b.room:
            opened[b.room].append(b)
            rooms |= 1 << b.room  # a bit for each room that some sequence has
        elif b.count:
            done.append(b)

    for b in kept:
        for s in b.lengths:
            left[s] -= b.count
        keep(Bins(b.count, b.room, b.lengths))
    for s in sorted(left, reverse=True):
        while left[s]:
            if fit := rooms >> s:
                room = s + (fit & -fit).bit_length() - 1
                b = opened[room].pop()
                if not opened[room]:
                    rooms ^= 1 << room
                each = min(room // s, left[s])
                head = b.split(min(b.count, left[s] // each))
                keep(b)
            else:
                each = min(capacity // s, left[s])
                head = Bins(left[s] // each, capacity)
            head.add(s, each)
            left[s] -= each * head.count
            keep(head)
    return done + [b for bs in opened for b in bs]


def plan(hist: dict[int, int], capacity: int = CAPACITY, k: int = GROUPS, small_part: int = SMALL_PART) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, number, first sequence, offset) that place every piece; ranks of a length run from 0."""
    configured = substituted(hist, capacity, k, small_part)
    each = [best_fitted(hist, [b for b in configured if b.room <= slack], capacity) for slack in (capacity, *SLACKS)]
    rows, base, used = [], 0, dict.fromkeys(hist, 0)
    for b in min(each, key=lambda bins: sum(b.count for b in bins)):
        offset = 0
        for s in b.lengths:
            rows.append((s, used[s], b.count, base, offset))
            used[s] += b.count
            offset += s
        base += b.count
    return sorted(rows)


# ---------------------------------------------------------------- the operator


def ranked(parts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``parts`` with ``rank_``: 0.. within its length. Hashed buckets spread a frequent length."""
    placed = parts.withColumn("bucket_", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("length", "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy("length").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("first_"))
    within = Window.partitionBy("length", "bucket_").orderBy("doc_id", "piece", "start", "ids_crc32")
    rows = placed.withColumn("row_", F.row_number().over(within) - 1)
    return rows.join(starts, ["length", "bucket_"]).withColumn("rank_", F.col("first_") + F.col("row_")).drop("bucket_", "row_", "first_")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS, with_ids: bool = False, path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    parts = staged(pieces(docs, capacity, end_id, with_ids, path), "pieces")
    hist = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = np.array(plan(hist, capacity, groups), dtype="i8").reshape(-1, 5)

    def place(batches):
        key = rows[:, 0] << 44 | rows[:, 1]
        for pdf in batches:
            rank = pdf.pop("rank_").to_numpy()
            at = np.searchsorted(key, pdf["length"].to_numpy().astype("i8") << 44 | rank, side="right") - 1
            pdf["sequence_id"] = rows[at, 3] + rank - rows[at, 1]
            pdf["offset"] = rows[at, 4]
            yield pdf

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return ranked(parts).select(*names, "rank_").mapInPandas(place, SCHEMA + ", ids array<long>" * with_ids + ", sequence_id long, offset long")
