"""Operator 3: n-gram Jaccard self-join by chosen paths.

Documents are sets of five-word shingles; a link joins two documents whose sets have a Jaccard similarity of 0.8 or more.

1. Documents with equal sets form one node (copies need no comparison). A node has 64 min-hash coordinates.
2. Chosen paths: all nodes start at the root of each run. At a tree node every coordinate is sampled with probability
   1 / (similarity * coordinates), the same for all that are there, and splits them by its value. Buckets of up to
   ``LIMIT`` are leaves; larger ones are split again, ``DEPTH`` levels and more (with each path forked, which keeps the
   recall) as long as the pairs in large buckets are too many and splitting makes them fewer; what is still large then is
   alike throughout and compared in blocks, so that no bucket is capped. As many runs are made as the target recall asks
   for at ``DEPTH`` levels.
3. Leaves are compared by brute force on the coordinates (estimated similarity within four standard errors of 0.8 or
   above), which gives each connected node of a leaf an edge to the least one, never all pairs.
4. The connected components of these are candidate clusters. Only their sets are made again, sent once to their cluster,
   and compared exactly, in blocks where a cluster is large. A block returns the link counts of its nodes and such
   edges for its links; the components of those are the classes.

Scale: shuffles carry 16 bytes for a node and path, 264 for a node of a leaf, and texts only once. Comparing a cluster in
blocks costs the square of its number of *different* sets, as every link between different texts counts; it is dealt
over tasks of at most ``BLOCK`` by ``BLOCK``.

Words are runs of bytes other than ASCII white space, compared as they are. Defined results: texts without words (null,
empty, blank) link to nothing and are classes of their own; texts of one to four words have one shingle, all of them;
repeated rows and copies are links of each other; null doc_id is allowed; an empty table gives an empty result; further
columns are ignored by ``link_documents`` and pass through ``distinct_documents``, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.llm.common import staged

SIMILARITY = 0.8
WORDS = 5
COORDINATES = 64
LIMIT = 64
DEPTH = 3
RECALL = 0.99
BLOCK = 256
#: Beyond DEPTH levels large buckets are split again, each path in two, while brute force over them would compare more
#: than this number of pairs for each node of the table and a further level still made it less.
COMPARES = 2_000
HOT_KEYS = 1000
BROADCAST_ROWS = 500_000
SEED = 0x5EED
MEMO = 400_000

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def runs_for(recall: float, depth: int, similarity: float, coordinates: int) -> int:
    """Runs after which a pair at the threshold shares a leaf with that probability, if all leaves are at ``depth``."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - p / coordinates) ** coordinates
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode().split()
        if not found:
            return np.zeros(0, U)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(found):
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, found), U, len(found))
        k = min(self.words, len(h))
        out = np.zeros(len(h) - k + 1, U)
        for i in range(k):
            out = out * U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        return np.unique(mix(out + U(k)))


class Sketcher:
    def __init__(self, coordinates: int = COORDINATES, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.a = r.integers(1, 2**63, coordinates, dtype=U) * U(2) + U(1)
        self.b = r.integers(0, 2**63, coordinates, dtype=U)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 2**64 - 1, U)
        for at in range(0, len(s), 2048):
            x = s[at : at + 2048, None] * self.a
            x += self.b
            np.minimum(low, x.min(axis=0), out=low)
        return (low >> U(32)).astype("<u4")


def _long(x: np.ndarray) -> np.ndarray:
    return x.view("i8")


# ---------------------------------------------------------------- nodes


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, node (hash of the set; null without words), sketch."""

    def run(batches):
        shingles, sketch = Shingler(), Sketcher()
        for pdf in batches:
            nodes, sketches = [], []
            for text in pdf["text"]:
                s = shingles(text)
                nodes.append(int(np.int64(U(xxhash.xxh3_64_intdigest(s.tobytes())).astype("i8"))) if len(s) else None)
                sketches.append(sketch(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "tkey": pdf["tkey"], "node": pd.array(nodes, "Int64"), "sketch": sketches})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tkey"))
    return staged(keyed.mapInPandas(run, "doc_id long, tkey long, node long, sketch binary"), "described")


def _table(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), "<u4").reshape(len(sketches), -1)


# ---------------------------------------------------------------- chosen paths


def _children(rows: DataFrame, similarity: float, runs: int | None = None, forks: int = 1) -> DataFrame:
    """(path, node) one level below ``rows`` (node, sketch, path), or below the roots of ``runs``; each path ``forks`` times."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            t, node = _table(list(pdf["sketch"])), pdf["node"].to_numpy()
            k = t.shape[1]
            below = U(int(2**64 / (similarity * k)))
            each = mix(np.arange(1, k + 1, dtype=U) * U(0x9E3779B97F4A7C15))
            paths = [pdf["path"].to_numpy().view(U) + U(f) * U(0xA24BAED4963EE407) for f in range(forks)] if runs is None else [np.full(len(pdf), mix(np.array([r + 1], U))[0]) for r in range(runs)]
            for p in paths:
                for at in range(0, len(p), 4096):
                    q = mix(p[at : at + 4096, None] ^ each)
                    i, c = np.nonzero(q < below)
                    yield pd.DataFrame({"path": _long(mix(q[i, c] + t[at + i, c].astype(U) * U(0xD6E8FEB86659FD93))), "node": node[at + i]})

    return rows.mapInPandas(run, "path long, node long")


def _blocks(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """``rows`` with ``i_`` and ``j_``: each row goes to the blocks that compare it, one if its group fits in one.

    A row of block b meets each other block once, in (b, j) or (i, b); in (i, j) its side is b = i or b = j.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    out = rows.withColumn("n_", n).withColumn("own_", own).withColumn("with_", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)))
    return out.withColumn("i_", F.least("own_", "with_")).withColumn("j_", F.greatest("own_", "with_")).drop("n_", "with_")


def _grouped(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of a key lie together and in order; the keys are hashed to many partitions."""
    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)


def _runs_of(batches, keys: list[str]):
    """Data frames of whole groups: all complete groups of a batch at once."""
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        k = pdf[keys].to_numpy()
        last = np.nonzero((k != k[-1]).any(axis=1))[0]
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = pdf.iloc[cut:].reset_index(drop=True)
        if cut:
            yield pdf.iloc[:cut]
    if rest is not None and len(rest):
        yield rest


class Forest:
    """Connected nodes. A tree is known by its least node, so that the same group gives the same edges in every bucket."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        """(least node of its tree, node) of every other node."""
        return [(self.root(x), x) for x in list(self.up)]


def _close(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of a and b agree in that share of the coordinates."""
    same = np.zeros((len(a), len(b)), np.int16)
    for c in range(a.shape[1]):
        same += a[:, c, None] == b[None, :, c]
    return same >= least * a.shape[1]


def _leaf_edges(rows: DataFrame, least: float) -> DataFrame:
    """(u, v): edges to the least node that connect the close pairs of each leaf block (path, i_, j_)."""
    keys = ["path", "i_", "j_"]

    def run(batches):
        for pdf in _runs_of(batches, keys):
            k = pdf[keys].to_numpy()
            starts = np.concatenate([[0], np.nonzero((k[1:] != k[:-1]).any(axis=1))[0] + 1, [len(k)]])
            t, node, own = _table(list(pdf["sketch"])), pdf["node"].to_numpy(), pdf["own_"].to_numpy()
            sizes = np.diff(starts)
            found: list[tuple[int, int]] = []
            two = starts[:-1][sizes == 2]  # most leaves
            ok = two[(t[two] == t[two + 1]).mean(axis=1) >= least] if len(two) else two
            found += zip(node[ok].tolist(), node[ok + 1].tolist(), strict=True)
            for s, n in zip(starts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
                a, i, j = slice(s, s + n), k[s, 1], k[s, 2]
                left, right = (node[a], node[a]) if i == j else (node[a][own[a] == i], node[a][own[a] == j])
                hit = _close(t[a], t[a], least) if i == j else _close(t[a][own[a] == i], t[a][own[a] == j], least)
                f = Forest()
                for x, y in zip(*np.nonzero(np.triu(hit, 1) if i == j else hit), strict=True):
                    f.join(int(left[x]), int(right[y]))
                found += f.edges()
            if found:
                yield pd.DataFrame(found, columns=["u", "v"])

    return _grouped(rows, keys, ["node", "own_", "sketch"]).mapInPandas(run, "u long, v long")


def candidate_edges(nodes: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, depth: int = DEPTH, limit: int = LIMIT, compares: int = COMPARES) -> DataFrame:
    """(u, v) edges whose components hold every linked pair with the target recall; nodes: (node, sketch), staged."""
    least = similarity - 4 * math.sqrt(similarity * (1 - similarity) / COORDINATES)
    level, edges, total, before, d = staged(_children(nodes, similarity, runs_for(recall, depth, similarity, COORDINATES)), "paths"), [], nodes.count(), math.inf, 1
    while True:
        counts = level.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sized = staged(level.join(counts, "path"), "buckets")
        large = sized.filter(F.col("size") > limit)
        pairs = (large.agg(F.sum("size")).first()[0] or 0) / 2 if d >= depth else math.inf
        last = d >= depth and (pairs <= compares * total or pairs > 0.7 * before)
        leaf = sized if last else sized.filter(F.col("size") <= limit)
        edges.append(_leaf_edges(_blocks(leaf.join(nodes, "node"), "path", "size", BLOCK), least))
        if last:
            break
        level = staged(_children(large.join(nodes, "node"), similarity, forks=1 if d < depth else 2), "paths")
        before, d = pairs, d + 1
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return staged(out.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u != v").distinct(), "candidates")


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of each node that has an edge; staged.

    Each round takes the least label of the neighbours, then the label's own label; rounds end when nothing changes.
    """
    both = staged(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = staged(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("root")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("near"))
        upper = labels.select(F.col("node").alias("near"), F.col("root").alias("far"))
        new = staged(near.join(upper, "near").select("node", "old", F.least("near", "far").alias("root")), "labels")
        labels = new.select("node", "root")
        if new.filter("old != root").isEmpty():
            return labels


# ---------------------------------------------------------------- exact links


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the sets of a with those of b, by products of blocks of shared members."""
    one = a is b
    every = np.concatenate(a if one else [*a, *b])
    names, code, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times > 1
    new = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(a) if one else len(a) + len(b)), [len(x) for x in (a if one else [*a, *b])])
    keep = shared[code]
    code, owner = new[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(a), len(b)), np.float32)
    width = int(shared.sum())
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(code, [at, at + 4096])
        m = np.zeros((len(a) if one else len(a) + len(b), min(4096, width - at)), np.float32)
        m[owner[lo:hi], code[lo:hi] - at] = 1
        out += m @ m.T if one else m[: len(a)] @ m[len(a) :].T
    return out


def _links(rows: DataFrame, similarity: float) -> DataFrame:
    """Exact links of each block (cluster, i_, j_): rows (u, v, links), v null for a node's count of linked documents."""
    keys = ["cluster", "i_", "j_"]

    def run(batches):
        shingles = Shingler()
        for pdf in _runs_of(batches, keys):
            for (_, i, j), g in pdf.groupby(keys, sort=False):
                g = g.drop_duplicates("node")
                sets = [shingles(x) for x in g["text"]]
                node, copies, own = g["node"].to_numpy(), g["copies"].to_numpy(), g["own_"].to_numpy()
                size = np.array([len(s) for s in sets], float)
                left, right = (np.arange(len(g)),) * 2 if i == j else (np.nonzero(own == i)[0], np.nonzero(own == j)[0])
                if not len(left) or not len(right):
                    continue
                a = [sets[x] for x in left]
                common = _common(a, a if i == j else [sets[x] for x in right])
                hit = common >= similarity * (size[left][:, None] + size[right][None, :] - common) - 1e-6
                if i == j:
                    np.fill_diagonal(hit, False)
                counts = np.zeros(len(g), "i8")
                counts[left] += hit @ copies[right]
                if i != j:
                    counts[right] += hit.T @ copies[left]
                f = Forest()
                for x, y in zip(*np.nonzero(np.triu(hit) if i == j else hit), strict=True):
                    f.join(int(node[left[x]]), int(node[right[y]]))
                out = [(u, v, 0) for u, v in f.edges()]
                out += [(int(node[x]), None, int(counts[x])) for x in np.nonzero(counts)[0]]
                yield pd.DataFrame({c: pd.array([r[k] for r in out], "Int64") for k, c in enumerate(("u", "v", "links"))})

    return _grouped(rows, keys, ["node", "own_", "copies", "text"]).mapInPandas(run, "u long, v long, links long")


def _attached(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``table``, which has a row for each key and the number ``n_`` of its rows among ``total``.

    Fewer than ``HOT_KEYS`` keys can hold more than a share of 1 / HOT_KEYS of the rows: those are broadcast, so that no
    hot key meets in one task. Rows without a key meet nothing and are not shuffled.
    """
    hot = F.broadcast(table.filter(F.col("n_") * HOT_KEYS > total).withColumn("hot_", F.lit(True)))
    rest = table.filter(F.col("n_") * HOT_KEYS <= total).withColumn("hot_", F.lit(False))
    met = rows.filter(F.col(key).isNotNull()).join(hot, key, "left")
    plain = met.filter(F.col("hot_").isNull()).select(*rows.columns).join(rest, key, "left")
    out = met.filter("hot_").unionByName(plain).unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)
    return out.drop("n_", "hot_")


def _members(docs: DataFrame, similarity: float, recall: float) -> DataFrame:
    """doc_id, tkey, class_id, rep (doc_id and tkey of the first of its class), n_links of every document.

    All but doc_id and tkey is null without links or copies.
    """
    described = _described(docs)
    worded = described.filter(F.col("node").isNotNull())
    nodes = staged(worded.groupBy("node").agg(F.min(F.struct("doc_id", "tkey")).alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("sketch").alias("sketch")), "nodes")
    near = components(candidate_edges(nodes.select("node", "sketch"), similarity, recall))
    sizes = near.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    wanted = near.join(sizes, "root").join(nodes.select("node", "rep", "copies"), "node").select("node", F.col("root").alias("cluster"), "size", "copies", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tkey").alias("tkey"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tkey"))
    found = texts.join(wanted, (texts["tkey"] == wanted["tkey"]) & texts["doc_id"].eqNullSafe(wanted["rep_id"])).select("cluster", "size", "node", "copies", "text")
    exact = staged(_links(_blocks(found, "cluster", "size", BLOCK), similarity), "links")
    roots = components(exact.filter(F.col("v").isNotNull()).select("u", "v"))
    counts = exact.filter(F.col("v").isNull()).groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.select("node", "rep", "least", "copies").join(roots, "node", "left").join(counts, "node", "left")
    named = named.select("node", F.coalesce("root", "node").alias("root"), "rep", "least", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = staged(named.filter("n_links > 0"), "linked")
    classes = linked.groupBy("root").agg(F.min("rep").alias("rep"), F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n_"))
    classed = _attached(linked.select("node", "root", "n_links", "copies"), classes, "root", linked.count())
    classed = staged(classed.select("node", "class_id", "rep", "n_links", F.col("copies").alias("n_")), "classes")
    return _attached(described.select("doc_id", "tkey", "node"), classed, "node", described.count()).drop("node")


def link_documents(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row for each document: doc_id, class_id (the least doc_id of its class), n_links (documents it links to)."""
    linked = F.col("n_links").isNotNull()
    return _members(docs, similarity, recall).select("doc_id", F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def distinct_documents(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The documents in their own columns, one of each class: the one with the least (doc_id, hash of its text)."""
    members = _members(docs, similarity, recall).filter(F.col("n_links").isNotNull())
    first = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("tkey") == F.col("rep.tkey"))
    # what becomes of the rows of a (doc_id, text): they go, or one of several repeated rows stays
    acts = members.groupBy("doc_id", "tkey").agg(F.bool_or(~first).alias("goes"), F.count(F.lit(1)).alias("times")).filter("goes OR times > 1")
    acts = staged(acts.select(F.col("doc_id").alias("id_"), F.col("tkey").alias("tkey_"), "goes"), "acts")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tkey"))  # a row's own columns cannot clash in its struct
    same = rows["id"].eqNullSafe(acts["id_"]) & (rows["tkey"] == acts["tkey_"])
    kept = rows.join(acts, same, "left_anti").select("row")
    repeated = acts.filter("NOT goes")
    if n := repeated.count():
        one = rows.join(F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated, same).dropDuplicates(["id", "tkey"])
        kept = kept.unionByName(one.select("row"))
    return kept.select("row.*")
