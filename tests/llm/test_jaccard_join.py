import random
from collections import defaultdict

from braid.llm import jaccard_join as op
from tests.llm import fixtures as fx


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc position -> (class, links)."""
    sets = [shingles(t) for _, t in rows]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            c = len(s & sets[j])
            if 10 * c >= 8 * (len(s) + len(sets[j]) - c):
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    return sorted((d, min(ids[root(i)]), links[i]) for i, (d, _) in enumerate(rows))


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    return brute(rows), sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in op.link_documents(df).collect())


def test_documents(spark):
    want, got = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert got == want and sum(n for *_, n in want) > 100


def test_groups_and_blocks(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    line = " ".join(f"common{i}" for i in range(12))
    rows = []
    for i in range(700):  # one large group of near copies: over the limit of a bucket and of a block
        w = list(base)
        w[rng.randrange(len(w))] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, line + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(60))) for i in range(300)]
    rows += [(2000 + i, "exact copy of a text with several words in it") for i in range(30)]
    want, got = check(fx.docs(spark, rows))
    assert got == want


def test_one_of_each_class_stays(spark):
    text = " ".join(f"a{i}" for i in range(80))
    rows = [(3, text), (1, text + " more"), (1, text + " more"), (2, "alone here in this corpus"), (4, None), (5, ""), (6, None)]
    df = fx.with_extra(fx.docs(spark, rows))
    kept = op.distinct_documents(df)
    out = kept.collect()
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in out) == [1, 2, 4, 5, 6]
    assert all(r[c] == "clash" for r in out for c in fx.EXTRA)


def test_deeper_levels_keep_the_links(spark, monkeypatch):
    rng = random.Random(9)
    shared = [f"s{k}" for k in range(40)]  # all texts share much, and pairs of them nearly all
    rows = []
    for i in range(250):
        own = [f"o{rng.randrange(10**6)}" for _ in range(25)]
        rows += [(2 * i, " ".join(shared + own)), (2 * i + 1, " ".join(shared + own + ["end"]))]
    monkeypatch.setattr(op.candidate_edges, "__defaults__", (op.SIMILARITY, op.RECALL, 1, 4, 0))
    want, got = check(fx.docs(spark, rows))
    linked = sum(n > 0 for *_, n in want)
    assert linked == 500 and sum(n > 0 for *_, n in got) >= 0.97 * linked


def test_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 1 if i % 3 else i if i % 2 else None) for i in range(60)], "i int, k int")
    table = rows.filter("k is not null").groupBy("k").count().selectExpr("k", "count AS n_", "k * 10 AS v")
    for hot in (1, 2, 1000):
        monkeypatch.setattr(op, "HOT_KEYS", hot)
        got = {(r["i"], r["k"], r["v"]) for r in op._attached(rows, table, "k", 60).collect()}
        assert got == {(r["i"], r["k"], r["k"] and r["k"] * 10) for r in rows.collect()}


def test_hard_cases(spark):
    df = fx.with_extra(fx.hard(spark))
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in op.link_documents(df).collect()}
    assert {(7, 7, 1), (1, 1, 0), (2, 2, 0), (None, None, 0)} <= got
    assert op.link_documents(df).count() == 10 and op.distinct_documents(df).count() == 9
    assert op.link_documents(df.limit(0)).count() == 0 and op.distinct_documents(df.limit(0)).count() == 0
