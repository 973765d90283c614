import math
from collections import Counter, defaultdict

import pytest

from braid.llm import kn_quality as op
from tests.llm import fixtures as fx


def model(texts):
    """p(text[i] | before) of a plain interpolated modified Kneser-Ney model."""
    counts = {4: Counter()}
    for t in texts:
        s = "\x01" * 3 + t
        counts[4].update(s[i - 3 : i + 1] for i in range(3, len(s)))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc, ctx = {}, {}
    for k in counts:
        n = Counter(counts[k].values())
        d = []
        for i in (1, 2, 3):
            ok = n[1] and n[i]
            d.append(min(max(i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i], 0.1), i) if ok else 0.75)
        disc[k] = d
        ctx[k] = defaultdict(list)
        for g, c in counts[k].items():
            ctx[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        if g[:-1] not in ctx[k]:
            return p(g[1:])
        cs, d = ctx[k][g[:-1]], disc[k]
        off = sum(d[min(c, 3) - 1] for c in cs)
        c = counts[k][g]
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / sum(cs) + off / sum(cs) * p(g[1:])

    return p


def perplexity(p, text):
    s = "\x01" * 3 + text
    return math.exp(-sum(math.log(p(s[i - 3 : i + 1])) for i in range(3, len(s))) / len(text))


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("limit", [op.BROADCAST_GRAMS, 0])
def test_equals_brute_force(spark, limit):
    rows = [(1, "the cat sat on the mat, the end", "en"), (2, "a cat and a hat on the table", "en"), (3, "le chat est là-bas sur la table", "fr"), (4, "the hat of the cat", "en"), (5, "xqzzy 中文 !!", "en"), (6, "sur la table 🙂", "fr"), (7, "no model", "de"), (8, "", "en"), (9, None, "en"), (10, "texts without language", None)]
    df = fx.docs(spark, [(*r, "s") for r in rows])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 0, 0), (None, 1, 0), (77, 1, 1), (5, None, None)], LABELS)
    got = {r["doc_id"]: r for r in op.score_documents(df, labels, broadcast_grams=limit, broadcast_labels=limit, block_bytes=60).collect()}
    models = {"en": model([rows[0][1], rows[1][1]]), "fr": model([rows[2][1]])}
    for i, text, lang in rows:
        want = perplexity(models[lang], text.replace("🙂", "￿")) if text and lang in models else None
        assert got[i]["perplexity"] == (pytest.approx(want, rel=1e-4) if want else None), (i, text)
    assert got[1]["kept"] and not got[5]["kept"] and got[7]["kept"] and got[10]["kept"] and not got[8]["kept"] and not got[9]["kept"]


def test_keeps_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = op.score_documents(docs, labels).join(labels, "doc_id").select("quality", "kept").collect()
    n = Counter((r["quality"], r["kept"]) for r in got)
    print(n)
    assert n[1, True] >= 0.985 * (n[1, True] + n[1, False]) and n[0, False] > 0


def test_rejects_bad_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    n = Counter(r["kept"] for r in op.score_documents(docs, labels).join(labels.filter("quality = 0"), "doc_id").select("kept").collect())
    assert n[False] >= 0.92 * (n[True] + n[False])


def test_hard_cases(spark):
    df = fx.with_extra(fx.hard(spark))
    assert op.score_documents(df, spark.createDataFrame([(7, 1, 0)], LABELS)).count() == 10
    assert op.score_documents(df, spark.createDataFrame([], LABELS)).count() == 10
    assert op.score_documents(df.limit(0), spark.createDataFrame([], LABELS)).count() == 0
