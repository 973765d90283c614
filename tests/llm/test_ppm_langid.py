import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from braid.llm import ppm_langid as op
from tests.llm import fixtures as fx


def brute(texts, text):
    """Code length of a text, byte by byte along the context tree."""
    tree = defaultdict(Counter)
    for t in texts:
        b = op._bytes(t).tobytes()
        for i in range(3, len(b)):
            for k in range(4):
                tree[b[i - k : i]][b[i]] += 1
    b, bits = op._bytes(text).tobytes(), 0.0
    for i in range(3, len(b)):
        for k in range(3, -2, -1):
            if k < 0:
                bits += 8
                break
            if (seen := tree.get(b[i - k : i])) is None:
                continue
            n, d = sum(seen.values()), len(seen)
            if b[i] in seen:
                bits += math.log2((n + d) / seen[b[i]])
                break
            bits += math.log2((n + d) / d)
    return bits


def test_code_lengths_are_exact(monkeypatch):
    corpora = {"a": ["the cat sat on the mat", "ünder the täble", "x"], "b": ["le chat est sur la table", "où est-il?"], "c": ["zz zz zzz"]}
    m = op.Model({k: op.Tree(v) for k, v in corpora.items()})
    texts = ["the table", "le chät 中文", "q", "", "zz the chat sur lä mat", "abc" * 50]
    for chunk in (op.CHUNK, 5):
        monkeypatch.setattr(op, "CHUNK", chunk)
        bits, sizes = m.lengths(texts)
        for i, t in enumerate(texts):
            assert sizes[i] == len(t.lower().encode())
            assert np.allclose(bits[i], [brute(corpora[k], t) for k in "abc"], atol=1e-3), (chunk, t)


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = op.fit(docs, op.bucket(F.col("doc_id")) != 1)
    got = op.identify(docs, m).join(docs.select("doc_id", "lang"), "doc_id").filter(op.bucket(F.col("doc_id")) == 1).collect()
    right = sum(r["lang"] == r["lang_pred"] for r in got)
    print(right, len(got), [(r["doc_id"], r["lang"], r["lang_pred"], r["score"]) for r in got if r["lang"] != r["lang_pred"]])
    assert right >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_a_language_of_few_long_documents_is_learned(spark):
    long = [(i, f"der lange text nummer {i} " * 400, "de", "s") for i in range(3)]
    docs = fx.docs(spark, [*long, *[(10 + i, f"a short text number {i}", "en", "s") for i in range(50)]])
    m = op.fit(docs, train_bytes=200)
    assert m.langs == ["de", "en"]


def test_ids_do_not_matter_and_bytes_are_bounded(spark):
    rows = [(None, f"a short english text number {i}", "en", "s") for i in range(3000)] + [(7, f"ein langer deutscher text {i} " * 300, "de", "s") for i in range(6)]
    rows += [(None, "toujours le même texte en français", "fr", "s")] * 3000  # copies teach once
    docs, taken = fx.docs(spark, rows), {}
    tree = op.Tree
    op.Tree = lambda texts: taken.setdefault(texts[0], texts) and tree(texts)
    try:
        m = op.fit(docs, train_bytes=2000)
    finally:
        op.Tree = tree
    assert m.langs == ["de", "en", "fr"] and sorted(map(len, taken.values()))[:2] == [1, 1]
    assert all(sum(map(len, x[:-1])) < 2000 for x in taken.values())
    assert m.predict(["der deutsche text", "the english text", "le même texte"])[0] == ["de", "en", "fr"]


def test_hard_cases(spark):
    df = fx.with_extra(fx.hard(spark))
    m = op.fit(df)
    got = {(r["doc_id"], r["lang_pred"]) for r in op.identify(df, m).collect()}
    assert op.identify(df, m).count() == 10 and {(1, "und"), (2, "und"), (3, "und"), (5, "en")} <= got
    assert op.identify(df.limit(0), m).count() == 0
    none = op.fit(df.limit(0))
    assert {r["lang_pred"] for r in op.identify(df, none).collect()} == {"und"}
