import re
from collections import Counter

from braid.llm import line_quality as op
from tests.llm import fixtures as fx


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_base_counts_equal_brute_force(spark):
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (whole, fx.hard(spark)):
        texts = sorted(((r["doc_id"] is None, r["doc_id"] or 0), brute(r["text"])) for r in df.collect())
        got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in op.score_documents(df).collect())
        assert got == texts


def corpus(spark):
    body = lambda i: "\n".join(" ".join(f"w{i}x{j}x{k}" for k in range(20)) for j in range(4))
    footers = [f"Buy   item{k} at OUR shop{k}" for k in range(12)]
    rows = [(i, "\n".join([*footers, body(i)]), "en", "a" if i % 3 else "b") for i in range(60)]
    rows += [(100 + i, "\n".join([f"u{i} v{i}", *footers]).lower(), "en", "a") for i in range(3)]
    rows += [(200 + i, body(999), "en", "a") for i in range(40)]  # copies of one clean text
    return fx.docs(spark, rows)


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    df = fx.with_extra(corpus(spark))
    got = {r["doc_id"]: r for r in op.score_documents(df).collect()}
    assert all(got[i]["kept"] and got[i]["removed_words"] == 60 for i in range(60))
    assert all(not got[100 + i]["kept"] and got[100 + i]["removed_lines"] == 12 and not got[100 + i]["base_failed"] for i in range(3))
    assert all(got[200 + i]["kept"] and got[200 + i]["removed_words"] == 0 for i in range(40))
    clean = {r["doc_id"]: r for r in op.clean_documents(df).collect()}
    assert op.clean_documents(df).columns == df.columns and all(r[c] == "clash" for r in clean.values() for c in fx.EXTRA)
    assert sorted(clean) == sorted([*range(60), *range(200, 240)])
    assert "shop" not in clean[5]["text"] and clean[5]["n_chars"] == len(clean[5]["text"])
    assert clean[200]["text"].startswith("w999x0x0")


def test_a_large_host_does_not_raise_the_limit(spark):
    lines = lambda i: ["subscribe to our letter"] * (i < 11) + ["seen ten times"] * (i < 10)
    df = fx.docs(spark, [(i, "\n".join([f"text {i} alone", *lines(i)]), "en", "a") for i in range(1500)])
    got = {r["doc_id"]: r["removed_words"] for r in op.score_documents(df).collect()}
    assert got == {i: 4 * (i < 11) for i in range(1500)}


def test_shuffled_join_gives_the_same(spark):
    a = op.score_documents(corpus(spark)).collect()
    b = op.score_documents(corpus(spark), broadcast_lines=0).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_hard_cases(spark):
    df = fx.with_extra(fx.hard(spark))
    assert op.score_documents(df).count() == 10
    assert op.clean_documents(df).columns == df.columns
    assert op.score_documents(df.limit(0)).count() == 0 and op.clean_documents(df.limit(0)).count() == 0
