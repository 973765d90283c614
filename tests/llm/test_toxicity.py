import math
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from braid.llm import toxicity as op
from tests.llm import fixtures as fx

G = op.Grammar(words={"idiot": 4.0}, stems={"morono": 4.0})


@pytest.mark.parametrize("clause, matches", [
    ("what an idiot this is", {"insult": 1}),
    ("you are an idiot", {"directed": 1}),
    ("you said she is a moronostic", {"reported": 1}),
    ("he is not an idiot", {"negated": 1}),
    ("not that there was ever any idiot", {"insult": 1}),
    ("i will kill you", {"aimed": 1}),
    ("we kill the lights", {}),
    ("never kill them", {"negated": 1}),
    ("moronos", {"insult": 1}),
    ("monotone words only", {}),
])
def test_grammar(clause, matches):
    assert Counter(k for k, _ in G.machine.read((w, G.symbol(w)) for w in op.WORD.findall(clause))) == Counter(matches)


def plain_matches(symbols):
    """What the rules of the docstring say of each word, found by looking back over the clause."""

    def hushed(i):
        if "negation" in symbols[max(0, i - op.REACH) : i]:
            return "negated"
        return "reported" if "speech" in symbols[:i] else None

    out = []
    for i, s in enumerate(symbols):
        before = symbols[max(0, i - op.REACH) : i]
        if s in ("insult", "threat") and hushed(i):
            out.append(hushed(i))
        elif s == "insult":
            out.append("directed" if "target" in before else "insult")
        elif s == "target":
            since = max((j for j in range(i) if symbols[j] == "target"), default=-1)
            if any(symbols[j] == "threat" and not hushed(j) for j in range(max(since + 1, i - op.REACH), i)):
                out.append("aimed")
    return out


def test_machine_equals_the_rules_on_all_short_clauses():
    kinds = ("insult", "threat", "target", "negation", "speech", "other")
    for n in range(1, 7):
        for symbols in product(kinds, repeat=n):
            assert [k for k, _ in G.machine.read((s, s) for s in symbols)] == plain_matches(symbols), symbols


def test_score_equals_plain_sum():
    g = op.Grammar({"idiot": 4.0, "fool": 2.5}, {"morono": 3.0}, {"bias": -2.0, "directed": 1.5, "negated": -0.5})
    weights = {"insult": [2.5], "directed": [4.0, 4.0], "negated": [4.0], "reported": [3.0], "aimed": [op.THREAT_WEIGHT]}
    text = "You idiot, you idiot. A fool fool; he is not an idiot! They said moronostic things\nWe will kill you"
    want = g.factors["bias"] + sum(g.factors[k] * sum(w) for k, w in weights.items())
    assert math.isclose(g.score(g.clauses(text)), 1 / (1 + math.exp(-want)))
    many = g.sums(g.clauses("you idiot. " * 9))
    assert many["directed"] == op.CEILING and g.score([]) == 1 / (1 + math.exp(2.0))


def test_clauses_not_words():
    whole = G.clauses("He wrote to me, you idiot. Nothing more\nnot an idiot; fine")
    assert whole == [("you idiot", [("directed", "idiot")]), ("not an idiot", [("negated", "idiot")])]
    assert G.score(G.clauses("you idiot")) > 0.7 > G.score(G.clauses("he is not an idiot")) > G.score([])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    g = op.fit(docs, labels, op.bucket(F.col("doc_id")) != 1)
    got = op.score_documents(docs, g).join(labels, "doc_id").filter(op.bucket(F.col("doc_id")) == 1).select("toxic", "predicted").collect()
    n = Counter((r["toxic"], r["predicted"]) for r in got)
    # at sf0.01 some languages have too few toxic rows to learn from
    assert n[0, 1] <= 0.015 * n[0, 0] and n[1, 1] >= (0.7 if sf == "sf0.01" else 0.85) * (n[1, 1] + n[1, 0]), (n, g.words, g.stems, g.factors)
    print(n, g.words, g.stems, g.factors)


def test_hard_cases(spark):
    df = fx.with_extra(fx.hard(spark))
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    g = op.fit(df, empty)
    assert op.score_documents(df, g).count() == 10 and op.clean_documents(df, g).columns == df.columns
    assert all(r["predicted"] == 0 and 0 < r["score"] < 0.1 for r in op.score_documents(df, g).collect())
    assert op.score_documents(df.limit(0), g).count() == 0 and op.clean_documents(df.limit(0), g).count() == 0
    g = op.fit(df, spark.createDataFrame([(1, 1, 1), (7, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int"))
    assert op.score_documents(df, g).count() == 10
