import itertools
import random

from braid.llm import decontam as op
from tests.llm import fixtures as fx


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(text, items):
    """Items that some window of aligned words shows, without seeds."""
    w, out = op.WORD.findall((text or "").lower()), set()
    for item_id, t in items:
        its = op.WORD.findall((t or "").lower())
        size = min(op.WINDOW, len(its))
        if len(its) < op.LEAST_WORDS:
            continue
        for p in range(len(w) - size + 1):
            for q in range(len(its) - size + 1):
                if sum(w[p + i] == its[q + i] for i in range(size)) >= size - op.tolerated(size):
                    out.add(item_id)
    return out


def test_masks_survive_all_tolerated_substitutions():
    for n in range(op.LEAST_WORDS, op.WINDOW + 1):
        for gone in itertools.combinations(range(n), op.tolerated(n)):
            assert any(all(p + i not in gone for i, c in enumerate(m) if c == "1") for m in op.masks_for(n) for p in range(n - len(m) + 1))


def test_equals_brute_force(spark):
    rng = random.Random(3)
    voc = [f"v{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(voc) for _ in range(rng.choice([3, 5, 8, 12, 20, 40])))) for k in range(25)] + [(90, None), (91, "")]
    rows = []
    for d in range(120):
        w = [rng.choice(voc) for _ in range(rng.randint(0, 60))]
        its = items[rng.randrange(25)][1].split()
        lo = rng.randrange(len(its))
        part = its[lo : lo + rng.randint(4, 40)]
        for i in range(len(part)):
            if rng.random() < 0.12:
                part[i] = rng.choice(voc)
        at = rng.randint(0, len(w))
        rows.append((d, " ".join(w[:at] + part + w[at:])))
    df = fx.docs(spark, rows)
    got = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in op.find_leaks(df, bench(spark, items)).collect()}
    want = {d: brute(t, items) for d, t in rows}
    assert got == want and 20 < sum(map(bool, want.values())) < 120
    # a filter that lets everything through and shuffled joins change nothing
    for more in ({"filter_bits": 64}, {"broadcast_rows": 0}):
        assert {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in op.find_leaks(df, bench(spark, items), **more).collect()} == want
    assert {r["doc_id"] for r in op.clean_documents(df, bench(spark, items), broadcast_rows=0).collect()} == {d for d, x in want.items() if not x}


def test_spans():
    code = op.Coder()
    its = code(" ".join(f"i{k}" for k in range(30)))
    text = " ".join(["x", "y", *[f"i{k}" for k in range(3, 20)], "z"])
    assert op.overlaps(code(text), its, -1) == [(2 - 2, 19 + 1, 17)] and op.overlaps(code(text), its, 4) == []
    repeated = code(" ".join([f"i{k}" for k in range(30)] * 2))
    assert op.overlaps(repeated, its, 30) == [(30, 60, 30)]


def test_copies_and_repeated_ids(spark):
    item = " ".join(f"q{k}" for k in range(20))
    rows = [(1, "before " + item)] * 3 + [(None, "before " + item), (1, "clean words only here"), (2, item + " " + item)]
    got = op.find_leaks(fx.docs(spark, rows), bench(spark, [(5, item), (5, item), (None, item)])).collect()
    assert sorted((r["doc_id"] or 0, r["contaminated"], len(r["leaks"])) for r in got) == [(0, True, 2), (1, False, 0)] + [(1, True, 2)] * 3 + [(2, True, 4)]


def test_hard_cases(spark):
    df = fx.with_extra(fx.hard(spark))
    items = bench(spark, [(1, "same text twice same text twice and more")])
    assert op.find_leaks(df, items).count() == 10
    kept = op.clean_documents(df, items)
    assert kept.columns == df.columns and all(r[c] == "clash" for r in kept.collect() for c in fx.EXTRA)
    assert op.clean_documents(df, items.limit(0)).count() == 10
    assert op.find_leaks(df.limit(0), items).count() == 0 and op.clean_documents(df.limit(0), items).count() == 0
