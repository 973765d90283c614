import random

from braid.llm import license_scan as op
from tests.llm import fixtures as fx


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_alignment():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 25))]
        b = [x for x in a if rng.random() > 0.15]
        for _ in range(3):
            b.insert(rng.randint(0, len(b)), rng.choice("xyz"))
        pairs = op.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= longest_common(a, b)
    distinct = [f"w{i}" for i in range(50)]
    cut = [w for w in distinct if rng.random() > 0.2]
    assert len(op.align(distinct, cut)) == len(cut) == longest_common(distinct, cut)
    x = [3, 1, 4, 1, 5, 9, 2, 6]
    found = [x[i] for i in op.increasing(x)]
    assert len(found) == 4 and found == sorted(set(found))


def test_scan_documents(spark):
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in op.scan_licenses(docs).collect():
        want = {n for t, n in lines.items() if t in texts[r["doc_id"]]}
        assert {m["template"] for m in r["matches"]} == want, (r, want)
        assert (r["license"] in want) if want else (r["license"] is None and r["coverage"] == 0)


def test_variants():
    s = op.Scanner(op.TEMPLATES)
    mit = op.TEMPLATES["MIT-text"]
    words = mit.split()
    changed = " ".join(w for i, w in enumerate(words) if i % 12)
    assert s.scan("noise " * 50 + changed + " more noise" * 50)[0][0] == "MIT-text"
    assert s.scan(" ".join(words[: len(words) // 2])) == []
    twice = "Released under the MIT License. " + "filler words here " * 30 + "released under the mit license"
    assert len(s.scan(twice)) == 2 and len(s.scan("Released under the MIT License. " * 3)) == 3
    scattered = "released " + "z " * 40 + "under " + "z " * 40 + "the mit " + "z " * 40 + "license"
    assert s.scan(scattered) == []


def test_cut_notices_in_long_prose():
    rng, s = random.Random(5), op.Scanner(op.TEMPLATES)
    prose = lambda n: [rng.choice("the of a to is river stone walked under blue evening it and with".split()) for _ in range(n)]
    for name in ("Apache-2.0-header", "MIT-text", "GPL-3.0-header", "BSD-conditions", "MPL-2.0"):
        words = s.words[name]
        for cut in (words[:-1], words[1:], words[2:], words[: len(words) // 2] + words[len(words) // 2 + 1 :]):
            for before, after in ((174, 0), (0, 174), (200, 200), (3, 2)):
                a, b = prose(before), prose(after)
                best = max(len(op.align(words, (a + cut + b)[i : i + len(words) + op.GAP])) for i in range(before + len(cut)))
                found = [x for x in s.scan(" ".join(a + cut + b)) if x[0] == name]
                assert len(found) == 1 and found[0][1] * len(words) >= best - 1e-9, (name, before, after, found, best)
                assert found[0][1] * len(words) >= len(cut) - 0.05 * len(words) and found[0][2] < before + 5


def test_copies_next_to_each_other():
    s = op.Scanner(op.TEMPLATES)
    full, less = "Released under the MIT License. ", "Released under the License. "
    for n in (1, 2, 50):
        assert [x[1] for x in s.scan(less * n + full * n)].count(1.0) >= n
    assert len(s.scan(full * 2000)) == 2000


def test_hard_cases(spark):
    df = fx.with_extra(fx.hard(spark))
    got = op.scan_licenses(df).collect()
    assert len(got) == 10 and all(r["license"] is None and r["coverage"] == 0 for r in got)
    assert op.scan_licenses(df.limit(0)).count() == 0 and op.scan_licenses(df, {}).count() == 10
