"""Operator 10: license scans by patience alignment.

A template is aligned with a region of a text: words that are unique in both are anchors; the longest increasing
subsequence of their places keeps those in order; the gaps between neighbouring anchors (and before the first and after
the last) are aligned the same way, where other words have become unique; equal words at the ends of a gap are taken
first. The coverage is the share of the template's words that are matched. A region is a stretch of the text in which
words of the template follow each other with at most ``GAP`` other words between; a repeated notice is so aligned in each
place, and words scattered over a long text make no match.

Texts are only aligned with templates of which they have enough words: the words in common, each as often as in both,
bound the coverage from above, so this loses nothing.

Words are runs of letters a to z and digits, in lower case. Scale: documents are scanned where they are, without a
shuffle; templates are a parameter of a few KB.

Defined results: null and empty texts have no license (null, coverage 0); the match with the most
matched words, then by coverage and name, is the license; repeated rows get equal results; no templates find nothing; an empty table gives an empty
result; further columns are ignored; whole texts are scanned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
GAP = 10
WORD = re.compile(r"[a-z0-9]+")

#: The notices and short texts of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(p)
            at.append(i)
        else:
            tops[k], at[k] = p, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), both rising."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1 and na[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if w in where]
        anchors = [pairs[k] for k in increasing([j for _, j in pairs])]
        if not anchors:
            continue
        out += anchors
        i0, j0 = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            stack.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, gap: int = GAP):
        self.coverage, self.gap = coverage, gap
        self.words = {k: WORD.findall(t.lower()) for k, t in templates.items()}
        self.words = {k: w for k, w in sorted(self.words.items()) if w}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.sets = {k: frozenset(w) for k, w in self.words.items()}

    def regions(self, words: list[str], own: frozenset[str]) -> list[tuple[int, int]]:
        at = [i for i, w in enumerate(words) if w in own]
        out: list[tuple[int, int]] = []
        for i in at:
            if out and i - out[-1][1] <= self.gap:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i, i + 1))
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, word after the last) of every match, best first.

        Of matches that overlap, the one with more matched words stays, then the one of higher coverage.
        """
        words = WORD.findall((text or "").lower())
        have, out = set(words), []
        for name, template in self.words.items():
            need, counts = self.coverage * len(template) - 1e-9, self.counts[name]
            if sum(counts[w] for w in self.sets[name] & have) < need:
                continue
            for start, end in self.regions(words, self.sets[name]):
                region = words[start:end]
                n = Counter(region)
                if sum(min(c, n[w]) for w, c in counts.items()) < need:
                    continue
                out += [(name, c, start + s, start + e) for c, s, e in self.aligned(name, region)]
        kept: list[tuple[str, float, int, int]] = []
        for x in sorted(out, key=lambda x: (-round(x[1] * len(self.words[x[0]])), -x[1], x[0], x[2])):
            if not any(x[2] < y[3] and y[2] < x[3] for y in kept):
                kept.append(x)
        return kept

    def starts(self, name: str, region: list[str], lo: int, hi: int) -> list[int]:
        """Words of the template in lo..hi where a window has enough words in common with it to reach the coverage."""
        counts, need = self.counts[name], self.coverage * len(self.words[name]) - 1e-9
        size = len(self.words[name]) + self.gap
        have: Counter[str] = Counter()
        out, common, end = [], 0, lo
        for at in range(lo, hi):
            for w in region[end : min(at + size, hi)]:
                have[w] += 1
                common += have[w] <= counts[w]
            end = max(end, min(at + size, hi))
            w = region[at]
            if common >= need and w in counts:
                out.append(at)
            common -= have[w] <= counts[w]
            have[w] -= 1
        return out

    def aligned(self, name: str, region: list[str]) -> list[tuple[float, int, int]]:
        """(coverage, first word, word after the last) of the copies of a template in a region.

        The windows of all starts are aligned, whatever the region's length. Of matches that overlap, the one with more
        matched words stays, then the shorter one; what lies between those that stay is searched again.
        """
        template, out = self.words[name], []
        size, stack = len(template) + self.gap, [(0, len(region))]
        while stack:
            lo, hi = stack.pop()
            found = set()
            for at in self.starts(name, region, lo, hi):
                pairs = align(template, region[at : min(at + size, hi)])
                if len(pairs) >= self.coverage * len(template) - 1e-9:
                    found.add((-len(pairs), pairs[-1][1] + 1 - pairs[0][1], at + pairs[0][1]))
            taken: list[tuple[int, int]] = []
            for n, span, first in sorted(found):
                k = bisect_left(taken, (first, first))
                if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or first + span <= taken[k][0]):
                    taken.insert(k, (first, first + span))
                    out.append((-n / len(template), first, first + span))
            edges = [lo, *[x for t in taken for x in t], hi]
            stack += [(i, j) for i, j in zip(edges[::2], edges[1::2], strict=True) if taken and i < j]
        return sorted(out, key=lambda x: x[1])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document: doc_id, license, coverage, matches (array of template, coverage, first_word, end_word)."""
    known = TEMPLATES if templates is None else templates

    def run(batches):
        scanner = Scanner(known, coverage)
        for pdf in batches:
            found = [scanner.scan(t) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "license": [x[0][0] if x else None for x in found], "coverage": [x[0][1] if x else 0.0 for x in found],
                "matches": [[{"template": n, "coverage": c, "first_word": s, "end_word": e} for n, c, s, e in x] for x in found],
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, license string, coverage double, matches array<struct<template:string,coverage:double,first_word:int,end_word:int>>")
