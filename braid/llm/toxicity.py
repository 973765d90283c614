"""Operator 8: toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target, negation, reported speech, other. Four transducers read the symbols of a
clause; each passes them on, some rewritten, and their composition (built lazily, state by state) is one machine:

* negation:  an insult or threat within ``REACH`` words after a negation becomes a negated one;
* reported:  an insult or threat after a verb of speech in the same clause becomes a reported one;
* insult:    an insult with a target within ``REACH`` words before it becomes a directed one;
* threat:    a threat with a target within ``REACH`` words after it becomes an aimed one; without a target it is dropped.

What the machine puts out for a clause are its matches; a match has the weight of the word or stem that it stands on. The
score of a text is the logistic of the bias and the weighted sums of its matches by kind, each different word once in
a clause.

Learning: insult words and stems come from labelled rows. From ``SAMPLE`` rows of either label at most (the least by
a hash of doc_id; whole texts), words and prefixes are taken that toxic rows have too often for chance and that explain
toxic rows which no other does; the weight of one is the logarithm of the ratio of its rates. A logistic regression,
weighted to the labels' own shares and drawn to the prior factors below, gives the bias and the factors of the kinds.
Everything else covers all rows.

Scale: the model has some hundred arcs; documents are scored where they are, without a shuffle.

Defined results: null, empty and wordless texts have no match and so the bias's score; repeated rows get equal scores;
without labels of both kinds only the fixed words are known and the prior weights hold; an empty table gives an empty
result; further columns are ignored by ``score_documents`` and pass through ``clean_documents``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braid.llm.common import staged

SAMPLE = 4000
THRESHOLD = 0.7
REACH = 3
#: Rows that must have an insult word or stem, how many features chance may pass off as one, and the least ratio of
#: the rates of one among toxic and other rows.
LEAST_ROWS = 3
CHANCE = 0.05
LEAST_LIFT = 4.0
#: What a row without the label that has a feature counts against one with it, at equal shares.
WRONG = 5.0
PREFIXES = (3, 4, 5, 6, 7)
#: Prior bias, factors of the kinds of matches, weight of a threat, and how firmly the regression holds on to them.
BIAS = -3.0
PRIOR = {"insult": 1.2, "directed": 1.4, "aimed": 1.0, "negated": 0.3, "reported": 0.4}
THREAT_WEIGHT = 4.0
FIRM = 0.1
#: More matches of a kind than this weight add nothing; a word or stem has half of it at most.
CEILING = 12.0

#: Words of the grammar in the languages of the corpus.
THREATS = set("kill hurt destroy beat stab shoot murder töten umbringen verprügeln tuer frapper détruire matar golpear destruir".split())
TARGETS = set("you your yourself they them their he him she her du dich dir ihr euch sie tu te toi vous ils elles tú ti usted ustedes vosotros ellos".split())
NEGATIONS = set("not never no neither nor nicht nie kein keine niemals pas jamais aucun aucune nunca jamás ni".split())
SPEECH = set("said says say told wrote called claimed quoted sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split())

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:,\n]+")


# ---------------------------------------------------------------- transducers


class Transducer:
    """State 0 starts; ``step(state, symbol)`` gives (state, symbols put out); ``end(state)`` what is put out at the end."""

    def step(self, state: int, symbol: str) -> tuple[int, tuple[str, ...]]:
        raise NotImplementedError

    def end(self, state: int) -> tuple[str, ...]:
        return ()


class Negation(Transducer):
    """state: words for which a negation still reaches."""

    def step(self, state, symbol):
        if symbol == "negation":
            return REACH, ("other",)
        if state and symbol in ("insult", "threat"):
            return state - 1, ("negated",)
        return max(0, state - 1), (symbol,)


class Reported(Transducer):
    """state 1: after a verb of speech."""

    def step(self, state, symbol):
        if symbol == "speech":
            return 1, ("other",)
        return state, ("reported",) if state and symbol in ("insult", "threat") else (symbol,)


class Insult(Transducer):
    """state: words for which a target still counts as addressed."""

    def step(self, state, symbol):
        if symbol == "target":
            return REACH, (symbol,)
        return max(0, state - 1), ("directed",) if state and symbol == "insult" else (symbol,)


class Threat(Transducer):
    """state: words for which a threat still waits for its target."""

    def step(self, state, symbol):
        if symbol == "threat":
            return REACH, ()
        if state and symbol == "target":
            return 0, ("aimed",)
        return max(0, state - 1), (symbol,) if symbol in PRIOR else ()


class Composed:
    """What the transducers give one after another, as one machine whose arcs are found when first used."""

    def __init__(self, *parts: Transducer):
        self.parts, self.arcs = parts, {}

    def _through(self, states: list[int], k: int, symbols) -> tuple[str, ...]:
        for i in range(k, len(self.parts)):
            out: list[str] = []
            for s in symbols:
                states[i], more = self.parts[i].step(states[i], s)
                out += more
            symbols = out
        return tuple(symbols)

    def step(self, state: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
        key = (state, symbol)
        if key not in self.arcs:
            states = list(state)
            out = self._through(states, 0, (symbol,))
            self.arcs[key] = (tuple(states), out)
        return self.arcs[key]

    def read(self, words) -> list[tuple[str, str]]:
        """(match, word that it was put out at) of a clause of (word, symbol)."""
        state, out = (0,) * len(self.parts), []
        for w, s in words:
            state, more = self.step(state, s)
            out += [(k, w) for k in more]
        return out


class Grammar:
    """words and stems: of insults, with their weights. factors: of the kinds of matches, with "bias"."""

    def __init__(self, words=None, stems=None, factors=None):
        self.words, self.stems = dict(words or {}), dict(stems or {})
        self.factors = {"bias": BIAS, **PRIOR, **(factors or {})}
        self.heads: dict[str, list[str]] = {}
        for s in sorted(self.stems):
            self.heads.setdefault(s[: PREFIXES[0]], []).append(s)
        self.machine = Composed(Negation(), Reported(), Insult(), Threat())

    def insult(self, word: str) -> float:
        """Weight of a word as an insult; 0 if it is none."""
        if word in self.words:
            return self.words[word]
        return max((self.stems[s] for s in self.heads.get(word[: PREFIXES[0]], ()) if word.startswith(s) and len(word) > len(s)), default=0.0)

    def symbol(self, word: str) -> str:
        if self.insult(word):
            return "insult"
        return "threat" if word in THREATS else "target" if word in TARGETS else "negation" if word in NEGATIONS else "speech" if word in SPEECH else "other"

    def clauses(self, text: str | None) -> list[tuple[str, list[tuple[str, str]]]]:
        """The matched clauses and their matches."""
        low = (text or "").lower()
        if not any(w in THREATS or self.insult(w) for w in set(WORD.findall(low))):
            return []
        out = []
        for clause in CLAUSE.split(low):
            if found := self.machine.read((w, self.symbol(w)) for w in WORD.findall(clause)):
                out.append((clause.strip(), found))
        return out

    def sums(self, clauses: list[tuple[str, list[tuple[str, str]]]]) -> dict[str, float]:
        """Weight of the matches of each kind."""
        out = dict.fromkeys(PRIOR, 0.0)
        for _, found in clauses:
            for k, w in set(found):
                out[k] += self.insult(w) or THREAT_WEIGHT
        return {k: min(x, CEILING) for k, x in out.items()}

    def score(self, clauses: list[tuple[str, list[tuple[str, str]]]]) -> float:
        x = self.factors["bias"] + sum(self.factors[k] * n for k, n in self.sums(clauses).items())
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


# ---------------------------------------------------------------- learning


def bucket(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3; null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``size`` labelled rows of either label."""
    known = labels.select(F.col("doc_id").alias("l_"), F.col("toxic").cast("int").alias("y_")).distinct()
    ids = [known.filter(F.col("y_") == y).orderBy(F.xxhash64("l_"), "l_").limit(size) for y in (0, 1)]
    few = F.broadcast(ids[0].unionByName(ids[1]))
    return docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("l_")).select("text", F.col("y_").alias("toxic"))


def _features(rows: DataFrame) -> DataFrame:
    """(feature, no, yes): rows of either label that have a word ("=word") or prefix ("^prefix")."""

    def run(batches):
        for pdf in batches:
            counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, y in zip(pdf["text"], pdf["toxic"], strict=True):
                words = set(WORD.findall((text or "").lower()))
                for f in {"=" + w for w in words} | {"^" + w[:k] for w in words for k in PREFIXES if len(w) > k}:
                    counts[f][y] += 1
            yield pd.DataFrame([(f, *n) for f, n in counts.items()], columns=["feature", "no", "yes"])

    counted = rows.mapInPandas(run, "feature string, no long, yes long")
    return counted.groupBy("feature").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))


def _having(rows: DataFrame, names: set[str]) -> list[list[str]]:
    """The features among ``names`` of each toxic row of the sample."""

    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                words = set(WORD.findall((text or "").lower()))
                out.append(sorted(names & ({"=" + w for w in words} | {"^" + w[:k] for w in words for k in PREFIXES if len(w) > k})))
            yield pd.DataFrame({"found": out})

    return [r["found"] for r in rows.filter("toxic = 1").mapInPandas(run, "found array<string>").collect()]


def insults(rows: DataFrame, total: dict[int, int]) -> tuple[dict[str, float], dict[str, float]]:
    """Weighted words and stems that toxic rows of the sample have too often for chance.

    total: rows of either label in the sample. A feature with n rows of which a
    part q is toxic passes if n * KL(q, chance) exceeds the logarithm of all features / ``CHANCE``. A stem must have more
    rows than its most frequent word and than any longer stem that passes. Of these, features are taken greedily while
    each explains more toxic rows for which none before stands than chance would; so the other words of a toxic text
    that was copied often are not taken, as its insults explain its copies.
    """
    counted = staged(_features(rows), "features")
    p = total[1] / (total[0] + total[1])
    least = math.log(max(1, counted.count()) / CHANCE)
    n, q = F.col("yes") + F.col("no"), F.col("yes") / (F.col("yes") + F.col("no"))
    kl = q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    lift = ((F.col("yes") + 0.5) / (total[1] + 1)) / ((F.col("no") + 0.5) / (total[0] + 1))
    found = counted.filter((F.col("yes") >= LEAST_ROWS) & (q > p) & (n * kl >= least)).withColumn("lift", lift).filter(F.col("lift") >= LEAST_LIFT).collect()
    weight = {r["feature"]: min(CEILING / 2, math.log(r["lift"])) for r in found}
    yes, no = ({r["feature"]: r[k] for r in found} for k in ("yes", "no"))
    inside: dict[str, int] = defaultdict(int)
    for f, c in yes.items():
        for k in PREFIXES:
            if len(f) - 1 > k:
                inside[f[1 : k + 1]] = max(inside[f[1 : k + 1]], c)
    names = {f for f in weight if f[0] == "=" or yes[f] > 1.05 * inside[f[1:]]}
    left, chosen = [x for x in _having(rows, names) if x], []
    while left:
        cover = Counter(f for fs in left for f in fs)
        # of equal ones the whole word, then the longest stem
        gain = {f: n - WRONG * no[f] * total[1] / total[0] for f, n in cover.items()}
        f = max(cover, key=lambda f: (gain[f], f[0] == "=", len(f), f))
        if gain[f] <= 0 or cover[f] < max(LEAST_ROWS, least / math.log(sum(total.values()) / len(left))):
            break
        chosen.append(f)
        left = [fs for fs in left if f not in fs]
    # what only stands beside others explains no row of its own; if it is about as frequent as the chosen, it is an insult too
    for kind, part in (("=", 0.8), ("^", 0.5)):
        usual = min((yes[f] for f in chosen if f[0] == kind and not no[f]), default=math.inf)
        chosen += [f for f in sorted(names) if f[0] == kind and not no[f] and yes[f] >= part * usual and not any(f.startswith("^" + x[1:]) or x[1:].startswith(f[1:]) for x in chosen)]
    return {f[1:]: weight[f] for f in chosen if f[0] == "="}, {f[1:]: weight[f] for f in chosen if f[0] == "^"}


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, size: int = SAMPLE) -> Grammar:
    """A grammar learned from the labelled rows that ``train`` (of doc_id) admits, by default all."""
    admitted = labels.filter(F.lit(True) if train is None else train).filter(F.col("toxic").isin(0, 1))
    known = {r["toxic"]: r["n"] for r in admitted.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = staged(sample(docs, admitted, size), "labelled")
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return Grammar()
    grammar, kinds = Grammar(*insults(rows, total)), [*PRIOR]

    def run(batches):
        for pdf in batches:
            sums = [grammar.sums(grammar.clauses(t)) for t in pdf["text"]]
            yield pd.DataFrame([(int(y), *(round(x[k], 3) for k in kinds)) for y, x in zip(pdf["toxic"], sums, strict=True)], columns=["y", *kinds])

    seen = rows.mapInPandas(run, "y int, " + ", ".join(f"{k} double" for k in kinds)).groupBy("y", *kinds).agg(F.count(F.lit(1)).alias("n")).collect()
    x = np.array([[1.0, *(r[k] for k in kinds)] for r in seen])
    y = np.array([r["y"] for r in seen], float)
    n = np.array([r["n"] * known[r["y"]] / total[r["y"]] for r in seen]) * (sum(total.values()) / sum(known.values()))
    w = prior = np.array([BIAS, *PRIOR.values()])
    for _ in range(100):  # Newton steps on the penalised likelihood
        # sums without threaded algebra, which can wait for ever beside the JVM
        p = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -50, 50)))
        slope = np.einsum("ij,i->j", x, n * (p - y)) + FIRM * (w - prior)
        bend = np.einsum("ij,i,ik->jk", x, n * np.maximum(p * (1 - p), 1e-9), x) + FIRM * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return Grammar(grammar.words, grammar.stems, dict(zip(["bias", *kinds], map(float, w), strict=True)))


# ---------------------------------------------------------------- scoring


def score_documents(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, score, predicted, matches and clauses (the matched clauses themselves)."""

    def run(batches):
        for pdf in batches:
            found = [grammar.clauses(t) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "score": [grammar.score(c) for c in found],
                "matches": [[" ".join(sorted(k for k, _ in x)) for _, x in c] for c in found], "clauses": [[t for t, _ in c] for c in found],
            })

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double, matches array<string>, clauses array<string>")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean_documents(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted toxic, in their own columns."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([grammar.score(grammar.clauses(t)) < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
