"""Operator 1: token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a run of characters other than ASCII white space, with a word-start mark before it. The distinct pre-tokens
of a batch of documents form a trie. A node holds the best unigram score of its prefix and the number of pieces of that
best cut; it follows from the nodes above it along the pieces that end there, so a shared prefix is computed once. A
pre-token's count stands at its terminal node. Sorted pre-tokens visit the trie depth first, so that only the path from
the root to the present node is held, however many nodes there are. Frequent pre-tokens keep their counts from batch to
batch in a bounded memo.

Pieces come from a public vocabulary (``public_tokenizers.path("piece_bpe_32k.model")``); nothing is trained. That file
ranks its pieces and gives no probabilities, so the score of the piece of rank r is that of Zipf's law, -log(r + 2). A
character that no piece spells counts as its UTF-8 bytes, at the score of the rarest piece less 10 (the usual penalty).
Tests hold the counts against a tokenizer library that cuts by the same scores.

Scale: documents are counted where they are, without a shuffle; memory is bounded by a batch and the memo. Pre-tokens of
more than ``LONGEST`` characters share little and are cut one by one.

Defined results: null, empty and blank texts have no tokens; rows with equal texts get equal counts; an empty table gives
an empty result; further columns are ignored; whole texts are counted, however long.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PENALTY = 10.0
LONGEST = 200
MEMO = 100_000
#: Characters of text whose distinct pre-tokens form one trie.
BATCH_CHARS = 8_000_000

_workers: dict = {}


def pieces(path: str) -> dict[str, float]:
    """Score of each piece of a vocabulary file, but for bytes and control symbols."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    ranked = sorted(ids, key=lambda i: (-sp.get_score(i), i))
    return {sp.id_to_piece(i): -math.log(r + 2) for r, i in enumerate(ranked)}


class Counter:
    """Counts of pre-tokens by the best unigram cut."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - PENALTY
        ends: dict[str, set[int]] = {}
        for p in scores:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        #: lengths of the longer pieces that end with two characters
        self.lengths = {c: tuple(sorted(n)) for c, n in ends.items()}
        self.memo: dict[str, int] = {}

    def _extend(self, word: str, score: list[float], count: list[int], at: int) -> None:
        """Nodes of ``word`` below the node of its first ``at`` characters."""
        get, lengths, unknown = self.scores.get, self.lengths, self.unknown
        for end in range(at + 1, len(word) + 1):
            c = word[end - 1]
            s = get(c)
            if s is None:
                best, n = score[end - 1] + unknown, count[end - 1] + len(c.encode())
            else:
                best, n = score[end - 1] + s, count[end - 1] + 1
            if end > 1:
                for k in lengths.get(word[end - 2 : end], ()):
                    if k > end:
                        break
                    if (s := get(word[end - k : end])) is not None and score[end - k] + s > best:
                        best, n = score[end - k] + s, count[end - k] + 1
            score.append(best)
            count.append(n)

    def trie(self, words) -> dict[str, int]:
        """The count at the terminal node of each word."""
        out, score, count, before = {}, [0.0], [0], ""
        for w in sorted(words):
            marked = MARK + w
            if len(w) > LONGEST:
                own_score, own_count = [0.0], [0]
                self._extend(marked, own_score, own_count, 0)
                out[w] = own_count[-1]
                continue
            shared, most = 0, min(len(marked), len(before))
            while shared < most and marked[shared] == before[shared]:
                shared += 1
            del score[shared + 1 :], count[shared + 1 :]
            self._extend(marked, score, count, shared)
            out[w] = count[-1]
            before = marked
        return out

    def count(self, texts) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        split = [[w.decode() for w in (t or "").encode().split()] for t in texts]
        new = {w for ws in split for w in ws} - self.memo.keys()
        known = self.trie(new)
        if len(self.memo) + len(known) <= MEMO:
            self.memo.update(known)
        else:
            for ws in split[:: max(1, len(split) // 64)]:  # a few texts show the frequent words
                self.memo.update((w, known[w]) for w in ws if w in known)
        memo = self.memo
        both = {**memo, **known} if len(known) < len(memo) else {**known, **memo}
        return [(len(ws), sum(map(both.__getitem__, ws))) for ws in split]


def counter(path: str) -> Counter:
    if path not in _workers:
        _workers[path] = Counter(pieces(path))
    return _workers[path]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, path: str | None = None, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """One row for each document: doc_id, n_pretokens, n_tokens."""

    def run(batches):
        c = counter(path or vocabulary())
        for pdf in batches:
            texts, out, part, held = list(pdf["text"]), [], [], 0
            for t in texts:
                part.append(t)
                held += len(t or "")
                if held >= batch_chars:
                    out += c.count(part)
                    part, held = [], 0
            out += c.count(part)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_pretokens": [a for a, _ in out], "n_tokens": [b for _, b in out]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_pretokens long, n_tokens long")
