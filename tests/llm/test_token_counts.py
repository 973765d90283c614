from tokenizers import Tokenizer, models

from braid.llm import token_counts as op
from tests.llm import fixtures as fx


def library():
    p = op.pieces(op.vocabulary())
    vocab = [("<unk>", 0.0), *p.items(), *((f"<0x{i:02X}>", 0.0) for i in range(256))]
    return Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))


def brute(t, text):
    words = [w.decode() for w in (text or "").encode().split()]
    return len(words), sum(len(t.encode(op.MARK + w, add_special_tokens=False).ids) for w in words)


def test_counts_equal_a_library(spark):
    t = library()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (docs, fx.with_extra(fx.hard(spark))):
        want = sorted((r["doc_id"] or -1, *brute(t, r["text"])) for r in df.collect())
        for chars in (op.BATCH_CHARS, 500):
            got = sorted((r["doc_id"] or -1, r["n_pretokens"], r["n_tokens"]) for r in op.count_tokens(df, batch_chars=chars).collect())
            assert got == want


def test_long_and_shared(monkeypatch):
    c, t = op.Counter(op.pieces(op.vocabulary())), library()
    words = ["a", "ab", "abc", "abcabcabc" * 40, "international", "internationally", "interna", "🙂🙂", "中文字符", "x" * 300]
    assert c.trie(words) == {w: len(t.encode(op.MARK + w, add_special_tokens=False).ids) for w in words}
    monkeypatch.setattr(op, "MEMO", 3)
    texts = [" ".join(words), "ab ab abc", None, ""]
    assert c.count(texts) == [brute(t, x) for x in texts] == c.count(texts)


def test_empty(spark):
    assert op.count_tokens(fx.hard(spark).limit(0)).count() == 0
