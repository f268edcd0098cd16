"""Token counts against the library itself."""

import random

import public_tokenizers
import pytest

from vitrine.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "   ", "it's we'll I'D 'tis ''s", "<|endoftext|>", "a<|startoftext|>b", "x<|endoftext|", "Ünï ßtraße ŒUVRE İstanbul ſ",
    "e\u0301 a\u030a", "１２ ½ ²³ 123456", "日本語 テスト", "ΣΑΣ ός", "a\u00a0b\u0085c\x1cd\x0be", "😀👍🏽", "\x00\x01", "ŉ'n ǅ ﬁ K Å",
    "a" * 3000, "$$$ %%% !!!", "l'été d'août 'LL", "\ufeffx\u200by",
]


def test_counts_equal_the_library(spark):
    rng = random.Random(2)
    alphabet = [chr(c) for c in range(0x20, 0x250)] + list("\t\n\r'''  ")
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer, _ = tokens.load(PATH)
    for r in tokens.token_counts(df, PATH, limit=10, table_rows=50).collect():
        text = texts[r.doc_id] or ""
        want = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len(text.encode()), want > 10), repr(text)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokenizer, _ = tokens.load(PATH)
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect()}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df, PATH).collect()} == want


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ROWS", 5)
    tokenizer, special = tokens.load(PATH)
    lengths = tokens.Lengths(tokenizer, {"the": 1})
    for i in range(100):
        assert tokens.count(f"the w{i}x", tokenizer, special, lengths) == len(tokenizer.encode(f"the w{i}x", add_special_tokens=False).ids)
        assert len(lengths) <= 7 and lengths["the"] == 1


def test_odd_tables(spark):
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    rows = [(1, "a b", 3), (1, "a b", 3), (None, None, 4)]
    out = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    assert sorted(str(tuple(r)) for r in out) == sorted(["(1, 3, 2, False)", "(1, 3, 2, False)", "(None, 0, 0, False)"])


@pytest.mark.parametrize("text", ["Ünï ßtraße", "plain text, it's"])
def test_plain_texts_take_the_table(text):
    assert tokens.PLAIN.fullmatch(text)
