"""PPM against a plain recursive version with dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vitrine.llm import ppm
from vitrine.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


class Plain:
    """The model of a list of texts."""

    def __init__(self, texts, order):
        self.order, self.after, self.words = order, defaultdict(Counter), Counter()
        for t in texts:
            words = self.cut(t)
            self.words.update([*words, b"\n"])
            for context, symbol in self.symbols(words):
                for k in range(order + 1):
                    self.after[context[order - k :]][symbol] += 1
        self.n, self.below = sum(self.words.values()), sum(self.words.values()) + 0.1 * (len(self.words) + 1)

    @staticmethod
    def cut(text):
        line = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in (text or "").encode())
        return [w for w in line.split(b" ") if w]

    def symbols(self, words):
        line = b"\n" * self.order + b" ".join(words) + b"\n"
        return [(line[i - self.order : i], line[i]) for i in range(self.order, len(line))]

    def p(self, context, symbol, gone=frozenset()):
        """Probability of a symbol after a context, with the symbols in ``gone`` excluded."""
        seen = self.after.get(context)
        if seen is None:
            return self.p(context[1:], symbol, gone) if context else 1 / (ppm.ALPHABET - len(gone))
        left = {s: n for s, n in seen.items() if s not in gone}
        below = sum(left.values()) + len(left)
        if symbol in left:
            return left[symbol] / below
        rest = self.p(context[1:], symbol, gone | set(seen)) if context else 1 / (ppm.ALPHABET - len(gone | set(seen)))
        return (len(left) / below if below else 1.0) * rest

    def scores(self, text):
        words = self.cut(text)
        base = sum(math.log10((self.words.get(w, 0) + 0.1) / self.below) for w in [*words, b"\n"])
        known = sum(w in self.words for w in [*words, b"\n"])
        return len(words) + 1, known, self.n, base, sum(math.log10(self.p(*g)) for g in self.symbols(words))


def same(got, rows, order):
    """``got`` rows: key, trained, counts and scores; ``rows``: key, text, trained."""
    model = Plain([t for _, t, own in rows if own], order)
    want = sorted(((k, bool(own), *model.scores(t)) for k, t, own in rows), key=str)
    got = sorted(map(tuple, got), key=str)
    assert len(got) == len(want)
    plain = lambda r: (str(r[0]), r[1], *r[2:5])
    for g, w in zip(sorted(got, key=lambda r: (plain(r), round(r[6], 6))), sorted(want, key=lambda r: (plain(r), round(r[6], 6))), strict=True):
        assert plain(g) == plain(w) and g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


ODD = [None, "", " \t\n", "a", "A a\x0bA\x0cb", "new words 漢字 😀", "\x00\x01 \x7f", "b" * 400, "a b c\x1cd\x85e", "İ É é", "the end\n"]


@pytest.mark.parametrize("order, grams, words", [(1, 1 << 18, 1 << 17), (4, 1 << 18, 1 << 17), (4, 40, 10), (2, 0, 0), (6, 5, 5)])
def test_equals_plain_version(spark, order, grams, words):
    rng = random.Random(order)
    stock = ["the", "then", "thee", "a", "ab", "abc", "Über", "x1", "é", "end"]
    texts = ODD + [" ".join(rng.choices(stock, k=rng.randint(0, 12))) + rng.choice(["", " q" + chr(rng.randint(97, 400))]) for _ in range(120)]
    rows = [(i if i != 30 else None, t, i % 3 != 0) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, own boolean")
    same(ppm.score(df, df["own"], order=order, frequent_grams=grams, frequent_words=words).collect(), rows, order)


def test_slices_and_flushes(spark, monkeypatch):
    # slices shorter than a text, hand-ons in the middle: same counts
    texts = ["ab ba " * 30, "", "x", "ab " * 50 + "z"]
    whole = [np.concatenate([c for c, _ in ppm.grams([t.encode() for t in texts], 3)])]
    monkeypatch.setattr(ppm, "SLICE", 7)
    parts = list(ppm.grams([t.encode() for t in texts], 3))
    assert len(parts) > 10 and np.array_equal(np.concatenate([c for c, _ in parts]), whole[0])
    assert np.bincount(np.concatenate([of for _, of in parts])).tolist() == [len(t) + 1 for t in texts]


def test_probabilities_sum_to_one():
    model = Plain(["abab abc", "ab ca", "zz"], 2)
    for context in (b"ab", b"b ", b"zz", b"qq", b"\n\n"):
        symbols = [s for s in range(256) if s not in (9, 11, 12, 13)]
        assert sum(model.p(context, s) for s in symbols) == pytest.approx(1.0)


def test_table():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 1 << 40, 5000))
    table = ppm.Table(codes[::2], np.arange(len(codes[::2]), dtype=float) + 1)
    values, missing = table.find(codes)
    assert np.array_equal(np.sort(missing), np.arange(1, len(codes), 2)) and np.array_equal(values[::2], np.arange(len(codes[::2])) + 1)
    assert not values[1::2].any() and len(ppm.Table(codes[:0], np.zeros(0)).find(codes[:3])[1]) == 3


def test_query(spark):
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 10 != 0) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = QUERIES["op11_lm_score"](spark, SF)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = out.collect()
    same([(r.doc_id, not r.held_out, *r[2:]) for r in got], rows, ppm.ORDER)
    size = {k: len(b" ".join(Plain.cut(t))) + 1 for k, t, own in rows if not own}
    bits = -sum(r.score for r in got if r.held_out) / math.log10(2) / sum(size.values())
    assert 0 < bits < 3.5  # of 8 for each byte not learnt from


def test_odd_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.score(df, df["doc_id"] > 0).count() == 0
    clash = "doc_id long, text string, word string, gram int, trained int, row int, k int, b int, s int, train boolean, score int, `made of` int, `learnt from` int"
    rows = [(1, "a b", *["x", 1, 2, 3, 4, 5, 6], None, 7, 8, 9)] * 2 + [(None, None, *[None] * 11)]
    df = spark.createDataFrame(rows, clash)
    same(ppm.score(df, df["train"]).collect(), [(r[0], r[1], False) for r in rows], 4)  # nothing to learn from
    same(ppm.score(df, df["doc_id"] == 1).collect(), [(r[0], r[1], r[0] == 1) for r in rows], 4)
    with pytest.raises(ValueError):
        ppm.score(df, df["train"], order=7)
