"""Alignment against a plain version with sets of offsets, and the libraries themselves."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vitrine.llm import align
from vitrine.llm.queries import QUERIES

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def token_bytes_a(a, i, letters):
    return bytes(letters[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>"


def plain(rows, libraries):
    """Every row by the contract's words."""
    a, b = libraries
    letters = align._byte_letters()
    made, counts = [], Counter()
    for key, text in rows:
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [token_bytes_a(a, i, letters) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        whole = f" {text}".encode() if text else b""
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            made.append((key, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        of_a, of_b = defaultdict(list), defaultdict(list)
        for of, ids, ends in ((of_a, ids_a, ends_a), (of_b, ids_b, ends_b)):
            for token, end in zip(ids, ends, strict=True):
                of[end].append(token)
        links = [(x, y) for e in common for x in of_a[e] for y in of_b[e]]
        counts.update(links)
        made.append((key, list(zip(ids_a, ends_a)), list(zip(ids_b, ends_b)), common, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for key, xs, ys, common, links in made:
        groups, low = [], 0
        for e in common:
            side = lambda ts: ",".join(str(i) for i, end in ts if low < end <= e)  # noqa: B023, E731
            groups.append(f"{side(xs)}|{side(ys)}") if len(xs) < 3000 else None
            low = e
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if xs else ""
        out.append((key, len(xs), len(ys), len(common), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha if len(xs) < 3000 else None))
    return out


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same(got, want):
    got = sorted((tuple(r) for r in got), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=lambda r: str(r)), strict=True):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7]), (g, w)


ODD = [
    None, "", " ", "  ", "   a", "a   ", "a\n\nb\tc", "\n", "it's we'll I'D 'tis ''s 's", "<|endoftext|> x", "<s>a</s><unk>", "a▁b", "▁",
    "ünï ßtraße ŒUVRE", "日本語 テスト 漢字", "😀👍🏽 x", "é", "a b c", "\x00\x01\x7f", "a　b", "ﬁ Ⅷ ½", "1234567 12.5% $$$",
    "x" * 5000, " " * 300, "a b " * 400, "﻿x​y", "\r\nA\r\n", "ok <0x41> ▁", "é" * 900,
]


@pytest.mark.parametrize("frequent", [0, 20, 1 << 16])
def test_equals_plain_version(spark, libraries, frequent):
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choices("abc  \n'\téß漢😀<>.,19", k=rng.randint(1, 50))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "   a"), (None, "a b c"), (5, "a b c"), (5, "a b c")]
    got = align.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B, frequent=frequent)
    assert got.columns == NAMES
    same(got.collect(), plain(rows, libraries))


def test_query(spark, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(QUERIES["op12_tokenizer_alignment"](spark, SF).collect(), plain(docs, libraries))


@pytest.mark.parametrize("lane", [1, 3, 1024])
def test_lockstep(lane):
    rng = np.random.default_rng(1)
    a, b = [], []
    for n in [1, 2, 5, 40, 3000, 1, 700]:
        for side in (a, b):
            side.append(np.unique(np.append(rng.integers(1, n + 1, rng.integers(1, n + 1)), n)))
    for x, y, (px, py) in zip(a, b, align.lockstep(a, b, lane), strict=True):
        both = np.intersect1d(x, y)
        assert np.array_equal(x[px], both) and np.array_equal(y[py], both)
    assert align.lockstep([], []) == []


def test_ranks_are_taken_and_agree(libraries):
    rng = random.Random(9)
    chars = [chr(c) for c in [*range(0x20, 0x7F), *range(0xA1, 0x17F), 9, 10, 13, 32, 32, 39]]
    texts = [" " + "".join(rng.choices(chars, k=rng.randint(0, 60))) for _ in range(2000)] + [" it's 'll  \n\n x\t\t", " \u00a0x", " ŉ"]
    got = align.byte_level(A).whole(texts)
    assert [list(x) for x in got] == [e.ids for e in libraries[0].encode_batch(texts, add_special_tokens=False)]
    assert align.PLAIN.fullmatch(texts[0]) and not align.PLAIN.fullmatch(" 漢")
    letters, names = align._byte_letters(), align.byte_level(A).names
    assert align._by_ranks(A, {n: i for i, n in enumerate(names) if i != 50256}) is not None and len(letters) == 256
    assert align._by_ranks(A, {n: i + 1 for i, n in enumerate(names)}) is None


def test_odd_tables(spark, libraries):
    empty = align.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert empty.count() == 0
    clash = "doc_id long, text string, row int, pairs string, times int, n_a int, total int, best int, `made of` int"
    rows = [(1, "a b", 0, "x", 1, 2, 3, 4, 5)] * 2 + [(None, None, *[None] * 7)]
    out = align.align(spark.createDataFrame(rows, clash), A, B, groups=True)
    same([r[:8] for r in out.collect()], plain([r[:2] for r in rows], libraries))
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in out.where("n_a > 0").collect())
