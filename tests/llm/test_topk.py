"""Threshold-algorithm search against brute force."""

import math
import random

import numpy as np
import pytest

from vitrine.llm import topk


def plain(queries, candidates, k, scale=256):
    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    out = []
    for q, e in queries:
        if q is None or not good(e):
            continue
        a = [math.floor(scale * float(np.float32(x))) for x in e]
        scores = [
            (-sum(x * math.floor(scale * float(np.float32(y))) for x, y in zip(a, v)), i)
            for i, v in candidates
            if i is not None and i != q and good(v) and len(v) == len(e)
        ]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("blocks", [(8192, 2048), (17, 5)])
def test_equals_brute_force(spark, blocks):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() ** 3 for _ in range(8)]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(200, 230)] + [(i, [0.0] * 8) for i in range(300, 304)]  # ties
    rows += [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [1.0, 2.0]), (405, [])]
    rows += [(None, [1.0] * 8), (5, [0.5] * 8), (10**12, [100.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(4)
    queries = [r for r in rows if r[0] is None or r[0] % 5 == 0]
    got = topk.top_k(df.where("vec_id is null or vec_id % 5 = 0"), df, 5, candidate_rows=blocks[0], query_rows=blocks[1])
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == plain(queries, rows, 5)


def test_stops_early():
    # few dimensions hold nearly all: most candidates are never scored
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * rng.standard_normal((5000, 4)) * [1, 0.5, 0.1, 0.01])
    lists = topk.Lists(np.arange(5000), vectors)
    own = np.arange(0, 5000, 250)
    best = lists.top(own, vectors[own], 5)
    for i, place, score in zip(own, best.place, best.score):
        want = sorted((-int(s), j) for j, s in enumerate(vectors @ vectors[i]) if j != i)[:5]
        assert list(zip((-score).astype(int).tolist(), place.tolist())) == want
    assert lists.scored < 0.3 * len(own) * 5000


def test_large_components(spark):
    # products beyond 2^53 and 2^63, and scaling beyond doubles
    rows = [(0, [1.0, 1e20]), (1, [1e9, 1e9]), (2, [1e9, 1e9 + 1]), (3, [3.0, -1e20]), (4, [1e308, 0.0]), (5, [-1e308, 2.0]), (6, [0.5, 0.25]),
            (7, [2.0**40, 1.0]), (8, [2.0**40, 1.0 + 2**-8]), (9, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v] for i, v in rows}
    held = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = []
    for q, a in whole.items():
        scores = sorted((-held(sum(x * y for x, y in zip(a, v))), i) for i, v in whole.items() if i != q)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:4], 1)]
    assert sorted(map(tuple, topk.top_k(df, df, 4).collect())) == sorted(want)


def test_many_equal_vectors():
    vectors = np.tile([[3.0, -4.0]], (900, 1))
    found = topk.search(vectors[:3], np.array([0, 5, 2000]), vectors, np.arange(900)[::-1].copy(), 5, 1.0)
    assert found == [[(25, i) for i in range(1, 6)], [(25, i) for i in (0, 1, 2, 3, 4)], [(25, i) for i in range(5)]]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(0, [1.0], 1), (0, [1.0], 1)], SCHEMA)
    assert topk.top_k(empty, empty).count() == 0 and topk.top_k(one, one).count() == 0
    more = spark.createDataFrame([(1, [2.0], 1)], SCHEMA)
    assert sorted(map(tuple, topk.top_k(one, more).collect())) == [(0, 1, 1, 131072)] * 2
