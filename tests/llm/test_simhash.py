"""SimHash operator against a plain all-pairs version."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from vitrine.llm import simhash


def plain_fingerprint(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius):
    """Index -> smallest index that can be reached."""
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = sorted((root(i), root(j)))
                group[y] = x
    return [root(i) for i in range(len(prints))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeéßİ", k=rng.randint(1, 6))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(30, 200))) for _ in range(60)]
    out = list(base)
    for b in base[:30]:
        w = b.split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" \t".join(w))
    return out + base[:10] + [None, "", "  \n", "one two", "ONE two", "one", "a b c d", "x\x1cy z"] * 2


def test_fingerprint_equals_the_plain_one(texts, monkeypatch):
    want = [plain_fingerprint(t) for t in texts]
    assert [simhash.fingerprint((t or "").encode()) & (2**64 - 1) for t in texts] == want
    monkeypatch.setattr(simhash, "PIECE", 17)  # texts that are cut into many pieces
    assert [simhash.fingerprint((t or "").encode()) & (2**64 - 1) for t in texts] == want


def test_groups_equal_all_pairs(spark, texts):
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    prints = [plain_fingerprint(t) for t in texts]
    want = {i * 3: (f"{p:016x}", g * 3) for i, (p, g) in enumerate(zip(prints, plain_groups(prints, 4)))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == want and len(out) == len(rows)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5])
def test_links_for_any_radius(spark, radius, monkeypatch):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = list({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for s in seeds for _ in range(9)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), radius, leading=6).collect()
    at = {p[0]: i for i, p in enumerate(signed)}
    group = list(range(len(prints)))
    for _ in prints:
        for r in links:
            low = min(group[at[r.a]], group[at[r.b]])
            group[at[r.a]] = group[at[r.b]] = low
    assert group == plain_groups(prints, radius)


def test_blocks_do_not_change_links(spark, monkeypatch):
    import numpy as np

    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = np.array(sorted({centre ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 5))) for _ in range(200)}), np.uint64)
    left = np.full(len(fps), 2)

    def parts(block):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = list(simhash._collide(fps, left, 40, 2, 2))
        a, b = simhash._forest(*map(np.concatenate, zip(*found)))
        return plain(a, b)

    def plain(a, b):
        label = {int(f): int(f) for f in fps}
        for _ in fps:
            for x, y in zip(a.tolist(), b.tolist()):
                label[x] = label[y] = min(label[x], label[y])
        return label

    assert parts(1 << 22) == parts(5000) == parts(1)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0
    rows = [(None, "a b c d e"), (None, "a b c d e"), (5, None), (3, ""), (3, ""), (9, "q r s t u v"), (None, "lonely words are here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("fp"), F.lit(2).alias("row"), F.lit(3).alias("key"))
    got = sorted(map(str, [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]))
    assert got == sorted(map(str, [(None, None), (None, None), (5, 3), (3, 3), (3, 3), (9, 9), (None, None)]))
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(
        map(str, [(3, ""), (9, "q r s t u v"), (None, "a b c d e"), (None, "lonely words are here now")])
    )
