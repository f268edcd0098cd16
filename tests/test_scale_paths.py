"""Exactness of the ways taken around hot groups, against brute force on skewed random data."""

import hashlib
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitrine.operators import baskets as B, categories as C, clusters as CL, itemsets as I, quantiles as Q, similar as SI, stats as S, texts as T, trends as TR
from vitrine.sources import pages as PG


def test_percentiles_match_numpy(spark):
    rng = random.Random(7)
    rows = [("hot", round(rng.lognormvariate(0, 4), 3)) for _ in range(4000)]
    rows += [("neg", -rng.random() * 10) for _ in range(501)] + [("flat", 5.0)] * 300 + [("mix", float(i - 50)) for i in range(101)]
    rows += [("one", 3.25), (None, 1.0), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.9, "f": 1.0}
    got = {r["k"]: r for r in Q.exact_percentiles(df, ["k"], "v", probs).collect()}
    groups = {k: [v for kk, v in rows if kk == k and v is not None] for k in ("hot", "neg", "flat", "mix", "one")}
    assert set(got) == set(groups)
    for k, values in groups.items():
        for name, p in probs.items():
            assert math.isclose(got[k][name], float(np.quantile(values, p)), rel_tol=1e-9, abs_tol=1e-9), (k, name)
    whole = Q.exact_percentiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert math.isclose(whole, float(np.quantile([v for _, v in rows if v is not None], 0.5)))


@pytest.mark.parametrize("most", [1, 50, 1 << 16])
def test_percentiles_of_values_crowded_in_one_bin(spark, most):
    """Full bins are cut again: values inside one percent, some apart by the last bits only, both signs."""
    rng = np.random.default_rng(5)
    near = 1.0 + np.arange(3000) * 2.0**-50
    groups = {"a": 1000 + rng.permutation(20_000) / 2000, "b": np.concatenate([near, -near, [0.0, 5e9]]),
              "c": np.array([3.5, 3.5]), "d": np.concatenate([-near, [1e-300, -1e300]])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p77": 0.77, "p100": 1.0}
    for r in Q.exact_percentiles(df, ["k"], "v", probs, most).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(groups[r["k"]], p * 100), rel=1e-15), (r["k"], name)


def test_no_bin_of_crowded_values_is_ordered_whole(spark):
    """5 million values inside one percent: the rows that are ordered are a small share."""
    df = spark.range(5_000_000, numPartitions=8).select((F.lit(1000.0) + F.pmod(F.col("id") * 7919, F.lit(5_000_000)) / 5e5).alias("v"))
    assert Q.exact_percentiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(1000 + 2_499_999.5 / 5e5, rel=1e-12)
    binned = df.groupBy(Q._bin(F.col("v")).alias("b")).count().agg(F.max("count")).first()[0]
    assert binned < 5_000_000 * 0.03


def edited_words(words, n, seed):
    """``n`` of ``words`` with up to four letters changed, lost or put in."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        w = list(rng.choice(words))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(w) + 1)
            w[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "á", "ee"])
        out.append("".join(w))
    return out


@pytest.mark.parametrize("threshold", [30, 60, 75, 90, 100])
def test_terms_found_by_pieces_are_all(spark, threshold):
    """On the categories and their synonyms, against the score of every pair."""
    dim = C.category_dim(spark)
    words = [r.term for r in dim.select("term").collect()]
    some = edited_words(words, 250, 1) + ["", " ", "a", "  Perfume ", "x" * 3000, words[0] * 40]
    values = spark.createDataFrame([(w,) for w in some], "v string")
    pairs = values.distinct().crossJoin(dim).select("v", "pos", C.levenshtein_score(F.col("v"), F.col("term")).alias("score"))
    want = {tuple(r) for r in pairs.where(F.col("score") >= threshold).collect()}
    got = {tuple(r) for r in C.near_terms(values, "v", dim, threshold).select("v", "pos", "score").collect()}
    assert got == want and (want or threshold == 100)
    whole = C.match_categories(values, "v", dim, threshold, "levenshtein").collect()
    fast = {r.v: r for r in C.match_categories(values, "v", dim, threshold, "levenshtein", low_scores=False).collect()}
    assert len(whole) == len(fast)
    for r in whole:
        other = fast[r.v]
        assert (r.master, r.stage) == (other.master, other.stage) and other.score == (r.score if r.score >= threshold else None)


def test_few_pairs_of_many_terms_meet(spark):
    """Under one pair in fifty is scored with 20,000 terms."""
    rng = random.Random(2)
    parts = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(3000)]
    terms = sorted({" ".join(rng.sample(parts, rng.randint(1, 3))) for _ in range(20_000)})
    dim = spark.createDataFrame([(i, "master", t, t, t) for i, t in enumerate(terms)], C.DIM_SCHEMA)
    values = spark.createDataFrame([(w,) for w in edited_words(terms, 500, 3)], "v string")
    met = C.met_terms(values, "v", dim).select("v", "pos").distinct().count()
    assert met < 0.02 * values.distinct().count() * len(terms)
    assert C.best_near_term(values, "v", dim).count() > 300


def test_pair_counts_with_a_hot_group(spark):
    rng = random.Random(3)
    groups = {0: [f"i{j:03d}" for j in range(300)]}  # more items than one set holds
    for g in range(1, 60):
        groups[g] = rng.sample(groups[0], rng.randint(1, 6))
    for g in range(60, 90):
        groups[g] = ["i001", "i002", "i003"]  # copies
    rows = [(g, i) for g, items in groups.items() for i in items + items[:1]]
    got = {(r["a"], r["b"]): r["count"] for r in B.pair_counts(spark.createDataFrame(rows, "g int, i string"), ["g"], "i").collect()}
    want = Counter(p for items in groups.values() for p in combinations(sorted(set(items)), 2))
    assert got == dict(want)


def corpus(n):
    rng = random.Random(5)
    vocab = [f"w{j}" for j in range(30)]
    texts = [" ".join(rng.choices(vocab, weights=[60, 40] + [3] * 28, k=rng.randint(1, 6))) for _ in range(n)]
    return [(i, t if i % 3 else "w0 w1") for i, t in enumerate(texts)]  # a third are copies


def brute_similarities(spark, df, rows):
    weights = {}
    for r in T.tfidf(df, "id", "t").collect():
        weights.setdefault(r["id"], {})[r["term"]] = r["weight"]
    sims = {}
    for a, b in combinations([i for i, _ in rows], 2):
        s = sum(w * weights.get(b, {}).get(t, 0.0) for t, w in weights.get(a, {}).items())
        sims[a, b] = sims[b, a] = round(s, 6)
    return sims


@pytest.mark.parametrize("block", [2048, 20])
def test_similar_items_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(SI, "BLOCK", block)
    rows = corpus(150)
    df = spark.createDataFrame(rows, "id long, t string")
    sims = brute_similarities(spark, df, rows)
    got = {}
    for r in SI.similar_items(df, "id", "t", 4).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["similarity"]
    for i, _ in rows:
        want = sorted((s for (a, _), s in sims.items() if a == i), reverse=True)[:4]
        assert np.allclose([got[i][k] for k in sorted(got[i])], want, atol=2e-6), i


def test_blocks_that_cannot_win_stay_closed(spark, monkeypatch):
    # four vocabularies: a text's partners are in its own, and most blocks hold none of its terms
    monkeypatch.setattr(SI, "BLOCK", 20)
    rng = random.Random(8)
    rows = [(i, " ".join(f"v{i % 4}w{rng.randint(0, 25)}" for _ in range(8))) for i in range(400)]
    own, _ = T.vectors(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    groups, _ = SI._distinct(own, "id", [])
    dealt, blocks = SI.blocks_of_alike(groups, 1.0, [])
    assert dealt.groupBy("block").count().agg(F.max("count")).first()[0] <= 60
    opened = SI.opened(dealt, blocks, 5, 1.0, []).where("other IS NOT NULL").count()
    assert 0 < opened < 0.6 * groups.count() * (blocks - 1)


def test_postings_are_those_that_can_reach_the_bar(spark):
    rows = [(1, "a0 b0 c0 d0"), (2, "a0 b0 c0 d0 e0"), (3, "e0 e0 e0 e0 a0")]
    own, terms = T.vectors(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    groups, _ = SI._distinct(own, "id", [])
    for r in SI.postings(groups, 0.9).collect():
        rest = math.sqrt(sum(w * w for c, w in zip(r["codes"], r["weights"]) if c >= r["term"]))
        assert rest >= 0.9 and abs(rest - r["rest"]) < 1e-9
    assert SI.postings(groups, 0.9).count() < SI.postings(groups, 0.1).count() <= 11
    with pytest.raises(ValueError):
        SI.cosine_pairs(spark.createDataFrame(rows, "id long, t string"), "id", "t", 0.0)


@pytest.mark.parametrize("block", [2048, 20])
def test_cosine_pairs_are_complete(spark, monkeypatch, block):
    monkeypatch.setattr(SI, "BLOCK", block)
    rows = corpus(120)
    df = spark.createDataFrame(rows, "id long, t string")
    sims = brute_similarities(spark, df, rows)
    for bar in (0.25, 0.3, 0.8, 0.9):
        found = SI.cosine_pairs(df, "id", "t", bar).collect()
        first = {}
        for i, t in rows:
            first.setdefault(" ".join(sorted(t.split())), i)
        ids = sorted(first.values())
        want = {(a, b) for a, b in combinations(ids, 2) if sims[a, b] >= bar}
        assert {(r["a"], r["b"]) for r in found} == want
        assert {r["a"]: r["members_a"] for r in found if r["a"] == 0} in ({}, {0: sum(t == "w0 w1" or t == "w1 w0" for _, t in rows)})


def test_substitutes_are_exact(spark):
    rng = random.Random(11)
    rows = [(i, "hot" if i % 3 else f"c{i % 5}", float(rng.randint(1, 40))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, c string, p double")
    got = {}
    for r in T.substitutes(df, "id", "c", "p", 3).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["price_diff"], r["substitute_id"]))
    for i, c, p in rows:
        want = sorted((abs(p - q), j) for j, d, q in rows if d == c and j != i)[:3]
        assert [(x, j) for _, x, j in sorted(got[i])] == want


def test_pending_inputs_is_containment(spark):
    listing = spark.createDataFrame([("a1.pdf",), ("b22.pdf",), ("c.pdf",), ("zz.pdf",)], "name string")
    done = spark.createDataFrame([("x_a1_2024.json",), ("b22.txt",), ("abc.json",)], "name string")
    assert sorted(r[0] for r in PG.pending_inputs(listing, done).collect()) == ["b22.pdf", "zz.pdf"]


def test_association_rules_by_hand(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "c")]
    out = B.association_rules(spark.createDataFrame(rows, "g int, i string"), ["g"], "i", 0.5, 0.5)
    assert {(r["antecedent"], r["consequent"]): (r["support"], r["confidence"], r["lift"]) for r in out.collect()} == {
        ("a", "b"): (0.5, 0.6667, 1.3333), ("b", "a"): (0.5, 1.0, 1.3333)}


def test_items_without_terms_still_have_partners(spark):
    rows = [(1, "abc abc"), (2, None), (3, "zz zz"), (4, ""), (5, "abc")]
    out = SI.similar_items(spark.createDataFrame(rows, "id long, t string"), "id", "t", 3, max_features=1).collect()
    assert len(out) == 15
    assert [(r["similar_id"], r["similarity"]) for r in sorted(out, key=lambda r: r["rank"]) if r["id"] == 5] == [(1, 1.0), (2, 0.0), (3, 0.0)]


def test_itemset_support_is_a_share_of_all_groups(spark):
    rows = [(g, i) for g in range(2) for i in "AB"] + [(2, "A"), (3, "B")] + [(g, f"rare{g}") for g in range(4, 10)]
    found = I.frequent_itemsets(spark.createDataFrame(rows, "g int, i string"), ["g"], "i", 0.3).collect()
    assert sorted((r["items"], r["count"]) for r in found) == [(["A"], 3), (["B"], 3)]


def test_sets_on_the_bar_are_kept(spark):
    # 35 groups, 25 of them with a frequent item, one item in exactly a fifth of all
    rows = [(g, "f") for g in range(25)] + [(g, "g") for g in range(7)] + [(g, f"rare{g}") for g in range(25, 35)]
    found = I.frequent_itemsets(spark.createDataFrame(rows, "g int, i string"), ["g"], "i", 0.2).collect()
    assert sorted((r["items"], r["count"]) for r in found) == [(["f"], 25), (["f", "g"], 7), (["g"], 7)]
    assert [I.support_bar(n, s) for n, s in ((35, 0.2), (10, 0.3), (3, 0.5), (0, 0.5), (7, 0.0), (10, 1.0))] == [7, 3, 2, 1, 1, 10]


@pytest.mark.parametrize("words", [64, 1])
def test_itemsets_and_rules_against_plain_counts(spark, monkeypatch, words):
    # one word a block: many blocks, some of them overflowing
    monkeypatch.setattr(I, "WORDS", words)
    monkeypatch.setattr(I, "BLOCK", words * 64)
    rng = random.Random(21)
    rows = []
    for g in range(900):
        own = {i for i, p in zip("abcdefgh", (0.9, 0.85, 0.8, 0.7, 0.6, 0.2, 0.05, 0.01)) if rng.random() < p}
        rows += [(g % 3, g, i) for i in own] * rng.choice([1, 2])
    rows += [(None, 5, "a"), (1, None, "a"), (1, 5000, None)]
    groups = {}
    for s, g, i in rows:
        if None not in (s, g, i):
            groups.setdefault((s, g), set()).add(i)
    counts = Counter(c for own in groups.values() for k in range(1, 9) for c in combinations(sorted(own), k))
    want = {c: n for c, n in counts.items() if n / len(groups) >= 0.1}
    df = spark.createDataFrame(rows, "s int, g int, i string")
    got = {tuple(r["items"]): r["count"] for r in I.frequent_itemsets(df, ["s", "g"], "i", 0.1).collect()}
    assert got == want and max(map(len, got)) >= 5
    assert {tuple(r["items"]) for r in I.frequent_itemsets(df, ["s", "g"], "i", 0.1, 2).collect()} == {c for c in want if len(c) <= 2}
    rules = {(tuple(r["antecedent"]), tuple(r["consequent"])): (r["count"], r["confidence"], r["lift"]) for r in I.itemset_rules(df, ["s", "g"], "i", 0.1, 0.6).collect()}
    plain = {}
    for c, n in want.items():
        for k in range(1, min(3, len(c) - 1) + 1) if len(c) <= 4 else ():
            for a in combinations(c, k):
                b = tuple(x for x in c if x not in a)
                if n / want[a] >= 0.6:
                    plain[a, b] = (n, n / want[a], n / want[a] / (want[b] / len(groups)))
    assert rules.keys() == plain.keys() and all(np.allclose(rules[k], plain[k], atol=6e-5) for k in plain)
    assert max(len(a) for a, _ in rules) == 3
    none = spark.createDataFrame([], "s int, g int, i string")
    assert I.frequent_itemsets(none, ["s", "g"], "i", 0.1).count() == 0 == I.itemset_rules(none, ["s", "g"], "i", 0.1, 0.6).count()


def test_combo_members_without_a_price(spark):
    rows = [(1, "a", 10.0, "none", []), (2, "x", 6.0, "combo", ["a", "b"]), (3, "y", 5.0, "combo", ["a"]), (4, "z", 5.0, "combo", ["b"])]
    df = spark.createDataFrame(rows, "pos int, codigo string, preco_regular double, promo_type string, combo_codes array<string>").withColumns(
        {"preco_promocional": F.lit(None).cast("double"), "brand": F.lit("k"), "categoria_normalizada": F.lit("c")})
    got = {r["pos"]: (r["members"], r["priced_members"], r["saving"]) for r in B.combo_saving(df, ["pos"]).collect()}
    assert got == {2: (2, 1, None), 3: (1, 1, 5.0), 4: (1, 0, None)}


def test_nearest_items_are_exact(spark):
    rng = random.Random(13)
    rows = [(i, t, "hot" if rng.random() < 0.4 else f"c{rng.randint(0, 4)}", rng.choice(["l1", "l2", None])) for i, t in corpus(120)]
    df = spark.createDataFrame(rows, "id long, t string, c string, l string")
    sims = brute_similarities(spark, df, [(r[0], r[1]) for r in rows])
    got = {}
    for r in SI.nearest_items(df, "id", "t", {"c": 0.3, "l": 0.2}, 0.5, 4).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["similarity"]
    for i, _, c, l in rows:
        score = lambda o: 0.5 * sims[i, o[0]] + 0.3 * (c == o[2]) + 0.2 * (l is not None and l == o[3])
        want = sorted((score(o) for o in rows if o[0] != i), reverse=True)[:4]
        assert np.allclose([got[i][k] for k in sorted(got[i])], want, atol=3e-6), i


def test_labels_outside_the_list_count_in_the_total(spark):
    rows = [("a", "x"), ("a", "x"), ("a", "new"), ("a", None), ("b", "new")]
    df = spark.createDataFrame(rows, "k string, l string")
    assert sorted(map(tuple, S.crosstab_pct(df, "k", "l", ["x", "y"], "rest").collect())) == [("a", 66.67, 0.0, 33.33), ("b", 0.0, 0.0, 100.0)]
    assert sorted(map(tuple, S.pivot_counts(df, "k", "l", ["x"], "rest").collect())) == [("a", 2, 2), ("b", 0, 1)]


def test_distinct_counts_do_not_copy_the_rows(spark):
    schema = "codigo string, brand string, source_file string, cycle int, categoria_normalizada string, linha string, promocao_ativa boolean, preco_regular double, desconto_calculado double"
    df = spark.createDataFrame([("1", "b", "f", 1, "c", None, True, 2.0, None), ("2", "b", "f", 2, "c", None, False, 4.0, 10.0), (None, "b", "g", 2, "d", "l", None, 6.0, 20.0)], schema)
    assert tuple(S.overview(df).first()) == (3, 2, 1, 2, 2, 2, 1, 1, 50.0, 4.0, 15.0)


def test_kmeans_assigns_the_nearest_centre(spark):
    rng = random.Random(2)
    rows = [(i, *(c * 50 + rng.random() for c in ((i % 4) & 1, (i % 4) >> 1, i % 4))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, preco_regular double, desconto_calculado double, volume_numeric double")
    out = sorted(map(tuple, CL.kmeans(df, 4).select("id", *CL.FEATURES, "cluster").collect()))
    x, cluster = np.array([r[1:4] for r in out]), np.array([r[4] for r in out])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    centres = np.array([x[cluster == k].mean(axis=0) for k in range(4)])
    assert np.array_equal(((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1), cluster)
    cost = ((x - centres[cluster]) ** 2).sum()
    sweep = {r["k"]: r["inertia"] for r in CL.kmeans_sweep(df, ks=[4], starts=10).collect()}
    assert math.isclose(sweep[4], cost, rel_tol=1e-6)


def plain_silhouette(x, label, squared):
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    far = far if squared else np.sqrt(far)
    out = []
    for i, c in enumerate(label):
        if (label == c).sum() == 1:
            out.append(0.0)
            continue
        a = far[i, label == c].sum() / ((label == c).sum() - 1)
        b = min(far[i, label == d].mean() for d in set(label) - {c})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("cells", [(2048, 131072), (150, 400)])
def test_silhouettes_equal_all_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(CL, "ROW", cells[0])
    monkeypatch.setattr(CL, "COLUMN", cells[1])
    rng = random.Random(4)
    rows = [(rng.choice([10.0, 40.0, 90.0]) + rng.randint(0, 30), float(rng.randint(0, 9)), float(rng.choice([50, 100]))) for _ in range(2000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, preco_regular double, desconto_calculado double, volume_numeric double")
    squared = {r["k"]: r for r in CL.kmeans_sweep(df, ks=[2, 4], starts=3, rounds=6).collect()}
    plain = {r["k"]: r for r in CL.silhouette_sweep(df, ks=[2, 4], starts=3, rounds=6).collect()}
    x = np.array(rows)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    for k in (2, 4):
        label = np.array([r["cluster"] for r in CL.kmeans(df, k, 3, rounds=6).orderBy("id").collect()])
        # with one start the sweep draws the same points as a single k only if k is the largest
        if k == 4:
            assert math.isclose(squared[k]["silhouette_squared"], plain_silhouette(x, label, True), abs_tol=1e-6)
            assert math.isclose(plain[k]["silhouette"], plain_silhouette(x, label, False), abs_tol=1e-6)
    assert sum(r["best"] for r in plain.values()) == 1 and plain[2]["inertia"] == pytest.approx(squared[2]["inertia"])


def test_points_of_the_silhouette_go_to_few_rows_of_cells():
    for points in (1, 5_000, 500_000, 3_000_000):
        rows, columns = CL.cells_of(points, 12)
        assert 1 <= rows <= max(48, points // 32_768 + 1) and columns == -(-points // 131_072)
        assert rows * columns >= min(48, points // 2_048)


@pytest.mark.parametrize("rows, columns", [(7, 3), (14, 4), (1, 1), (2, 5)])
def test_two_rows_of_points_meet_in_one_cell(spark, rows, columns):
    blocks = spark.createDataFrame([(i, 2 * i + k) for i in range(rows) for k in (0, 1)], "row int, block int")
    cells = {}
    for r in CL.in_cells(blocks, rows, columns).collect():
        cells.setdefault((r["i"], r["j"]), {True: set(), False: set()})[r["own"]].add(r["row"])
    assert all(c[True] == {i} for (i, _), c in cells.items())
    met = Counter(frozenset((i, other)) for (i, _), c in cells.items() for other in c[False])
    assert met == Counter(map(frozenset, combinations(range(rows), 2)))
    assert all((i, i * columns // rows) in cells for i in range(rows))


def test_sums_of_distances_are_those_of_all_pairs(monkeypatch):
    monkeypatch.setattr(CL, "MEET", 16)
    rng = np.random.default_rng(3)
    models = [rng.normal(size=(k, 3)) for k in (2, 5)]
    blocks = [[{"x": rng.normal(size=(n, 3)), "n": rng.integers(1, 4, n)} for n in sizes] for sizes in ((40, 3), (1, 70), ())]
    one, two, none = (CL._Side(b, models) for b in blocks)
    for other in (two, none, one):
        CL._meet(one, other)
    every = [r for b in blocks for r in b]
    y, n = np.concatenate([r["x"] for r in every]), np.concatenate([r["n"] for r in every])
    for side, others in ((one, slice(None)), (two, slice(43))):
        for block, sums in side.out():
            far = np.sqrt(((block["x"][:, None] - y[None, others]) ** 2).sum(axis=2)) * n[others]
            want = [far[:, CL._nearest(y[others], m)[0] == c].sum(axis=1) for m in models for c in range(len(m))]
            assert np.allclose(sums, np.stack(want, axis=1), rtol=1e-12)


def test_periods_are_counted_and_not_rows(spark):
    rows = [("a", c, float(c * c), True) for c in range(1, 27) if c not in (9,)]
    df = spark.createDataFrame(rows, "k string, c int, preco_regular double, promocao_ativa boolean")
    y = {c: v for _, c, v, _ in rows}
    got = {r["c"]: r for r in TR.decompose(df, "k", "c", 12).collect()}
    for c in y:
        span = [y.get(x) for x in range(c - 6, c + 7)]
        want = None if None in span else (sum(span) - (span[0] + span[-1]) / 2) / 12
        assert got[c]["trend"] == (None if want is None else pytest.approx(want, abs=1e-4)), c
    assert sum(r["trend"] is not None for r in got.values()) == 5
    mean = {r["c"]: r["avg_price_ma"] for r in TR.moving_average(df, "k", "c", 3).collect()}
    assert mean[10] == pytest.approx((64 + 100) / 2) and mean[11] == pytest.approx((100 + 121) / 2) and mean[12] == pytest.approx(round((100 + 121 + 144) / 3, 2))


def test_kmeans_on_too_few_points(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)] * 3, "preco_regular double, desconto_calculado double, volume_numeric double")
    assert [r["cluster"] for r in CL.kmeans(df, 4).collect()] == [None] * 3
    assert CL.kmeans_sweep(df).count() == 0 == CL.silhouette_sweep(df.limit(0)).count()


def test_topics_do_not_hang_on_partitions(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"{'abc'[i % 3]}{rng.randint(10, 25)}" for _ in range(12)) + f" only{i}") for i in range(90)] + [(None, "a10 a11"), (500, None), (501, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    one = sorted(map(tuple, T.topics(df.coalesce(1), "id", "t", k=3, terms=5, rounds=15).collect()))
    many = sorted(map(tuple, T.topics(df.repartition(20), "id", "t", k=3, terms=5, rounds=15).collect()))
    assert [r[:3] for r in one] == [r[:3] for r in many] and np.allclose([r[3] for r in one], [r[3] for r in many], rtol=1e-9)
    assert len(one) == 15 and not any(r[2].startswith("only") for r in one)
    # the plain version, all texts at once
    texts = [t.split() for i, t in rows if i is not None and t]
    vocab = sorted({w for t in texts for w in t if sum(w in u for u in texts) >= 2})
    x = np.array([[t.count(w) for w in vocab] for t in texts], float)
    draw = lambda w, k: (int(hashlib.md5(f"42:{k}:{w}".encode()).hexdigest()[:8], 16) + 1) / 2**32
    psi = lambda v: np.log(v + 6) - 1 / (2 * (v + 6)) - 1 / (12 * (v + 6) ** 2) + 1 / (120 * (v + 6) ** 4) - 1 / (252 * (v + 6) ** 6) - sum(1 / (v + i) for i in range(6))
    lam, theta = np.array([[0.1 - math.log(draw(w, k)) for k in range(3)] for w in vocab]), np.ones((len(texts), 3))
    for _ in range(15):
        phi = np.exp(psi(lam) - psi(lam.sum(axis=0)))
        r = theta[:, None, :] * phi[None]
        r = x[:, :, None] * r / r.sum(axis=2, keepdims=True)
        lam, theta = r.sum(axis=0) + 1 / 3, np.exp(psi(r.sum(axis=1) + 1 / 3))
    weight = lam / lam.sum(axis=0)
    for topic, rank, term, w in one:
        assert abs(np.sort(weight[:, topic])[-rank] - w) < 1e-9 and abs(weight[vocab.index(term), topic] - w) < 1e-9
    assert T.topics(df.limit(0), "id", "t").count() == 0


def test_topics_leave_the_texts_where_they_are(spark, monkeypatch, capsys):
    rng, stored, store, rounds = random.Random(8), [], T.materialise, 3
    df = spark.createDataFrame([(i, " ".join(f"w{rng.randint(10, 25)}" for _ in range(12))) for i in range(900)], "id long, t string")

    def kept(made, label, **options):
        if label == "topics":
            made.explain()
        stored.append((store(made, label, **options), label))
        return stored[-1][0]

    monkeypatch.setattr(T, "materialise", kept)
    assert T.topics(df, "id", "t", k=3, terms=5, rounds=rounds).count() == 15
    assert sum(made.count() for made, label in stored if label == "topics") == 16  # a row a term, none for a text in a round
    assert capsys.readouterr().out.count("Bucketed: true") == rounds  # the blocks are read where they are, in each round
    assert not spark.catalog.listTables()


def test_topics_count_rows_of_one_id_as_one_text(spark):
    nan, rng = math.nan, random.Random(9)
    rows = [(nan, "aa " * 700 + "bb only"), (0.0, "bb dd"), (nan, "only aa ee"), (-0.0, "only2 dd cc"), (3.0, "aa bb ee"), (nan, "cc " * 255), (0.0, None), (0.0, "only2 " * 300), (None, "only only2")]
    rows += [(float(rng.randint(3, 9)), f"{rng.choice(['aa', 'cc', 'ee'])} {rng.choice(['bb', 'dd', 'ff'])}") for _ in range(60)]
    whole = {}
    for i, t in rows:
        if i is not None:
            whole.setdefault(str(i + 0.0), []).append(t or "")
    merged = spark.createDataFrame([(i, " ".join(t)) for i, t in whole.items()], "id string, t string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # texts go on from batch to batch
    try:
        got = sorted(map(tuple, T.topics(spark.createDataFrame(rows, "id double, t string"), "id", "t", k=2, terms=9, rounds=4).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(map(tuple, T.topics(merged, "id", "t", k=2, terms=9, rounds=4).collect()))
    assert {r[2] for r in got} == {"aa", "bb", "cc", "dd", "ee", "ff"}
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-9)


def test_texts_are_cut_in_pieces_of_bounded_size(spark):
    long = "x" * T.PIECE
    texts = pa.array([None, "", "ab"] + [long[: T.PIECE // 4]] * 12 + [long * 3, "", None, "b"])
    pieces = T._pieces(texts)
    assert [i for a, n in pieces for i in range(a, a + n)] == list(range(len(texts))) and T._pieces(texts[:0]) == []
    assert all(n > 0 and sum(len(t or "") for t in texts[a:a + n - 1].to_pylist()) <= T.PIECE for a, n in pieces)
    # a batch of several pieces: weights as of one text alone
    words = [f"aa{i % 7} bb{i % 5} " * 20_000 if i % 2 else f"aa{i % 7}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(words)) + [(60, None), (61, "")], "id long, t string").coalesce(1)
    got = {}
    for r in T.vectors(df, "id", "t")[0].collect():
        got[r["id"]] = (len(r["codes"]), round(sum(w * w for w in r["weights"]), 9), sum(r["tfs"]))
    assert got == {**{i: (2, 1.0, 40_000) if i % 2 else (1, 1.0, 1) for i in range(60)}, 60: (0, 0, 0), 61: (0, 0, 0)}


@pytest.mark.parametrize("small", [0, 3, 8])
def test_sets_of_small_groups_need_no_bitmaps(spark, monkeypatch, small):
    monkeypatch.setattr(I, "SMALL", small, raising=False)
    stored, write = [], I.materialise
    monkeypatch.setattr(I, "materialise", lambda df, label: stored.append(label) or write(df, label))
    rng = random.Random(3)
    groups = {g: {i for i in "abcdefg" if rng.random() < 0.55} for g in range(300)}
    rows = [(g, i) for g, own in groups.items() for i in own] * 2 + [(None, "a"), (400, None)]
    counts = Counter(c for own in groups.values() for k in range(1, 8) for c in combinations(sorted(own), k))
    want = {c: n for c, n in counts.items() if n / sum(map(bool, groups.values())) >= 0.08}
    got = {tuple(r["items"]): r["count"] for r in I.frequent_itemsets(spark.createDataFrame(rows, "g int, i string"), ["g"], "i", 0.08).collect()}
    assert got == want and max(map(len, got)) >= 4
    assert ("bitmaps" in stored) == (small < 7)


def test_vectors_go_out_once_a_tile(spark, monkeypatch):
    # blocks of ten vectors, tiles of several blocks: what goes out grows with the tiles, not with postings or opened blocks
    monkeypatch.setattr(SI, "BLOCK", 10)
    monkeypatch.setattr(SI, "TILES", 3)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(30)], k=rng.randint(1, 9)))) for i in range(200)] + [(900, None), (None, "w1")]
    df = spark.createDataFrame(rows, "id long, t string")
    groups, _ = SI._distinct(T.vectors(df, "id", "t")[0], "id", [])
    dealt, blocks = SI.blocks_of_alike(groups, 1.0, [])
    sent = SI.in_tiles(SI.own_best(dealt, 5, 1.0, []))
    assert blocks > 9 and sent.groupBy("block").count().agg(F.max("count")).first()[0] <= 3
    assert sent.where("i <= j AND (tile = i OR tile = j)").count() == sent.count()
    # every pair of blocks has one cell
    held = [(r["i"], r["j"], r["block"]) for r in sent.select("i", "j", "block").collect()]
    cells = Counter((a, b) for i, j, a in held for k, m, b in held if (i, j) == (k, m) and a < b and (i == j or a // (-(-blocks // 3)) != b // (-(-blocks // 3))))
    own = {b for _, _, b in held}
    assert cells == Counter(combinations(sorted(own), 2))
    # the answers of one tile a block and of tiles of many are the same
    several = sorted(map(tuple, SI.similar_items(df.where("id IS NOT NULL"), "id", "t", 3).collect()))
    pairs = sorted(map(tuple, SI.cosine_pairs(df.where("id IS NOT NULL"), "id", "t", 0.5).collect()))
    monkeypatch.setattr(SI, "TILE_BYTES", 1)
    assert several == sorted(map(tuple, SI.similar_items(df.where("id IS NOT NULL"), "id", "t", 3).collect())) and len(several) == 603
    assert pairs == sorted(map(tuple, SI.cosine_pairs(df.where("id IS NOT NULL"), "id", "t", 0.5).collect())) and len(pairs) > 20


def test_one_tile_is_held_and_the_other_passes_by(spark, monkeypatch):
    monkeypatch.setattr(SI, "BLOCK", 10)
    monkeypatch.setattr(SI, "TILES", 4)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(30)], k=rng.randint(1, 9)))) for i in range(150)]
    groups, _ = SI._distinct(T.vectors(spark.createDataFrame(rows, "id long, t string"), "id", "t")[0], "id", [])
    sent = SI.in_cells(SI.in_tiles(SI.own_best(SI.blocks_of_alike(groups, 1.0, [])[0], 3, 1.0, []))).repartition(1).sortWithinPartitions("i", "j", "tile", "block")
    batches = sent.toArrow().to_batches()
    met = Counter()
    for a, _, b, _ in SI._meetings(iter(batches), False):
        met.update([] if b is None else [frozenset((a.number, b.number))])
    assert met == Counter(map(frozenset, combinations(sorted({n for pair in met for n in pair}), 2))) and len(met) > 20
    # of a cell of two tiles the blocks of the second one are given back before those of the first
    given = [a for a, _, b, _ in SI._meetings(iter(batches), False) if b is None]
    cells = sent.select("i", "j", "tile", "block").collect()
    pair = next((r["i"], r["j"]) for r in cells if r["i"] < r["j"])
    own = [r["block"] for r in cells if (r["i"], r["j"]) == pair and r["tile"] == pair[1]] + [r["block"] for r in cells if (r["i"], r["j"]) == pair and r["tile"] == pair[0]]
    start = sum((r["i"], r["j"]) < pair for r in cells)
    assert [a.number for a in given][start : start + len(own)] == own and len(given) == len(cells)
    table = sent.where((F.col("i") == pair[0]) & (F.col("j") == pair[1])).toArrow()
    with pytest.raises(RuntimeError):
        list(SI._meetings(iter(table.take(pa.array(range(table.num_rows - 1, -1, -1))).combine_chunks().to_batches()), False))
