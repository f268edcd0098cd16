"""Mixing: raked marginals, the draw, odd tables; the SQL twin runs in test_queries."""

import pytest
from pyspark.sql import functions as F

from vitrine.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    rows = []
    for i in range(3000):
        source, lang = ("big", "b", "c", None)[0 if i % 3 else i % 4], ("en", "de", None)[i % 5 % 3]
        rows.append((i, " ".join(["word"] * (1 + i % 7)) + (" license" if i % 11 == 0 else ""), lang, source, 1))
    return spark.createDataFrame(rows, SCHEMA)


def test_marginals_meet_their_targets(spark):
    targets = {"source": {"big": 1, "b": 1, "c": 2, "absent": 5}, "lang": {"en": 0.25, "de": 0.75}, "topic": {"prose": 0.5, "legal": 0.5}}
    docs = corpus(spark)
    out, made = mixing.mix(docs, ["doc_id"], targets=targets)
    rows = out.collect()
    assert len(rows) == 3000
    for dim in targets:
        total, drawn = {}, {}
        for r in rows:
            w = r[made["weight"]] * r[made["tokens"]]
            total[r[made[dim]]] = total.get(r[made[dim]], 0) + w
            drawn[r[made[dim]]] = drawn.get(r[made[dim]], 0) + r[made["tokens"]] * r[made["sampled"]]
        present = {k: v for k, v in targets[dim].items() if k != "absent"}
        for value, share in present.items():
            assert total[value] / sum(total.values()) == pytest.approx(share / sum(present.values()), abs=1e-3)
            assert drawn[value] / sum(drawn.values()) == pytest.approx(share / sum(present.values()), abs=0.12)
        assert total.get(None, 0) == 0  # null has no target here
    assert max(r[made["probability"]] for r in rows) == 1


def test_tempered_targets_keep_nulls(spark):
    out, made = mixing.mix(corpus(spark), ["doc_id"])
    rows = out.collect()
    assert {r[made["source"]] for r in rows if r[made["sampled"]]} == {"big", "b", "c", None}
    chance = {r.doc_id: r[made["probability"]] for r in rows}
    assert all(0 < p <= 1 for p in chance.values())
    again, _ = mixing.mix(corpus(spark).repartition(7), ["doc_id"])
    assert {r.doc_id: r[made["probability"]] for r in again.collect()} == pytest.approx(chance, abs=1e-6)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.sampled(empty).count() == 0
    rows = [(1, None, "en", "s", 0), (None, "", None, None, None), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3), (3, "w " * 300_000, "en", "t", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("mix_tokens", F.lit(7)).withColumn("topic", F.lit("x"))
    out, made = mixing.mix(docs, docs.columns, targets={"topic": {"x": 1.0}}, topic="topic")
    got = out.collect()
    assert len(got) == 5 and made["tokens"] == "_mix_tokens"
    assert {r.doc_id: r[made["tokens"]] for r in got} == {1: 0, None: 0, 2: 2, 3: 300_000}
    kept = mixing.sampled(docs, topic="topic")
    assert kept.columns == docs.columns and kept.where("doc_id = 2").count() in (0, 2)
    nothing = mixing.sampled(spark.createDataFrame([(1, None, "en", "s", 0)], SCHEMA))
    assert nothing.count() == 0
