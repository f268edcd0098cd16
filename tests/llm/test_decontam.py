"""Benchmark decontamination: planted copies and re-parameterised questions, against plain versions."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from vitrine.llm import decontam

SF = "/root/testdata/sf0.01"
ITEM = "Alice has 12 apples and gives Bob 5 kg of flour for 30 dollars, then Alice walks 12 miles to the old market with Bob."
OTHER = "Maria has 7 apples and gives Peter 9 lb of flour for 41 euros, then Maria walks 7 miles to the old market with Peter."
MIXED = "Maria has 7 apples and gives Peter 9 lb of flour for 41 euros, then Otto walks 8 miles to the old market with Maria."


def plain_words(text):
    """Kind and lower-case form of each word."""
    out = []
    for m in re.finditer(r"(?:[A-Za-z\x80-\U0010ffff]|[0-9]|(?<=[0-9])[.,](?=[0-9]))+", text):
        w = m[0]
        capital = "A" <= w[0] <= "Z" or ("À" <= w[0] <= "Þ" and w[0] != "×")
        low = "".join(c.lower() if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in w)
        out.append((1 if re.search("[0-9]", w) else 2 if capital else 3 if low in decontam.UNITS else 0, low))
    return out


def test_words_equal_the_plain_ones(monkeypatch):
    rng = random.Random(2)
    alphabet = "abcXYZ ÀéÿÞ×ñ 0123 .,'-!\n日😀 kg m "
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(400)] + ["", " ", "a", "9", "1.5", ".5.", "x" * 5000, ITEM]
    seen = {}
    for size in (1 << 19, 11):
        monkeypatch.setattr(decontam, "PIECE", size)
        for text in texts:
            _, plain, kind, start = decontam.words_of(text.encode())
            want = plain_words(text)
            assert kind.tolist() == [k for k, _ in want], repr(text)
            for h, (_, low) in zip(plain.tolist(), want):
                assert seen.setdefault(low, h) == h
            assert np.all(np.diff(start) > 0)
    assert len(set(seen.values())) == len(seen)


def found(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()}


def test_templates_and_slots(spark, monkeypatch):
    docs = [ITEM, "before " + OTHER + " after", MIXED, ITEM.upper(), ITEM.lower().replace(" ", "  \n"), "nothing of the kind is here at all", None, "",
            ITEM[: len(ITEM) // 2], "x " * 4000 + ITEM + " y" * 4000, ITEM.replace("old", "very old")]
    want = {(0, 0), (1, 0), (3, 0), (4, 0), (9, 0), (10, 0)}
    got = found(spark, docs, [ITEM, "too short", None, ""])
    assert got - {(10, 0)} == want - {(10, 0)}
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 10)  # a benchmark in several rounds
    assert found(spark, docs, [ITEM, "Some other question that no document holds at all, with 3 words."]) == got


def test_documents(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    squeeze = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    texts = {r.doc_id: squeeze(r.text) for r in docs.collect()}
    want = {(i, r.item_id) for r in items.collect() for i, t in texts.items() if squeeze(r.text) in t}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert want and got == want
    kept = {r.doc_id for r in decontam.decontaminate(docs, items).collect()}
    assert kept == set(texts) - {i for i, _ in want}


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, ITEM), (1, ITEM), (1, ITEM), (2, None), (3, "")], "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("leaks", F.lit(2))
    items = spark.createDataFrame([(7, ITEM), (8, ITEM), (7, ITEM), (None, ITEM), (9, None)], "item_id long, text string")
    rows = sorted(str((r.doc_id, r.item_id)) for r in decontam.contaminated(docs, items).collect())
    assert rows == sorted(str((d, i)) for d in (None, 1, 1) for i in (7, 8))
    kept = decontam.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    assert decontam.decontaminate(docs, items.limit(0)).count() == 5
