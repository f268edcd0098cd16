"""Language identification: held-out accuracy, fusion, rejects."""

import math

import numpy as np
from pyspark.sql import functions as F

from vitrine.llm import langid

SF = "/root/testdata/sf0.01"


def test_accuracy_on_other_documents(spark):
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "text", "lang")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify(docs, ["doc_id", "lang", "n_chars"], host=docs["source"], model=model).collect()
    right = [r.language == r.lang for r in out if r.n_chars >= 40]
    assert len(out) == docs.count() and sum(right) >= 0.99 * len(right)
    assert sum(r.accepted for r in out if r.n_chars >= 40) >= 0.995 * len(right)


def plain_model():
    table = np.full((3, langid.BUCKETS), -math.log(langid.BUCKETS))
    for i, word in enumerate((b" aaa bab aba ", b" eee bebe ")):
        part = np.concatenate(list(langid.buckets(word)))
        table[i] = -14
        table[i, part] = -2
    return ["aa", "ee"], table.astype(np.float32)


def test_fusion_of_evidence(spark):
    rows = [(i, "aaa bab aaa bab aba", "h.example.fr") for i in range(30)] + [(i, "bebe eee bebe", "g.net") for i in range(30, 60)]
    rows += [(100, "zq", "h.example.fr"), (101, "zq", "g.net"), (102, "zq", None), (103, '<html lang="ee-X"> zq', "new.fr")]
    rows += [(104, "", "g.net"), (105, None, None), (106, "123 456", "g.net")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string")
    got = {r.doc_id: r for r in langid.identify(df, ["doc_id"], host=df["host"], model=plain_model()).collect()}
    assert all(got[i].language == ("aa" if i < 30 else "ee") and got[i].accepted for i in range(60))
    assert not any(got[i].accepted for i in (104, 105, 106)) and len(got) == len(rows)
    alone = {r.doc_id: r for r in langid.identify(df.where("doc_id >= 100"), ["doc_id"], host=df["host"], model=plain_model()).collect()}
    assert alone[103].language in ("ee", "und") and got[103].confidence <= 1


def test_host_prior_settles_what_the_text_leaves_open(spark):
    langs, table = plain_model()
    table[:] = table[2]  # a text says nothing
    rows = [(i, "x y", "a.net", "aa") for i in range(50)] + [(i, "x y", "b.net", "ee") for i in range(50, 60)] + [(99, "x y", "a.net", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, said string")
    got = {r.doc_id: r.language for r in langid.identify(df, ["doc_id"], host=df["host"], declared=df["said"], model=(langs, table)).collect()}
    assert got[0] == "aa" and got[55] == "ee"


def test_markup_and_suffix(spark):
    rows = [('<!DOCTYPE html><HTML class="x" lang="De-AT">',), ("<body xml:lang=fr>",), ("<p lang=es>",), ("text",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(langid.markup_language(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == ["de", "fr", None, None, None]
    hosts = spark.createDataFrame([("a.b.DE",), ("a.fr:8080",), ("src0",), ("",)], "h string").select(langid.suffix_of(F.col("h")).alias("x"))
    assert [r.x for r in hosts.collect()] == ["de", "fr", "", ""]


def test_pieces_do_not_change_a_count(monkeypatch):
    text = langid.lowered("Ünter  den 12 Linden, été!".encode() * 9)
    whole = np.concatenate(list(langid.buckets(text)))
    monkeypatch.setattr(langid, "PIECE", 7)
    assert np.array_equal(np.concatenate(list(langid.buckets(text))), whole)


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert langid.accepted(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "the house", "en", "s", 9), (1, "the house", "en", "s", 9), (None, None, None, None, None), (2, "", "en", "", 0), (3, "la maison " * 40_000, "fr", "s", 1)]
    df = spark.createDataFrame(rows, schema).withColumn("language", F.lit("x")).withColumn("evidence", F.lit(1))
    kept = langid.accepted(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 3]
    assert langid.accepted(df.withColumn("lang", F.lit(None).cast("string"))).count() == 0
