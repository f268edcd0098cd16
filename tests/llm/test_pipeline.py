"""The corpus pipeline, stage by stage, against plain versions."""

import re

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from test_pii import BASE, holds
from test_simhash import plain_fingerprint, plain_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, by_name = docs.columns, dict(P.STAGES)
    assert len(P.STAGES) == 5
    before = {r.doc_id: r for r in docs.collect()}

    kept = by_name["language ID"](spark, docs, SF)
    assert kept.columns == columns
    got = {r.doc_id: r for r in kept.collect()}
    lettered = {i for i, r in before.items() if re.search(r"[^\W\d_]", r.text or "")}
    assert set(got) <= lettered and len(got) >= 0.99 * len(lettered)
    assert all(got[i] == before[i] for i in got)

    kept = by_name["SimHash near-dedup"](spark, kept, SF)
    ids = sorted(got)
    groups = plain_groups([plain_fingerprint(got[i].text) for i in ids], 4)
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted({ids[g] for g in groups})

    squeeze = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [squeeze(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id: r for r in kept.collect() if not any(i in squeeze(r.text) for i in items)}
    kept = by_name["benchmark decontamination"](spark, kept, SF)
    assert {r.doc_id: r for r in kept.collect()} == clean

    kept = by_name["PII"](spark, kept, SF)
    assert kept.columns == columns
    out = {r.doc_id: r for r in kept.collect()}
    assert set(out) == set(clean)
    for i, r in out.items():
        found = [m[0] for kind in BASE for m in re.finditer(BASE[kind], clean[i].text) if holds(kind, m[0])]
        assert r.n_chars == len(r.text) and not any(f in r.text for f in found)
        assert found or r.text == clean[i].text

    last = by_name["mixing sources to target weights"](spark, kept, SF)
    drawn = {r.doc_id: r for r in last.collect()}
    assert drawn and all(out[i] == r for i, r in drawn.items())


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    rows = sorted(r.doc_id for r in P.run(spark, SF).collect())
    assert rows and rows == sorted(r.doc_id for r in docs.collect())


HELPERS = (
    "h s hn sn h0 s0 h1 s1 n g0 evidence host suffix declared letters language confidence accepted ratio chance share total most w tokens draw topic "
    "mix_source mix_tokens mix_sampled weight probability sampled fp u v lo hi row key id least component group item window slot kind start end spans pattern value score _h __h"
).split()


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_odd_rows_and_clashing_columns(spark, name):
    stage, docs = dict(P.STAGES)[name], spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(None, None, None, None, None), (None, "", "en", "src0", 0), (-1, " \n", "en", "src0", 2), (-2, "the same text " * 5, "en", None, 70), (-2, "the same text " * 5, "en", None, 70)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    rows = lambda df: sorted(str((r["doc_id"], r["text"])) for r in df.collect())
    extra = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(HELPERS)))
    assert rows(stage(spark, extra, SF)) == rows(stage(spark, docs, SF))
    assert stage(spark, docs.limit(0), SF).count() == 0
