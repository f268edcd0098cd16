"""Personal data: base spans against plain regular expressions, discovery on planted contexts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from vitrine.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    spans = [(m.start(), k, m.end()) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text or "") if holds(kind, m[0])]
    return ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in sorted(spans))


def check(rows, found):
    for r in found:
        want = plain(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), rows[r.doc_id]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        for kind in BASE:
            assert r[f"n_{kind}"] == sum(s.startswith(kind) for s in r.spans.split(","))
        order = [(int(a), list(BASE).index(k)) for k, a, _ in (s.split(":") for s in r.spans.split(",") if s)]
        assert order == sorted(order)


def test_base_spans(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "x.y%z@m-1.example.com", "@", "1.2.3.4", "256.1.1.1", "00255.0.0.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+1 (555) 010-9999", "+44.20.7946.0958", "+1", "-", " ", "é", "😀", ".", "12", "0", "(", "\n", "word", "a@b@c.de", "_", "+123456789012345678", "%40"]
    rows = [None, "", "a@b.com_x@y.org", "+1 234 567 8901 +1 234 567 8902-"] + ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    found = pii.personal_data(df).collect()
    assert len(found) == len(rows)
    check(rows, found)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text for r in df.collect()}
    found = pii.personal_data(df).collect()
    check(rows, found)
    assert all(r.spans == "" for r in found if not re.search("[0-9@]", rows[r.doc_id] or ""))


def planted():
    rng = random.Random(6)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    rows = [f"Please write to mailbox {''.join(rng.choices('abcdef', k=8))}@host{i}.example.com today, thanks" for i in range(30)]
    rows += [f"and dial number +1 ({digits(3)}) {digits(3)}-{digits(4)} please" for _ in range(20)]
    rows += ["Please write to mailbox someone@intranet today, thanks", "or mailbox (nobody@local) at once", "version 4.0.12 of 1234567 items, room 12-34567"]
    return rows


def test_discovers_unseen_values(spark):
    rows = planted() + ["hidden someone@intranet elsewhere"]
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    check(rows, out.values())
    assert out[50].spans == "email:24:40" and out[51].spans == "email:12:24"
    assert out[52].spans == "" and out[53].spans == "email:7:23"  # wherever it stands


def test_redaction(spark):
    rows = planted()[48:52] + [None, "", "x 1.2.3.4@a.com 1.2.3.4", "no data é"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("row", F.lit(1))
    out = pii.redact(df.unionAll(df.limit(0)))
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == df.columns and got[4] is None and got[5] == "" and got[7] == "no data é"
    assert got[6] == "x <EMAIL> <IP>" and "<PHONE> please" in got[0]


def test_long_texts_take_linear_time(spark):
    rows = ["a" * 2_000_000, "12 " * 60_000 + "x@" + "y." * 20_000 + "z", "+1 " * 100_000, "9" * 300_000, "%" * 500_000 + "@a.b", "a-1 " * 50_000]
    found = pii.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6)).collect()
    spans = {r.doc_id: r.spans for r in found}
    assert len(found) == 6 and spans[0] == "" and spans[4] == "email:0:500004" and spans[1].startswith("email:180000:")


def test_odd_tables(spark):
    schema = "doc_id long, text string, extra string, base int, k int"
    assert pii.personal_data(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a@b.co", None, 1, 1), (1, None, "x", 2, 2), (1, None, "x", 2, 2)]
    out = sorted(str((r.doc_id, r.spans)) for r in pii.personal_data(spark.createDataFrame(rows, schema)).collect())
    assert out == sorted(["(None, 'email:0:6')", "(1, '')", "(1, '')"])
