"""Quality: held-out accuracy, gradients, what labels may be read."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(quality.held_out(F.col("doc_id"))).select("doc_id", "quality")
    some = docs.join(held, "doc_id")
    model = quality.train(docs, labels, train_docs=1500)
    pairs = [(r.quality, model.score((r.text or "").encode())) for r in some.select("quality", "text").collect()]
    good, bad = ([s for y, s in pairs if y == v] for v in (1, 0))
    assert np.mean([(s >= 0.7) == (y == 1) for y, s in pairs]) > 0.97
    assert np.mean([np.mean(np.array(good) > b) for b in bad]) > 0.97  # area under the curve
    assert np.mean([s >= 0.7 for s in good]) > 0.98


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    model, x, start, y = quality.Model(), rng.standard_normal((9, quality.WIDTH)), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model.forward(x, start)["s"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)) + sum(5e-5 * (v**2).sum() for v in model.p.values())

    got = model.gradient(x, start, y, model.forward(x, start))
    for name, v in model.p.items():
        for at in {tuple(rng.integers(0, n) for n in v.shape) for _ in range(4)}:
            old, step = v[at], 1e-5
            v[at] = old + step
            up = loss()
            v[at] = old - step
            down = loss()
            v[at] = old
            assert got[name][at] == pytest.approx((up - down) / 2 / step, abs=1e-6)


def test_whole_texts_are_encoded(monkeypatch):
    text = ("word " * 500 + "\n").encode() * 40 + b"x" * 5000
    assert b"".join(quality.passages(text)) == text
    whole = quality.encode(text)
    monkeypatch.setattr(quality, "AT_ONCE", 3)
    few = quality.encode(text)
    assert whole.shape == few.shape and np.abs(whole - few).max() < 0.02  # only trigrams across two blocks differ


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, quality int"
    rows = [(i, t, "en", 1) for i, t in enumerate([None, "", "fine words here", "w " * 300_000, "x" * 100_000])] + [(None, "a", "en", 0), (2, "fine words here", None, 1)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (3, 1), (3, 1), (None, 1), (77, 0)], "doc_id long, quality int")
    for own in (labels, labels.limit(0)):
        out = quality.quality(docs, own).collect()
        assert len(out) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
        assert {r.doc_id: r.held_out for r in out} == {d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d in (0, 1, 2, 3, 4, None)}
    assert quality.quality(docs.limit(0), labels).count() == 0
