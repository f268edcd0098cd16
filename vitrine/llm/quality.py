"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded (shares of kinds of characters, word statistics,
repetition of earlier words, hashed character trigrams, then a learned layer), gated attention weighs the
passages, and the weighted representation gives the score. Only document labels are used; the weights are
learned with the rest, from a bounded sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import small_batches, text_or_empty, utf8

#: Labelled documents the model is fitted on, the first by hash of their key, and the longest text among them.
TRAIN_DOCS, TRAIN_CHARS = 4_000, 200_000
#: Bytes of a passage, buckets of trigrams, widths of the learned layers.
PASSAGE, BUCKETS, HIDDEN, GATE = 400, 48, 16, 8
#: Passages turned into features at a time.
AT_ONCE = 1_000

#: Fixed: kinds of bytes whose shares describe a passage.
KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n\r\t", b".,;:", b"!?", b"$%&#*@^~+=", b"<>|{}[]()/\\_", b"'\"`-"]
_KIND = np.full(256, len(KINDS), np.int64)  # the last kind: all other bytes
for _i, _bytes in enumerate(KINDS):
    _KIND[list(_bytes)] = _i
WIDTH = len(KINDS) + 1 + 6 + BUCKETS


def passages(text: bytes) -> list[bytes]:
    """The text in passages of about ``PASSAGE`` bytes that end between words; one empty one for none."""
    out, start = [], 0
    while start < len(text):
        end = text.find(b" ", start + PASSAGE)
        line = text.find(b"\n", start + PASSAGE, len(text) if end < 0 else end)
        end = line if line >= 0 else end
        end = len(text) if end < 0 else end + 1
        out.append(text[start:end])
        start = end
    return out or [b""]


def encode(text: bytes) -> np.ndarray:
    """Fixed features of each passage, a row each."""
    parts, seen, out = passages(text), set(), []
    for i in range(0, len(parts), AT_ONCE):
        out.append(_encode(parts[i : i + AT_ONCE], seen))
    return np.concatenate(out)


def _encode(parts: list[bytes], seen: set[bytes]) -> np.ndarray:
    n, raw = len(parts), np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    at = np.repeat(np.arange(n), size)
    shares = np.bincount(at * (len(KINDS) + 1) + _KIND[raw], minlength=n * (len(KINDS) + 1)).reshape(n, -1)
    raw = raw.astype(np.uint32)
    code = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(BUCKETS) if len(raw) > 2 else raw[:0]
    grams = np.bincount(at[: len(code)] * BUCKETS + code.astype(np.int64), minlength=n * BUCKETS).reshape(n, -1)
    words = np.zeros((n, 6))
    for i, part in enumerate(parts):
        found = part.split()
        own = set(found)
        longest = max(map(len, found), default=0)
        words[i] = len(found) / 100, len(part) / (len(found) + 1) / 10, len(own) / (len(found) + 1), len(own & seen) / (len(own) + 1), longest / 50, len(part) / PASSAGE
        seen |= own
    words = np.minimum(words, 10)
    each = np.maximum(size, 1)[:, None]
    return np.hstack([shares / each, words, grams / each]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder layer, gated attention and classifier; ``fit`` learns all of them together."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        scale = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        self.mean, self.spread = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {"W": scale(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": scale(HIDDEN, GATE), "U": scale(HIDDEN, GATE), "w": scale(GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        """``x``: standardised features of the passages of bags that begin at ``start``."""
        p, bag = self.p, np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x))))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, start)[bag])
        a /= np.add.reduceat(a, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "s": _sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, x: np.ndarray, start: np.ndarray, y: np.ndarray, f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        p, bag, h, t, g, a = self.p, f["bag"], f["h"], f["t"], f["g"], f["a"]
        ds = (f["s"] - y) / len(y)
        dz = ds[:, None] * p["c"]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, start)[bag])
        both = de[:, None] * p["w"]
        dt, dg = both * g * (1 - t * t), both * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        out = {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": f["z"].T @ ds, "d": ds.sum(keepdims=True)}
        return {k: v + 1e-4 * p[k] for k, v in out.items()}

    def fit(self, bags: list[np.ndarray], labels: list[float], steps: int = 250, rate: float = 0.02) -> Model:
        x, y = np.concatenate(bags).astype(np.float64), np.array(labels, float)
        start = np.cumsum([0] + [len(b) for b in bags[:-1]])
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for i in range(1, steps + 1):
            for k, v in self.gradient(x, start, y, self.forward(x, start)).items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                self.p[k] = self.p[k] - rate * first[k] / (1 - 0.9**i) / (np.sqrt(second[k] / (1 - 0.999**i)) + 1e-8)
        return self

    def score(self, text: bytes) -> float:
        x = np.clip((encode(text) - self.mean) / self.spread, -8, 8)
        return float(self.forward(x, np.array([0]))["s"][0])


def held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    """Rows no label is learned from: crc32 of the key as text leaves ``part``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % parts == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", train_docs: int = TRAIN_DOCS) -> Model:
    """A model from at most ``train_docs`` labelled documents that are not held out. Several labels of a key
    are averaged, and it counts as good from one half on; nulls are left out."""

    @F.arrow_udf("binary")
    def features(column: pa.Array) -> pa.Array:
        return pa.array([encode(t).tobytes() for t in utf8(column)], pa.binary())

    small_batches(docs.sparkSession)
    known = labels.select(labels[f"`{key}`"].alias("k"), labels[f"`{label}`"].cast("double").alias("y")).dropna().where(~held_out(F.col("k")))
    some = known.groupBy("k").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(train_docs)
    slim = docs.select(docs[f"`{key}`"].alias("k"), text_or_empty(docs[f"`{text}`"]).alias("text"))
    pairs = slim.join(F.broadcast(some), "k").where(F.length("text") <= TRAIN_CHARS)  # train_docs rows at most
    rows = sorted(pairs.select("k", "y", features("text").alias("x")).limit(2 * train_docs).collect())
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in rows]
    return Model().fit(bags, [float(r.y >= 0.5) for r in rows]) if rows else Model()


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bar: float = 0.7, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``key, held_out, score, predicted`` for every row of ``docs``.

    ``score`` (0 to 1) is the probability of label 1, from the text alone; ``predicted`` is 1 from ``bar`` on. A
    null text counts as empty, and an empty one is a single empty passage. Without any label to learn from
    every score is one half. Repeated rows each give a row; other columns are left out.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, text, label, train_docs))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array([model.value.score(t) for t in utf8(column)], pa.float64())

    own = docs[f"`{key}`"]
    out = docs.select(own.alias(key), held_out(own).alias("held_out"), F.round(score(docs[f"`{text}`"]), 6).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= bar).cast("int"))
