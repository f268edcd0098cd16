"""Near duplicates by SimHash, found by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a value in the middle: at most half the radius
(rounded down) from the one and half (rounded up) from the other. So every fingerprint emits all
variants within half the radius, equal variants meet, and what meets is linked.

A 64-bit fingerprint has 2,081 variants within two bits. They are dealt out by their leading bits, and
all variants with the same leading bits that come from one fingerprint travel as a single row: the
fingerprint itself. The task that owns these leading bits writes the variants out, a bounded block at a
time, sorts them, drops repeats and links what collides. Each variant exists exactly once, but 56 rows
a fingerprint are shuffled instead of 2,081.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import cols, fresh, partitions, small_batches, stored, utf8
from vitrine.llm.graph import components

BITS = 64
#: Variants are dealt out by so many leading bits.
LEADING = 10
#: Variants that a task holds at once.
BLOCK = 1 << 21
#: Bytes of one text that are cut into words at a time.
PIECE = 1 << 20


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in pieces that end between words (a single longer word stays whole)."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[start:end]
        start = end


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a text: a bit is set where it is set in over half of the shingles' XXH64 values."""
    digest, ones, total, carry = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0, []
    for piece in _pieces(text.lower()):  # of bytes: only A-Z change
        words = carry + piece.split()
        n = len(words) - shingle + 1
        if n > 0:
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(size + 1) - 1
            spans = zip((ends - size)[:n].tolist(), ends[shingle - 1 :].tolist())
            ones += _ones(np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n))
            total += n
        carry = words[max(0, n) :]
    if not total and carry:
        ones, total = _ones(np.array([digest(b" ".join(carry), seed)], np.uint64)), 1
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<i8")[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


@lru_cache(maxsize=None)
def _flips(bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks with up to ``most`` of the lowest ``bits`` bits set, and how many each sets."""
    masks = [(sum(1 << i for i in c), n) for n in range(most + 1) for c in combinations(range(bits), n)]
    return np.array([m for m, _ in masks], np.uint64), np.array([n for _, n in masks], np.int64)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as ``a[i] - b[i]``, at most one for each node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[x], label[y]), label.copy()
        for i in (x, y, label[x], label[y]):
            np.minimum.at(new, i, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _collide(fps: np.ndarray, left: np.ndarray, bits: int, near: int, far: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among ``fps`` whose variants agree above ``bits``; ``left``: bits each may still flip.

    Too many variants for one block are halved by their next bit.
    """
    if len(fps) < 2:
        return
    count = np.array([sum(comb(bits, i) for i in range(n + 1)) for n in range(far + 1)])
    if bits and count[left].sum() > BLOCK:
        on = (fps >> np.uint64(bits - 1)) & np.uint64(1) == 1
        for same in (on, ~on):
            cross = ~same & (left > 0)
            yield from _collide(
                np.concatenate([fps[same], fps[cross]]), np.concatenate([left[same], left[cross] - 1]), bits - 1, near, far
            )
        return
    low = fps & np.uint64((1 << bits) - 1)
    variants, owners, flipped = [], [], []
    for n in range(far + 1):
        rows = np.flatnonzero(left == n)
        masks, ones = _flips(bits, n)
        variants.append((low[rows][:, None] ^ masks).ravel())
        owners.append(np.repeat(rows, len(masks)))
        flipped.append(np.tile(ones + far - n, len(rows)))
    variant, owner, flips = map(np.concatenate, (variants, owners, flipped))
    order = np.argsort(variant)
    variant = variant[order]
    again = variant[1:] == variant[:-1]
    met = np.flatnonzero(np.append(again, False) | np.insert(again, 0, False))
    if not len(met):
        return
    variant, who, flips = variant[met], fps[owner[order[met]]], flips[order[met]]
    start = np.flatnonzero(np.insert(variant[1:] != variant[:-1], 0, True))
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(variant))))
    # a star around one member within ``near`` bits reaches all that met there
    none = np.uint64((1 << BITS) - 1)
    inner = flips <= near
    centre = np.minimum.reduceat(np.where(inner, who, none), start)[group]
    held = np.logical_or.reduceat(inner, start)[group] & (who != centre)
    a, b = who[held], centre[held]
    close = np.bitwise_count(a ^ b) <= near + far  # the check of each pair
    if close.any():
        yield _forest(a[close], b[close])


def links(prints: DataFrame, radius: int = 4, leading: int = LEADING) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints ``fp`` (long): components over them equal those
    over all pairs at most ``radius`` bits apart."""
    near, far = radius // 2, radius - radius // 2
    shift = np.uint64(BITS - leading)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, ones = _flips(leading, far)
        for batch in batches:
            for part in range(0, batch.num_rows, 10_000):
                fps = batch.column(0).slice(part, 10_000).to_numpy(zero_copy_only=False).view(np.uint64)
                prefix = ((fps >> shift)[:, None] ^ masks).ravel()
                yield pa.RecordBatch.from_arrays(
                    [prefix.astype(np.int32), np.repeat(fps, len(masks)).view(np.int64)], ["prefix", "fp"]
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prefix, fps in _by_prefix(batches):
            left = far - np.bitwise_count((fps >> shift) ^ np.uint64(prefix)).astype(np.int64)
            found = list(_collide(fps, left, BITS - leading, near, far))
            if found:
                a, b = _forest(*map(np.concatenate, zip(*found)))
                yield pa.RecordBatch.from_arrays([a.view(np.int64), b.view(np.int64)], ["a", "b"])

    dealt = prints.mapInArrow(deal, "prefix int, fp bigint")
    own = dealt.repartition(partitions(prints), "prefix").sortWithinPartitions("prefix")
    return own.mapInArrow(meet, "a bigint, b bigint").distinct()


def _by_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of equal prefix in sorted batches."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        prefix = batch.column(0).to_numpy()
        fps = batch.column(1).to_numpy().view(np.uint64)
        cuts = np.append(np.flatnonzero(np.diff(prefix)) + 1, len(prefix))
        start = 0
        for end in cuts:
            if prefix[start] != now:
                if held:
                    yield now, np.concatenate(held)
                now, held = int(prefix[start]), []
            held.append(fps[start:end])
            start = end
    if held:
        yield now, np.concatenate(held)


def _with_fingerprint(docs: DataFrame, text: str, shingle: int, name: str) -> DataFrame:
    @F.arrow_udf("bigint")
    def simhash(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, shingle) for t in utf8(column)], pa.int64())

    small_batches(docs.sparkSession)
    return docs.select("*", simhash(docs[f"`{text}`"]).alias(name))


def _groups(prints: DataFrame, radius: int) -> DataFrame:
    """``fp, component_id`` of ``prints(fp, key)``: the smallest key of the fingerprint's component."""
    first = stored(prints.groupBy("fp").agg(F.min("key").alias("first")), "fingerprints")
    roots = components(links(first.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = first.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    joined = roots.join(least, "root").select("fp", "least")
    return first.join(joined, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``key, fingerprint, component_id`` for every row of ``docs``.

    A null text counts as empty; texts without words have fingerprint zero and are linked like any
    other. Repeated rows each give a row. ``component_id`` is the smallest key that is not null, so it is
    null only where all keys of a component are. Other columns are left out, whatever their names.
    """
    slim = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    prints = stored(_with_fingerprint(slim, "text", shingle, "fp").select("key", "fp"), "simhash")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(_groups(prints, radius), "fp").select(
        F.col("key").alias(key), hexed.alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest key (null last); of repeated
    keys, one. Columns stay as they are."""
    fp, row = fresh(docs, "fp", "row")
    whole = stored(_with_fingerprint(docs, text, shingle, fp).withColumn(row, F.monotonically_increasing_id()), "documents")
    prints = whole.select(whole[f"`{key}`"].alias("key"), whole[fp].alias("fp"), whole[row].alias("row"))
    order = F.struct(F.col("key").isNull(), "key", "row")
    first = prints.groupBy("fp").agg(F.min(order).alias("first"))
    groups = _groups(prints.select("fp", F.col("row").alias("key")), radius)
    best = first.join(groups, "fp").groupBy("component_id").agg(F.min("first").alias("first"))
    kept = best.select(F.col("first.row").alias(row))
    return whole.join(kept, row, "left_semi").select(*cols(whole, *docs.columns))
