"""Exact interpolated percentiles without holding a group in one task.

``percentile`` and ``median`` keep every distinct value of a group in one aggregation buffer.
Here equal values are counted first (partial aggregation, shuffled on key and value), the counts
are rolled up into scale-free bins, and only the bins that hold a wanted rank are looked into. One of
these with many distinct values is cut again between its least and greatest value. A bin holds 2^40
doubles at most, so a cut into 2^20 parts leaves 2^20 in a part, whatever the data, and ordered are
the bins of a key (2^12 for each doubling that its values span), the parts of a bin, or a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_BINS_PER_DOUBLING = 1 << 12
_BIN_OFFSET = 1100 * _BINS_PER_DOUBLING
_PARTS = 1 << 20
MOST_ORDERED = 1 << 16


def _bin(v: Column) -> Column:
    """Bin number that never decreases as the value grows; 1/4096 of a doubling wide."""
    size = F.floor(F.log2(F.abs(v)) * _BINS_PER_DOUBLING) + _BIN_OFFSET
    signed = F.when(v > 0, size).when(v < 0, -size)
    # never null, so that both uses of the counts share one shuffle
    return F.coalesce(signed.cast("long"), F.lit(0).cast("long"))


def _wanted(probs: dict[str, float]) -> Column:
    """Does a bin with ``_bn`` values after ``_before`` others hold a rank that is asked for?"""
    some = F.lit(False)
    for p in probs.values():
        for r in (_rank(p, False), _rank(p, True)):
            some = some | ((r >= F.col("_before")) & (r < F.col("_before") + F.col("_bn")))
    return some


def _rank(p: float, up: bool) -> Column:
    pos = (F.col("_total") - 1) * F.lit(float(p))
    return F.ceil(pos) if up else F.floor(pos)


def _sizes() -> list[Column]:
    return [F.sum("_n").alias("_bn"), F.count(F.lit(1)).alias("_distinct"), F.min("_v").alias("_least"), F.max("_v").alias("_most")]


def _cut(hit: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """The rows of those parts of each bin that hold a wanted rank, numbered as bins of their own."""
    share = (F.col("_v") - F.col("_least")) / (F.col("_most") - F.col("_least"))
    part = F.floor(share * (_PARTS - 1)).cast("long")
    parts = hit.withColumn("_part", F.col("_bin") * _PARTS + part).drop("_least", "_most", "_distinct")
    sizes = parts.groupBy(*keys, "_bin", "_part").agg(
        *_sizes(), F.first("_before").alias("_start"), F.first("_total").alias("_total"))
    ordered = W.partitionBy(*keys, "_bin").orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = sizes.withColumn("_before", F.col("_start") + F.sum("_bn").over(ordered) - F.col("_bn")).where(_wanted(probs))
    found = parts.drop("_before", "_total").join(placed.drop("_bn", "_start"), [*keys, "_bin", "_part"])
    return found.drop("_bin").withColumnRenamed("_part", "_bin")


def exact_percentiles(
    df: DataFrame, keys: list[str], col: str, probs: dict[str, float], most: int = MOST_ORDERED
) -> DataFrame:
    """One row per key (null keys left out) with a column for each ``name: probability``.

    Bins with more than ``most`` distinct values are cut again before they are ordered.
    """
    present = F.col(col).isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    counts = (
        df.where(present)
        .select(*keys, F.col(col).cast("double").alias("_v"))
        .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bin", _bin(F.col("_v")))
    )
    by_bin = counts.groupBy(*keys, "_bin").agg(*_sizes())
    all_bins = W.partitionBy(*keys)
    ordered = all_bins.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = by_bin.select(
        *keys, "_bin", (F.sum("_bn").over(ordered) - F.col("_bn")).alias("_before"), "_bn",
        F.sum("_bn").over(all_bins).alias("_total"), "_distinct", "_least", "_most",
    )
    found, rank = counts.join(placed.where(_wanted(probs)).drop("_bn"), [*keys, "_bin"]), _rank
    # where no bin is that full, the cut works on nothing
    levels = [found.where(F.col("_distinct") <= most), _cut(found.where(F.col("_distinct") > most), keys, probs)]
    few, many = [rows.select(*keys, F.lit(i).alias("_level"), "_bin", "_before", "_total", "_v", "_n") for i, rows in enumerate(levels)]
    hit = few.unionByName(many)
    inside = (
        W.partitionBy(*keys, "_level", "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    ranked = hit.withColumn("_cum", F.col("_before") + F.sum("_n").over(inside))
    picks = [F.max("_total").alias("_total")]
    for name, p in probs.items():
        picks.append(F.min(F.when(F.col("_cum") > rank(p, False), F.col("_v"))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("_cum") > rank(p, True), F.col("_v"))).alias(f"_hi_{name}"))
    found = ranked.groupBy(*keys).agg(*picks)
    out = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return found.select(*keys, *out)


def with_percentiles(
    measured: DataFrame, df: DataFrame, keys: list[str], col: str, probs: dict[str, float]
) -> DataFrame:
    """Add percentile columns of ``df`` to its per-key aggregate ``measured``."""
    found = exact_percentiles(df, keys, col, probs)
    if keys:
        return measured.join(found, keys, "left")
    return measured.select("*", *[
        found.select(name).scalar().alias(name) for name in probs
    ])
