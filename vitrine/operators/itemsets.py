"""Frequent item sets and rules between them, by writing out the sets of small groups and intersecting bitmaps of large ones.

Equal groups of up to ``SMALL`` items are counted once, and their sets of each size go straight into a partial
aggregation. Larger groups are numbered in blocks of 4,096; a row holds one item set's groups in one block as 64 words of 64
bits. Two sets that share all but their last item meet block by block, the words are joined by a bit
operation and the bits left are counted, so a set's support is a sum over blocks and no group is ever
gathered. Candidates come from pairs counted first and from sets all of whose parts are frequent. The bar is
a whole number of groups, worked out once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from vitrine.functions.numbers import rounded
from vitrine.operators.baskets import pair_counts
from vitrine.session import materialise

WORDS = 64
BLOCK = WORDS * 64
#: Items of a group whose sets are written out: 70 of one size at most.
SMALL = 8


def support_bar(groups: int, min_support: float) -> int:
    """The least number of groups whose share reaches ``min_support``."""
    bar = max(0, int(min_support * groups))
    while bar and (bar - 1) / groups >= min_support:
        bar -= 1
    while groups and bar / groups < min_support:
        bar += 1
    return max(1, bar)


def group_bitmaps(members: DataFrame, group: list[str], groups: int) -> DataFrame:
    """``items`` (one item), ``block``, ``bits``: the groups of each item of ``members``, which are distinct.

    Blocks are dealt by a hash of the group; a block that gets more groups than fit goes on in one of its own.
    """
    blocks = -(-max(1, groups) * 4 // (3 * BLOCK))
    dealt = members.withColumn("_b", F.pmod(F.xxhash64(*group), F.lit(blocks)))
    number = F.dense_rank().over(W.partitionBy("_b").orderBy(*group)) - 1
    at = dealt.select("_item", "_b", number.alias("_n")).select(
        "_item", (F.col("_b") + blocks * F.floor(F.col("_n") / BLOCK)).alias("block"), (F.col("_n") % BLOCK).alias("_n"))
    words = at.groupBy("_item", "block", F.floor(F.col("_n") / 64).alias("_w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_n % 64 as int))")).alias("_bits"))
    held = words.groupBy("_item", "block").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_bits"))).alias("_m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.try_element_at("_m", w.cast("long")), F.lit(0).cast("long")))
    return held.select(F.array("_item").alias("items"), "block", every.alias("bits"))


def _candidates(sets: DataFrame, size: int) -> DataFrame:
    """Sets of one item more, all of whose parts are in ``sets``: items, a, b (the two parts they are made of)."""
    part = F.slice("items", 1, size - 1)
    left = sets.select(part.alias("_p"), F.element_at("items", -1).alias("_x"), F.col("items").alias("a"))
    right = sets.select(part.alias("_p"), F.element_at("items", -1).alias("_y"), F.col("items").alias("b"))
    made = left.join(right, "_p").where("_x < _y").select(F.concat("a", F.array("_y")).alias("items"), "a", "b")
    parts = F.transform(F.sequence(F.lit(0), F.lit(size)), lambda i: F.filter("items", lambda x, j: j != i))
    whole = made.select("items", F.explode(parts).alias("_part")).join(sets.select(F.col("items").alias("_part")), "_part", "left_semi")
    whole = whole.groupBy("items").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size + 1)
    return made.join(whole.select("items"), "items", "left_semi")


def _met(candidates: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Bitmaps of the candidates: items, block, bits; blocks without a common group are left out."""
    one = bitmaps.select(F.col("items").alias("a"), "block", F.col("bits").alias("_one"))
    two = bitmaps.select(F.col("items").alias("b"), "block", F.col("bits").alias("_two"))
    both = candidates.join(one, "a").join(two, ["b", "block"])
    bits = F.zip_with("_one", "_two", lambda x, y: x.bitwiseAND(y))
    return both.select("items", "block", bits.alias("bits")).where(F.exists("bits", lambda x: x != 0))


def _count(bits: str):
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x))


def _sets_of(baskets: DataFrame, size: int) -> DataFrame:
    """How many small groups hold each set of ``size`` items: items, count."""
    items = F.col("_items")
    made = F.transform(items, lambda x, i: F.struct(F.array(x).alias("s"), i.alias("at")))
    for _ in range(size - 1):
        made = F.flatten(F.transform(made, lambda p: F.transform(F.slice(items, p["at"] + 2, F.size(items)), lambda y, j: F.struct(
            F.concat(p["s"], F.array(y)).alias("s"), (p["at"] + 1 + j).alias("at")))))
    each = baskets.where(F.size(items) >= size).select(F.explode(F.transform(made, lambda p: p["s"])).alias("items"), "_w")
    return each.groupBy("items").agg(F.sum("_w").alias("count"))


def frequent_itemsets(df: DataFrame, group: list[str], item: str, min_support: float, max_size: int | None = None) -> DataFrame:
    """``items`` (sorted), ``count``: every set of items, of up to ``max_size``, that is whole in at least the
    share ``min_support`` of the groups with an item. Nulls take no part; an item twice in a group counts once."""
    members = df.dropna(subset=[*group, item]).select(*group, F.col(item).cast("string").alias("_item")).distinct()
    members = materialise(members, "members")
    groups = members.select(*group).distinct().count()
    bar = support_bar(groups, min_support)
    ones = members.groupBy("_item").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= bar)
    ones = materialise(ones, "items")
    found = ones.select(F.array("_item").alias("items"), "count")
    if max_size == 1:
        return found
    # no rarer item can be in a set
    members = members.join(ones.select("_item"), "_item", "left_semi")
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    small = members.join(sizes.where(F.col("_n").between(2, SMALL)).drop("_n"), group)
    baskets = small.groupBy(*group).agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    baskets = materialise(baskets.groupBy("_items").agg(F.count(F.lit(1)).alias("_w")), "baskets")
    large = materialise(members.join(sizes.where(F.col("_n") > max(1, SMALL)).drop("_n"), group), "large")
    several = large.select(*group).distinct().count()
    counts, bitmaps, size = _sets_of(baskets, 2), None, 2
    if several:
        # pairs that occur are far fewer than pairs of items, so they are counted without bitmaps
        counts = counts.unionByName(pair_counts(large, group, "_item").select(F.array("a", "b").alias("items"), "count"))
    while True:
        counts = counts.groupBy("items").agg(F.sum("count").alias("count")).where(F.col("count") >= bar)
        sets = materialise(counts, "sets")
        found = found.unionByName(sets)
        if size == max_size or sets.isEmpty():
            return found
        counts = _sets_of(baskets, size + 1)
        if several:
            if bitmaps is None:
                made = sets.select("items", F.array(F.col("items")[0]).alias("a"), F.array(F.col("items")[1]).alias("b"))
                bitmaps = _met(made, materialise(group_bitmaps(large, group, several), "bitmaps"))
            else:
                bitmaps = bitmaps.join(sets.select("items"), "items", "left_semi")
            bitmaps = materialise(_met(_candidates(sets, size), materialise(bitmaps, "bitmaps")), "bitmaps")
            counts = counts.unionByName(bitmaps.groupBy("items").agg(F.sum(_count("bits")).alias("count")))
        size += 1


def itemset_rules(
    df: DataFrame, group: list[str], item: str, min_support: float, min_confidence: float,
    max_size: int = 4, max_antecedent: int = 3,
) -> DataFrame:
    """``antecedent``, ``consequent`` (sorted arrays without a common item), ``count``, ``support``,
    ``confidence``, ``lift`` for every split of a frequent set of up to ``max_size`` items, the antecedent of
    up to ``max_antecedent``, that reaches ``min_confidence``."""
    sets = materialise(frequent_itemsets(df, group, item, min_support, max_size), "sets")
    total = df.dropna(subset=[*group, item]).select(*group).distinct().agg(F.count(F.lit(1))).scalar()
    side = lambda bit: F.filter("items", lambda x, i: F.getbit(F.col("_m"), i) == bit)
    masks = F.sequence(F.lit(1).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.size("items")) - 2)
    splits = sets.where(F.size("items") > 1).select("items", "count", F.explode(masks).alias("_m")).select(
        side(1).alias("antecedent"), side(0).alias("consequent"), "count").where(F.size("antecedent") <= max_antecedent)
    left = sets.select(F.col("items").alias("antecedent"), F.col("count").alias("_na"))
    right = sets.select(F.col("items").alias("consequent"), F.col("count").alias("_nb"))
    confidence = F.col("count") / F.col("_na")
    return splits.join(left, "antecedent").join(right, "consequent").where(confidence >= min_confidence).select(
        "antecedent", "consequent", "count", rounded(F.col("count") / total, 4).alias("support"),
        rounded(confidence, 4).alias("confidence"), rounded(confidence / (F.col("_nb") / total), 4).alias("lift"))
