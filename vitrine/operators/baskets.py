"""Pages as baskets: items sold together, combo links, association rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions.numbers import rounded

SET_SIZE = 64


def baskets(df: DataFrame, group: list[str], item: str) -> DataFrame:
    """Items of the groups with at least two rows, one row per item, with the group's size.

    Long form on purpose: a page of any size stays many rows.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("basket_size")).where("basket_size > 1")
    return df.select(*group, item).join(sizes, group)


def _pairs_inside(items: Column) -> Column:
    return F.flatten(F.transform(items, lambda a, i: F.transform(
        F.slice(items, i + 2, F.size(items)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def _pairs_between(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.struct(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))))


def pair_counts(df: DataFrame, group: list[str], item: str) -> DataFrame:
    """In how many groups each unordered pair of distinct items occurs: a < b, count.

    Items of a group are made distinct and cut into sets of bounded size by hash. Equal sets are
    counted once with their number, so copies of a page cost one row, and pairs come out of a set
    straight into a partial aggregation. Groups of several sets pair them up over many tasks.
    """
    members = df.dropna(subset=[*group, item]).select(*group, F.col(item).alias("_item")).distinct()
    sizes = members.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / SET_SIZE).alias("_sets")).where(
        (F.col("_sets") >= 1))
    sets = (
        members.join(sizes, group)
        .withColumn("_set", F.pmod(F.xxhash64("_item"), F.col("_sets")))
        .groupBy(*group, "_sets", "_set").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    )
    inside = sets.where(F.size("_items") > 1).groupBy("_items").agg(F.count(F.lit(1)).alias("_w")).select(
        F.explode(_pairs_inside(F.col("_items"))).alias("_p"), "_w")
    # a group of several sets is a grid of set pairs; each cell is a key of its own, so a group of any
    # size is spread over as many tasks as it has cells
    many = sets.where("_sets > 1")
    row = many.select(*group, "_items", F.col("_set").alias("_i"), F.explode(F.sequence(F.col("_set") + 1, F.col("_sets"))).alias("_j")).where("_j < _sets")
    column = many.where("_set > 0").select(*group, F.col("_items").alias("_items2"), F.col("_set").alias("_j"),
                                           F.explode(F.sequence(F.lit(0).cast("long"), F.col("_set") - 1)).alias("_i"))
    between = row.join(column, [*group, "_i", "_j"]).groupBy("_items", "_items2").agg(
        F.count(F.lit(1)).alias("_w")
    ).select(F.explode(_pairs_between(F.col("_items"), F.col("_items2"))).alias("_p"), "_w")
    return inside.unionByName(between).groupBy(
        F.col("_p.a").alias("a"), F.col("_p.b").alias("b")).agg(F.sum("_w").alias("count"))


def category_pairs(
    df: DataFrame, category: str = "categoria_normalizada", scope: str = "code",
    group: tuple[str, ...] = ("source_file", "pagina"),
) -> DataFrame:
    """Pages per unordered category pair, for pages with at least two rows.

    ``code`` counts every category any row of the table has under a code on the page; ``page``
    counts the categories of the page's own rows.
    """
    group = list(group)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    if scope == "page":
        return pair_counts(df.select(*group, category).join(sizes, group), group, category)
    codes = df.where("codigo IS NOT NULL").select(*group, "codigo").distinct().join(sizes, group)
    known = df.where(F.col("codigo").isNotNull() & F.col(category).isNotNull()).select("codigo", category).distinct()
    return pair_counts(codes.join(known, "codigo"), group, category)


def top_pairs(pairs: DataFrame, n: int = 15) -> DataFrame:
    return pairs.orderBy(F.desc("count"), "a", "b").limit(n)


def cooccurrence_matrix(pairs: DataFrame, values: list[str]) -> DataFrame:
    """Symmetric matrix of pair counts over a known label list; absent cells show 0."""
    both = pairs.select("a", "b", "count").unionByName(
        pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "count"))
    return both.groupBy(F.col("a").alias("category")).pivot("b", values).agg(F.sum("count")).fillna(0, values)


def combo_edges(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per link from a combo product to a code in its rule."""
    return df.where(F.col("promo_type") == "combo").select(
        *(extra or []), F.col("codigo").alias("source"), F.explode("combo_codes").alias("target"), "brand",
        F.col("categoria_normalizada").alias("category"))


def combo_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct undirected links, and the number of links of each node; a self-link counts twice."""
    a, b = F.col("source"), F.col("target")
    links = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(
        F.count(F.lit(1)).alias("degree"))
    return links, degree


def combo_pairs(edges: DataFrame, combo: list[str]) -> DataFrame:
    """In how many combos two member codes occur together."""
    return pair_counts(edges, combo, "target")


def combo_saving(df: DataFrame, ids: list[str]) -> DataFrame:
    """Bundle price of each combo row against the summed mean regular prices of its members.

    ``priced_members`` counts the members with a known price; if any is missing, the members' price and
    the saving are null.
    """
    edges = combo_edges(df.withColumn("_bundle", F.coalesce("preco_promocional", "preco_regular")), [*ids, "_bundle"])
    prices = df.where("codigo IS NOT NULL").groupBy(F.col("codigo").alias("target")).agg(
        F.avg("preco_regular").alias("_price"))
    found = edges.join(prices, "target", "left").groupBy(*ids).agg(
        F.count(F.lit(1)).alias("members"), F.count("_price").alias("priced_members"), F.sum("_price").alias("_sum"),
        F.first("_bundle").alias("_bundle"))
    whole = F.when(F.col("members") == F.col("priced_members"), F.col("_sum"))
    return found.select(
        *ids, "members", "priced_members", rounded(F.col("_bundle")).alias("bundle_price"), rounded(whole).alias("members_price"),
        rounded(whole - F.col("_bundle")).alias("saving"))


def _frequent(df: DataFrame, group: list[str], item: str, min_support: float):
    """Distinct members whose item reaches the support; no rarer item can be in a rule."""
    members = df.dropna(subset=[*group, item]).select(*group, F.col(item).alias("_item")).distinct()
    n = members.select(*group).distinct().agg(F.count(F.lit(1))).scalar()
    counts = members.groupBy("_item").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") / n >= min_support)
    return members.join(counts.select("_item"), "_item", "left_semi"), counts, n


def association_rules(
    df: DataFrame, group: list[str], item: str, min_support: float, min_confidence: float
) -> DataFrame:
    """Rules ``antecedent -> consequent`` between single items, with support, confidence and lift."""
    members, counts, n = _frequent(df, group, item, min_support)
    pairs = pair_counts(members, group, "_item").where(F.col("count") / n >= min_support)
    rules = pairs.select(F.col("a").alias("antecedent"), F.col("b").alias("consequent"), "count").unionByName(
        pairs.select(F.col("b").alias("antecedent"), F.col("a").alias("consequent"), "count"))
    left = counts.select(F.col("_item").alias("antecedent"), F.col("_n").alias("_na"))
    right = counts.select(F.col("_item").alias("consequent"), F.col("_n").alias("_nb"))
    confidence = F.col("count") / F.col("_na")
    return rules.join(left, "antecedent").join(right, "consequent").where(confidence >= min_confidence).select(
        "antecedent", "consequent", "count", rounded(F.col("count") / n, 4).alias("support"),
        rounded(confidence, 4).alias("confidence"), rounded(confidence / (F.col("_nb") / n), 4).alias("lift"))
