"""Aggregate reports. Null keys are left out, as are nulls inside a measure."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vitrine import constants as K
from vitrine.functions.numbers import money_sum, rounded, tier_stats
from vitrine.operators.projections import transpose
from vitrine.operators.quantiles import exact_percentiles, with_percentiles


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys) if keys else df


def _rate(c: str) -> Column:
    return F.avg(F.col(c).cast("double"))


def _distinct_counts(df: DataFrame, cols: dict[str, str]) -> dict[str, Column]:
    """How many values each column has, as scalars. The rows are reduced to their distinct combinations
    first, so that counting several columns does not copy every row for each."""
    small = df.select(*cols.values()).distinct()
    counts = small.agg(F.struct(*[F.countDistinct(c).alias(n) for n, c in cols.items()]).alias("s")).scalar()
    return {n: counts[n].alias(n) for n in cols}


def overview(df: DataFrame) -> DataFrame:
    """One row: totals, distinct counts, promotion rate and averages."""
    low = _distinct_counts(df, {"brands": "brand", "catalogs": "source_file", "cycles": "cycle",
                                "categories": "categoria_normalizada", "product_lines": "linha"})
    codes = _distinct_counts(df, {"unique_products": "codigo"})
    base = df.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if("promocao_ativa").alias("products_with_promotion"),
        rounded(_rate("promocao_ativa") * 100).alias("promotion_rate"),
        rounded(F.avg("preco_regular")).alias("avg_regular_price"),
        rounded(F.avg("desconto_calculado")).alias("avg_discount"),
    )
    return base.select(
        "total_products", codes["unique_products"], *low.values(), "products_with_promotion", "promotion_rate",
        "avg_regular_price", "avg_discount")


def value_counts(df: DataFrame, key: str) -> DataFrame:
    return _keyed(df, [key]).groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def counts_by(df: DataFrame, keys: list[str]) -> DataFrame:
    return _keyed(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def distinct_by(df: DataFrame, key: str, col: str) -> DataFrame:
    return _keyed(df, [key]).groupBy(key).agg(F.countDistinct(col).alias("distinct_count"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins between least and greatest value, the last one closed; empty bins show 0."""
    values = df.select(F.col(col).cast("double").alias("_v")).where("_v IS NOT NULL")
    span = values.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi")).alias("s")).scalar()
    lo = span["lo"]
    width = (span["hi"] - lo) / F.lit(float(bins))
    index = F.least(F.floor((F.col("_v") - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    counted = values.groupBy(F.coalesce(index, F.lit(0)).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    labels = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return labels.join(counted, "bin", "left").select(
        "bin",
        rounded(lo + F.col("bin") * width, 4).alias("bin_start"),
        rounded(lo + (F.col("bin") + 1) * width, 4).alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("long").alias("count"),
    )


def median_of(df: DataFrame, col: str) -> DataFrame:
    return exact_percentiles(df, [], col, {"_p": 0.5}).select(rounded(F.col("_p")).alias("median"))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Lower triangle of the pairwise correlation matrix, every pair from one aggregation."""
    pairs = list(combinations(cols, 2))
    measured = df.agg(*[
        F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
        for i, (a, b) in enumerate(pairs)
    ])
    cells = F.array(*[
        F.struct(F.lit(b).alias("row"), F.lit(a).alias("col"), rounded(F.col(f"c{i}"), 4).alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ])
    return measured.select(F.inline(cells))


def stats_by(df: DataFrame, key: str, col: str) -> DataFrame:
    """Count, mean, median, sample deviation, least and greatest value per key."""
    base = _keyed(df, [key]).groupBy(key).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    )
    full = with_percentiles(base, df, [key], col, {"median": 0.5})
    return full.select(
        key, "count", *[rounded(F.col(c)).alias(c) for c in ("mean", "median", "std", "min", "max")]
    )


def box_stats(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Quartiles, and whiskers at the outermost values within 1.5 quartile ranges."""
    quartiles = exact_percentiles(df, keys, col, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    counts = _keyed(df, keys).where(F.col(col).isNotNull()).groupBy(*keys, col).agg(
        F.count(F.lit(1)).alias("_n")
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col(col) >= F.col("q1") - reach) & (F.col(col) <= F.col("q3") + reach)
    out = counts.join(quartiles, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(col))).alias("whisker_low"),
        F.max(F.when(inside, F.col(col))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("_n"))).alias("outliers"),
    )
    shown = ("q1", "median", "q3", "whisker_low", "whisker_high")
    return out.select(*keys, *[rounded(F.col(c)).alias(c) for c in shown], "outliers")


def pivot_counts(df: DataFrame, key: str, label: str, values: list[str], rest: str | None = None) -> DataFrame:
    """Counts of each label as columns; a label without rows shows 0. ``rest`` names a column for rows with
    any other label or none."""
    part = {v: F.count_if(F.col(label) == v) for v in values}
    if rest:
        part[rest] = F.count(F.lit(1)) - F.count_if(F.col(label).isin(values))
    return _keyed(df, [key]).groupBy(key).agg(*[n.alias(v) for v, n in part.items()])


def mean_by(df: DataFrame, key: str, col: str) -> DataFrame:
    base = _keyed(df, [key]).groupBy(key).agg(F.avg(col).alias("mean"), F.count(col).alias("count"))
    full = with_percentiles(base, df, [key], col, {"median": 0.5})
    return full.select(
        key, rounded(F.col("mean")).alias("mean"), rounded(F.col("median")).alias("median"), "count"
    ).orderBy(F.desc("mean"), key)


def savings_stats(df: DataFrame, key: str, col: str = "economia") -> DataFrame:
    base = _keyed(df, [key]).groupBy(key).agg(
        F.count(col).alias("count"), money_sum(F.col(col)).alias("sum"), F.avg(col).alias("mean"),
        F.max(col).alias("max"),
    )
    full = with_percentiles(base, df, [key], col, {"median": 0.5})
    return full.select(
        key, "count", *[rounded(F.col(c)).alias(c) for c in ("sum", "mean", "median", "max")]
    )


def savings_by(df: DataFrame, key: str, col: str = "economia") -> DataFrame:
    return _keyed(df, [key]).groupBy(key).agg(
        rounded(money_sum(F.col(col))).alias("sum"), rounded(F.avg(col)).alias("mean"),
        F.count(col).alias("count"),
    ).orderBy(F.desc("sum"), key)


def distribution(df: DataFrame, key: str) -> DataFrame:
    """Rows per key with the percent of all rows (null keys count in the total only)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return value_counts(df, key).withColumn("pct", rounded(F.col("count") / total * 100))


def with_share(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Percent of the total, or of the group total, of an aggregate table."""
    if by:
        total = F.sum(col).over(W.partitionBy(*by))
    else:
        total = df.agg(F.sum(col)).scalar()
    return df.withColumn("share_pct", rounded(F.col(col) / total * 100))


def share_within(df: DataFrame, key: str, part: str) -> DataFrame:
    """Percent of each part within its key, long form."""
    return with_share(counts_by(df, [key, part]), "count", [key]).select(key, part, "share_pct")


def portfolio(df: DataFrame, keys: list[str]) -> DataFrame:
    return _keyed(df, keys).groupBy(*keys).agg(
        F.count("codigo").alias("count"), rounded(F.avg("preco_regular")).alias("avg_price")
    )


def line_metrics(df: DataFrame, min_n: int = 10, n: int = 30, key: str = "linha") -> DataFrame:
    """The ``n`` largest product lines with at least ``min_n`` products."""
    return _keyed(df, [key]).groupBy(key).agg(
        F.count("codigo").alias("product_count"),
        rounded(F.avg("preco_regular")).alias("avg_price"),
        rounded(_rate("promocao_ativa")).alias("promo_rate"),
        rounded(F.avg("desconto_calculado")).alias("avg_discount"),
    ).where(F.col("product_count") >= min_n).orderBy(F.desc("product_count"), key).limit(n)


def describe_by(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Count, mean, deviation, least value, quartiles, greatest value."""
    base = _keyed(df, keys).groupBy(*keys).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    )
    full = with_percentiles(base, df, keys, col, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    shown = ("mean", "std", "min", "p25", "p50", "p75", "max")
    return full.select(*keys, "count", *[rounded(F.col(c)).alias(c) for c in shown])


def compare_brands(df: DataFrame, brands: list[str], key: str = "brand") -> DataFrame:
    """Ten measures in rows, one column per brand."""
    base = _keyed(df, [key]).groupBy(key).agg(
        F.count("codigo").alias("total_products"),
        F.avg("preco_regular").alias("avg_price"),
        F.max("preco_regular").alias("max_price"),
        _rate("promocao_ativa").alias("promo_rate"),
        F.avg("desconto_calculado").alias("avg_discount"),
        F.coalesce(money_sum(F.col("economia")), F.lit(0.0)).alias("total_savings"),
        F.avg("features_count").alias("avg_features"),
    )
    for name, c in (("unique_products", "codigo"), ("unique_lines", "linha")):
        each = _keyed(df, [key]).select(key, c).distinct().groupBy(key).agg(F.count(c).alias(name))
        base = base.join(each, key)
    full = with_percentiles(base, df, [key], "preco_regular", {"median_price": 0.5})
    measures = [c for c in full.columns if c != key]
    return transpose(full.select(key, *[rounded(F.col(c)).alias(c) for c in measures]), key, brands)


def scaled_profile(df: DataFrame, divisors: dict[str, float], key: str = "brand") -> DataFrame:
    """Five brand measures, each divided by its divisor to share a scale."""
    measures = {
        "avg_price": F.avg("preco_regular"),
        "promo_rate": _rate("promocao_ativa"),
        "avg_discount": F.avg("desconto_calculado"),
        "product_lines": F.countDistinct("linha").cast("double"),
        "avg_features": F.avg("features_count"),
    }
    return _keyed(df, [key]).groupBy(key).agg(*[
        rounded(m / float(divisors.get(name, 1.0)), 4).alias(name) for name, m in measures.items()
    ])


def crosstab_pct(df: DataFrame, row: str, col: str, values: list[str], rest: str | None = None) -> DataFrame:
    """Percent of all rows of each row label per column label; ``rest`` names a column for labels not listed."""
    total = F.count(F.lit(1))
    part = {v: F.count_if(F.col(col) == v) for v in values}
    if rest:
        part[rest] = F.count_if(~F.col(col).isin(values))
    return df.dropna(subset=[row, col]).groupBy(row).agg(*[rounded(n / total * 100).alias(v) for v, n in part.items()])


def tier_summary(df: DataFrame) -> DataFrame:
    """Description of tier count, least and greatest tier of progressive discounts."""
    tiers = df.where(F.col("promo_type") == "progressive_discount").select(
        tier_stats(F.col("discount_tiers")).alias("s")
    ).select("s.*")
    long = tiers.select(
        F.col("tier_count").cast("double").alias("tier_count"), "min_tier", "max_tier"
    ).unpivot([], ["tier_count", "min_tier", "max_tier"], "measure", "value").where("value IS NOT NULL")
    return describe_by(long, ["measure"], "value")


def tier_counts(df: DataFrame) -> DataFrame:
    counted = df.where(F.col("promo_type") == "progressive_discount").select(
        tier_stats(F.col("discount_tiers"))["tier_count"].alias("tier_count")
    )
    return value_counts(counted, "tier_count").orderBy("tier_count")


def promo_trend(df: DataFrame, keys: list[str]) -> DataFrame:
    return _keyed(df, keys).groupBy(*keys).agg(
        F.count("codigo").alias("total_products"),
        F.count_if("promocao_ativa").alias("products_with_promo"),
        rounded(F.avg("desconto_calculado")).alias("avg_discount"),
    ).withColumn(
        "promo_rate",
        rounded(F.try_divide(F.col("products_with_promo"), F.col("total_products")) * 100),
    )


def rate_matrix(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Promotion rate in percent per row and column label; absent cells show 0."""
    names = [str(v) for v in values]
    return (
        _keyed(df, [row]).groupBy(row).pivot(col, values)
        .agg(rounded(_rate("promocao_ativa") * 100)).fillna(0.0, names)
    )


def alert_overview(df: DataFrame) -> DataFrame:
    some = F.col("alert_count") > 0
    return df.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(some).alias("products_with_alerts"),
        F.count_if("has_errors").alias("products_with_errors"),
        F.count_if("has_warnings").alias("products_with_warnings"),
        rounded(F.avg(some.cast("double")) * 100).alias("alert_rate"),
        rounded(_rate("has_errors") * 100).alias("error_rate"),
    )


def explode_alerts(df: DataFrame, alerts: str = "alertas") -> DataFrame:
    """One row per alert with the keys of its product."""
    return df.select(
        F.col("codigo").alias("product_code"), "brand",
        F.col("categoria_normalizada").alias("category"), F.explode(alerts).alias("_a"),
    ).select(
        "product_code", "brand", "category", F.col("_a.level").alias("level"),
        F.col("_a.field").alias("field"), F.col("_a.message").alias("message"),
    )


def missing_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Nulls per column, from one pass."""
    cols = cols or df.columns
    measured = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)],
    )
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"),
            rounded(F.try_divide(F.col(f"m{i}"), F.col("_total")) * 100).alias("missing_pct"),
        ) for i, c in enumerate(cols)
    ])
    return measured.select(F.inline(cells)).orderBy(F.desc("missing_pct"), "column")


def missing_matrix(df: DataFrame, cols: list[str], keys: list[str], n: int = 500) -> DataFrame:
    """Null indicators of the first ``n`` rows in key order."""
    return df.orderBy(*keys).limit(n).select(
        *keys, *[F.col(c).isNull().alias(f"{c}_missing") for c in cols]
    )


def missing_by(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    measured = _keyed(df, [key]).groupBy(key).agg(*[
        rounded(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols
    ])
    return measured.unpivot([key], cols, "field", "missing_pct")


def mapping_counts(df: DataFrame, raw: str, norm: str) -> DataFrame:
    return counts_by(df, [raw, norm]).orderBy(F.desc("count"), raw, norm)


def mapping_totals(df: DataFrame, raw: str, norm: str) -> DataFrame:
    return df.select(raw, norm).distinct().agg(
        F.countDistinct(raw).alias("unique_raw"), F.countDistinct(norm).alias("unique_normalized")
    )


def unmapped_share(df: DataFrame, norm: str, label: str = K.UNMAPPED) -> DataFrame:
    hit = F.coalesce(F.col(norm) == label, F.lit(False))
    return df.agg(
        F.count_if(hit).alias("unmapped_count"),
        rounded(F.avg(hit.cast("double")) * 100).alias("unmapped_pct"),
    )


def unmapped_values(df: DataFrame, raw: str, norm: str, n: int = 10, label: str = K.UNMAPPED) -> DataFrame:
    from vitrine.operators.ranking import top_counts

    return top_counts(df.where(F.col(norm) == label), raw, n)


def key_findings(df: DataFrame) -> DataFrame:
    """One row of headline figures."""
    whole = F.col("codigo").isNotNull() & F.col("nome").isNotNull() & F.col("preco_regular").isNotNull()
    base = df.agg(
        F.count(F.lit(1)).alias("total_products"),
        rounded(F.avg("preco_regular")).alias("avg_price"),
        rounded(F.min("preco_regular")).alias("min_price"),
        rounded(F.max("preco_regular")).alias("max_price"),
        F.count_if("promocao_ativa").alias("with_promotion"),
        rounded(_rate("promocao_ativa") * 100).alias("promotion_rate"),
        rounded(F.avg(F.when(F.col("desconto_calculado") > 0, F.col("desconto_calculado")))).alias("avg_discount"),
        rounded(money_sum(F.col("economia"))).alias("total_savings"),
        F.count_if(F.col("alert_count") > 0).alias("products_with_alerts"),
        rounded(_rate("has_errors") * 100).alias("error_rate"),
        rounded(F.avg(whole.cast("double")) * 100).alias("completeness"),
    )
    low = _distinct_counts(df, {"categories": "categoria_normalizada", "product_lines": "linha"})
    return with_percentiles(base, df, [], "preco_regular", {"median_price": 0.5}).withColumns(
        {"median_price": rounded(F.col("median_price")), **low})


def catalog_statistics(df: DataFrame, key: str = "source_file") -> DataFrame:
    """Totals and sorted category and line lists per catalogue.

    The lists are gathered from distinct pairs, so a task holds vocabulary, never rows.
    """
    label = F.coalesce(F.nullif(F.col("categoria_normalizada"), F.lit("")), F.lit(K.UNMAPPED_IN_STATISTICS))
    totals = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if("promocao_ativa").alias("products_with_promotion"),
    )
    categories = df.select(key, label.alias("_c")).distinct().groupBy(key).agg(
        F.sort_array(F.collect_list("_c")).alias("categories")
    )
    lines = df.where(F.col("linha") != "").select(key, "linha").distinct().groupBy(key).agg(
        F.sort_array(F.collect_list("linha")).alias("product_lines")
    )
    return totals.join(categories, key, "left").join(lines, key, "left").withColumn(
        "product_lines", F.coalesce("product_lines", F.array().cast("array<string>"))
    )


def extraction_summary(df: DataFrame, n: int = 5, key: str = "source_file") -> DataFrame:
    """Products, pages and the ``n`` largest categories of each catalogue."""
    from vitrine.operators.ranking import top_counts_by

    label = F.coalesce(F.nullif(F.col("categoria_normalizada"), F.lit("")), F.lit(K.UNMAPPED))
    totals = df.groupBy(key).agg(
        F.countDistinct("pagina").alias("pages"), F.count(F.lit(1)).alias("products")
    )
    top = top_counts_by(df.withColumn("category", label), key, "category", n)
    return totals.join(top, key).select(key, "pages", "products", "rank", "category", "count")


def page_summary(results: DataFrame, key: str = "source_file") -> DataFrame:
    """Processed and failed pages per catalogue."""
    return results.groupBy(key).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("success").alias("pages_processed"),
        F.count_if(~F.col("success")).alias("pages_failed"),
    )
