"""Key figures: commercial and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from vitrine import constants as K
from vitrine.functions.numbers import money_sum, rounded


def error_rate(df: DataFrame, by: list[str], time: str) -> DataFrame:
    """Percent of rows with errors per group and period, and the change from the period before."""
    g = df.dropna(subset=[*by, time]).groupBy(*by, time).agg(
        F.count(F.lit(1)).alias("products"), (F.avg(F.col("has_errors").cast("double")) * 100).alias("_rate"))
    before = F.lag("_rate").over(W.partitionBy(*by).orderBy(time))
    return g.select(
        *by, time, "products", rounded(F.col("_rate"), 4).alias("error_rate"),
        rounded(F.col("_rate") - before, 4).alias("change"))


def pareto(df: DataFrame, key: str) -> DataFrame:
    """Cumulative share of the labels of a closed set, most frequent first."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(key)).scalar()
    running = W.orderBy(F.desc("count"), key).rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.withColumn("cumulative_pct", rounded(F.sum("count").over(running) / total * 100))


def correction_counts(before: DataFrame, correct, cols: list[str]) -> DataFrame:
    """How often ``correct`` changes each column: old and new value side by side, so no join."""
    kept = before.withColumns({f"_old_{c}": F.col(c) for c in cols})
    fixed = correct(kept)
    changed = {c: ~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in cols}
    measured = fixed.agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(x).alias(f"n_{c}") for c, x in changed.items()])
    return measured.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(f"n_{c}").alias("corrected"),
                 rounded(F.try_divide(F.col(f"n_{c}"), F.col("_total")) * 100).alias("corrected_pct"))
        for c in cols])))


def quality_kpis(df: DataFrame, cols: list[str]) -> DataFrame:
    """Percent of rows without errors, of filled cells, and of rows with a real category."""
    filled = sum((F.col(c).isNotNull().cast("double") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("double"))
    mapped = F.coalesce(F.col("categoria_normalizada") != K.UNMAPPED, F.lit(False))
    return df.agg(
        rounded(F.avg((~F.col("has_errors")).cast("double")) * 100).alias("accuracy"),
        rounded(F.avg(filled) / len(cols) * 100).alias("completeness"),
        rounded(F.avg(mapped.cast("double")) * 100).alias("coverage"))


def kpis(df: DataFrame, key: str = "brand", top: int = 3) -> DataFrame:
    """Per brand: promotion rate, mean discount, share of the top categories, premium, savings."""
    counts = df.dropna(subset=[key, "categoria_normalizada"]).groupBy(key, "categoria_normalizada").agg(
        F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy(key).orderBy(F.desc("_n"), "categoria_normalizada")
    ranked = counts.withColumn("_r", F.row_number().over(order))
    share = ranked.groupBy(key).agg(
        rounded(F.sum(F.when(F.col("_r") <= top, F.col("_n")).otherwise(0)) / F.sum("_n") * 100).alias("top_share"))
    market = df.where(F.col(key).isNotNull()).agg(F.avg("preco_regular")).scalar()
    base = df.dropna(subset=[key]).groupBy(key).agg(
        rounded(F.avg(F.col("promocao_ativa").cast("double")) * 100).alias("promotion_rate"),
        rounded(F.avg(F.when(F.col("desconto_calculado") > 0, F.col("desconto_calculado")))).alias("avg_discount"),
        F.avg("preco_regular").alias("_avg"),
        rounded(money_sum(F.col("economia")) / money_sum(F.col("preco_regular")) * 100, 4).alias("savings_intensity"))
    return base.join(share, key, "left").select(
        key, "promotion_rate", "avg_discount", "top_share",
        rounded((F.col("_avg") / market - 1) * 100, 4).alias("price_premium"), "savings_intensity")
