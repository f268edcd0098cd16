"""Reports over sales cycles, and further price reports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vitrine.functions.numbers import money_sum, rounded
from vitrine.operators.quantiles import exact_percentiles


def percentiles(df: DataFrame, col: str, ps: list[float], by: list[str] | None = None) -> DataFrame:
    names = {f"p{round(p * 100)}": p for p in ps}
    found = exact_percentiles(df, by or [], col, names)
    return found.select(*(by or []), *[rounded(F.col(n)).alias(n) for n in names])


def outlier_share(df: DataFrame, col: str, limit: float, by: str) -> DataFrame:
    """Rows above ``limit`` per key and their percent of the rows with a value."""
    hit = F.col(col) > limit
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count_if(hit).alias("outliers"), rounded(F.avg(hit.cast("double")) * 100).alias("outlier_pct"))


def price_ratio(df: DataFrame, by: str) -> DataFrame:
    r, p = F.col("preco_regular"), F.col("preco_promocional")
    return df.where(F.col(by).isNotNull() & p.isNotNull() & (r > 0)).groupBy(by).agg(
        F.count(F.lit(1)).alias("count"), rounded(F.avg(p / r), 4).alias("avg_ratio"))


def savings_totals(df: DataFrame, by: list[str]) -> DataFrame:
    """Total savings per group, also as percent of the regular prices saved on."""
    return df.dropna(subset=by).where(F.col("economia") > 0).groupBy(*by).agg(
        rounded(money_sum(F.col("economia"))).alias("total_savings"),
        rounded(money_sum(F.col("economia")) / money_sum(F.col("preco_regular")) * 100, 4).alias("savings_pct"))


def growth(df: DataFrame, key: str, time: str) -> DataFrame:
    """Rows per key and period, and the change from the key's period before."""
    g = df.dropna(subset=[key, time]).groupBy(key, time).agg(F.count(F.lit(1)).alias("count"))
    before = F.lag("count").over(W.partitionBy(key).orderBy(time))
    return g.select(
        key, time, "count", (F.col("count") - before).alias("change"),
        rounded((F.col("count") - before) / before * 100).alias("growth_pct"))


def modal_value(df: DataFrame, key: str, col: str) -> DataFrame:
    """Most frequent value per key; ties go by value. An aggregate of counts, no window."""
    counts = df.dropna(subset=[key, col]).groupBy(key, col).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(col).alias("v"))).alias("_b")
    return counts.groupBy(key).agg(best).select(
        key, F.col("_b.v").alias(col), (-F.col("_b.n")).alias("count"))


def missing_corr(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlation of the null flags of each column pair, and the percent of complete rows."""
    flag = lambda c: F.col(c).isNull().cast("double")
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    pairs = list(combinations(cols, 2))
    measured = df.agg(
        rounded(F.avg(whole.cast("double")) * 100).alias("complete_pct"),
        *[F.corr(flag(a), flag(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return measured.select("complete_pct", F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rounded(F.col(f"c{i}"), 4).alias("corr"))
        for i, (a, b) in enumerate(pairs)])))


def _per_period(df: DataFrame, key: str, time: str, measure: Column) -> DataFrame:
    return df.dropna(subset=[key, time]).groupBy(key, time).agg(measure.alias("_y"))


def _around(key: str, time: str, first: int, last: int):
    """The periods from ``first`` to ``last`` after a row's own, counted in periods, so a missing one stays missing."""
    return W.partitionBy(key).orderBy(F.col(time).cast("long")).rangeBetween(first, last)


def moving_average(df: DataFrame, key: str, time: str, n: int = 3) -> DataFrame:
    """Mean price and promotion rate per period, with the mean over those of the last ``n`` periods that have rows."""
    g = df.dropna(subset=[key, time]).groupBy(key, time).agg(
        F.avg("preco_regular").alias("_p"), (F.avg(F.col("promocao_ativa").cast("double")) * 100).alias("_r"))
    last = _around(key, time, -(n - 1), 0)
    return g.select(
        key, time, rounded(F.col("_p")).alias("avg_price"), rounded(F.col("_r")).alias("promo_rate"),
        rounded(F.avg("_p").over(last)).alias("avg_price_ma"), rounded(F.avg("_r").over(last)).alias("promo_rate_ma"))


def decompose(df: DataFrame, key: str, time: str, period: int = 3) -> DataFrame:
    """Additive parts of the mean price: moving mean over a period centred on the row's own, mean deviation by
    phase, and the rest.

    With an even period the mean spans one more, and the first and last count half. Where one of the periods
    it spans has no rows, there is no trend and no rest.
    """
    g = _per_period(df, key, time, F.avg("preco_regular"))
    half = period // 2
    whole = _around(key, time, -half, half)
    if period % 2:
        total = F.sum("_y").over(whole)
    else:
        ends = F.sum("_y").over(_around(key, time, -half, -half)) + F.sum("_y").over(_around(key, time, half, half))
        total = F.sum("_y").over(whole) - ends / 2
    trend = F.when(F.count("_y").over(whole) == 2 * half + 1, total / period)
    t = g.withColumn("_t", trend).withColumn("phase", F.col(time) % period)
    s = t.withColumn("_s", F.avg(F.col("_y") - F.col("_t")).over(W.partitionBy(key, "phase")))
    return s.select(
        key, time, rounded(F.col("_y"), 4).alias("value"), rounded(F.col("_t"), 4).alias("trend"),
        rounded(F.col("_s"), 4).alias("seasonal"), rounded(F.col("_y") - F.col("_t") - F.col("_s"), 4).alias("residual"))


def trend_slope(df: DataFrame, key: str, time: str) -> DataFrame:
    g = _per_period(df, key, time, F.avg("preco_regular"))
    return g.groupBy(key).agg(rounded(F.regr_slope("_y", F.col(time).cast("double")), 4).alias("slope"))


def introductions(df: DataFrame, time: str = "cycle") -> DataFrame:
    """Codes first seen in each period."""
    first = df.dropna(subset=["codigo", time]).groupBy("codigo").agg(F.min(time).alias(time))
    return first.groupBy(time).agg(F.count(F.lit(1)).alias("new_products"))


def lifecycle(df: DataFrame, time: str = "cycle") -> DataFrame:
    """First and last period of each code and its stage against the latest period of all."""
    seen = df.dropna(subset=["codigo", time])
    latest = seen.agg(F.max(time)).scalar()
    span = seen.groupBy("codigo").agg(
        F.min(time).alias("first_cycle"), F.max(time).alias("last_cycle"), F.countDistinct(time).alias("cycles"))
    stage = (
        F.when(F.col("first_cycle") == latest, "new")
        .when(F.col("last_cycle") < latest, "retired")
        .when(F.col("cycles") == F.col("last_cycle") - F.col("first_cycle") + 1, "continuous")
        .otherwise("intermittent"))
    return span.withColumn("stage", stage)
