"""Price, percentage, bin and rounding expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vitrine import constants as K

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def rounded(c: Column, digits: int = 2) -> Column:
    """Round through a decimal, so that near-ties do not depend on the engine."""
    return F.round(c.cast("decimal(38,6)"), digits).cast("double")


def money_sum(c: Column) -> Column:
    """Sum that does not depend on row order."""
    return F.sum(c.cast("decimal(18,4)")).cast("double")


def parse_price(c: Column, default: float | None = None) -> Column:
    """Price text to number: drops the currency sign, blanks and dots, comma becomes the point."""
    text = F.replace(c, F.lit("R$"), F.lit(""))
    text = F.translate(text, ",. ", ".")
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def price_from_variant(v: Column, default: float | None = None) -> Column:
    """Price held as a JSON variant: a number passes through, a quoted text is parsed."""
    is_text = F.schema_of_variant(v) == "STRING"
    number = F.when(is_text, parse_price(F.try_variant_get(v, "$", "string"))).otherwise(
        F.try_variant_get(v, "$", "double"))
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def discount_pct(promo: Column, regular: Column) -> Column:
    """Discount in percent; a promotional price of zero counts as absent."""
    return F.when((promo != 0) & (regular > 0), rounded((1 - promo / regular) * 100))


def effective_discount(promo: Column, regular: Column, stored: Column) -> Column:
    """Discount from the two prices where both exist, else the stored value."""
    return F.when(
        (regular > 0) & promo.isNotNull(), (regular - promo) / regular * 100
    ).otherwise(stored)


def price_per_unit(price: Column, volume: Column) -> Column:
    return F.when(volume > 0, price / volume)


def _right_closed(c: Column, steps, top: str | None) -> Column:
    out = None
    for edge, label in steps:
        out = F.when(c <= edge, label) if out is None else out.when(c <= edge, label)
    return out.otherwise(F.lit(top))


def price_tier(c: Column) -> Column:
    """Five right-closed price bins; zero and below have none."""
    return F.when(c > 0, _right_closed(c, K.PRICE_TIERS, K.PRICE_TIER_TOP))


def discount_range(c: Column) -> Column:
    """Seven right-closed discount bins; outside (-0.1, 100] has none."""
    steps = list(zip(K.DISCOUNT_EDGES, K.DISCOUNT_LABELS))
    return F.when(c > -0.1, _right_closed(c, steps, None))


def cluster_name(avg_price: Column) -> Column:
    """Name of a price cluster; here the bins are closed on the left."""
    out = None
    for edge, label in K.CLUSTER_NAMES:
        out = F.when(avg_price < edge, label) if out is None else out.when(avg_price < edge, label)
    return F.when(avg_price.isNotNull(), out.otherwise(F.lit(K.CLUSTER_TOP)))


def safe_percentage(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator * 100).otherwise(F.lit(0.0))


def format_brl(c: Column) -> Column:
    """Brazilian currency text, for example ``R$ 1.234,56``."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(c, 2), ",.", ".,"))


def tier_stats(tiers: Column) -> Column:
    """Count, least and greatest value of a tier map; all null when it is empty."""
    filled = F.size(tiers) > 0
    values = F.map_values(tiers)
    return F.struct(
        F.when(filled, F.size(tiers)).alias("tier_count"),
        F.when(filled, F.array_min(values)).alias("min_tier"),
        F.when(filled, F.array_max(values)).alias("max_tier"),
    )


def features_count(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))
