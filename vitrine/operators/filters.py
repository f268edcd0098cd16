"""Row filters; each is a plain predicate, so it reaches the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def positive(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) > 0)


def below(df: DataFrame, col: str, limit: float) -> DataFrame:
    return df.where(F.col(col).isNotNull() & (F.col(col) < limit))


def present_pairs(df: DataFrame, regular: str, promo: str, limit: float) -> DataFrame:
    """Rows with a promotional price and a regular price below ``limit``."""
    return df.where(F.col(promo).isNotNull() & (F.col(regular) < limit))


def of_promo_type(df: DataFrame, promo_type: str, col: str = "promo_type") -> DataFrame:
    return df.where(F.col(col) == promo_type)


def of_brand(df: DataFrame, brand: str, col: str = "brand") -> DataFrame:
    return df.where(F.col(col) == brand)


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without a null in ``cols``."""
    return df.dropna(subset=cols)


def outliers(df: DataFrame, col: str, limit: float) -> DataFrame:
    return df.where(F.col(col) > limit)
