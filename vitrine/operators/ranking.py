"""Top-k, ordering, sampling and distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from vitrine.operators.stats import counts_by, value_counts


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; ties go by value."""
    return value_counts(df, key).orderBy(F.desc("count"), key).limit(n)


def top_counts_by(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent values within each group, ranked from 1."""
    order = W.partitionBy(by).orderBy(F.desc("count"), key)
    return counts_by(df, [by, key]).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= n
    )


def sample_rows(df: DataFrame, ids: list[str], n: int, seed: int = 42) -> DataFrame:
    """Simple random sample of ``n`` rows, repeatable for a seed: the first by a hash of seed and ids."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *ids)), *ids).limit(n)


def ordered(df: DataFrame, keys: list) -> DataFrame:
    return df.orderBy(*keys)


def distinct_list(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).select(col).distinct()


def duplicate_keys(df: DataFrame, col: str) -> DataFrame:
    """Values that occur more than once, with how often."""
    return value_counts(df, col).where(F.col("count") > 1)
