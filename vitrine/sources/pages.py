"""Which pages and files to work on: selection, retry, skip-if-done, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PAGE = ["source_file", "page_number"]


def page_predicate(spec: str, col: str) -> Column:
    """``"1-10,50"`` as a predicate on ``col``, pushed to the source like any other."""
    singles, out = [], None
    for part in (p.strip() for p in spec.split(",")):
        if "-" in part:
            low, high = (int(x) for x in part.split("-"))
            hit = F.col(col).between(low, high)
            out = hit if out is None else out | hit
        else:
            singles.append(int(part))
    if singles:
        hit = F.col(col).isin(sorted(set(singles)))
        out = hit if out is None else out | hit
    return out


def select_pages(df: DataFrame, spec: str, col: str = "page_number") -> DataFrame:
    return df.where(page_predicate(spec, col))


def merge_retry(
    items: DataFrame, results: DataFrame, retry_items: DataFrame, retry_results: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items with those of pages that failed and succeeded on retry; these pages; those still failed."""
    failed = results.where(~F.col("success")).select(*PAGE).distinct()
    mended = failed.join(retry_results.where("success").select(*PAGE), PAGE, "left_semi")
    merged = items.unionByName(retry_items.join(mended, PAGE, "left_semi"), allowMissingColumns=True)
    return merged, mended, failed.join(mended, PAGE, "left_anti")


def base_name(name: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")


def pending_inputs(listing: DataFrame, done: DataFrame, name: str = "name", done_name: str = "name") -> DataFrame:
    """Inputs whose base name no finished ``.json`` name contains.

    Containment becomes an equi-join: a finished name is cut into its pieces of exactly those
    lengths the inputs have, a bounded number for a file name.
    """
    inputs = listing.withColumn("_base", base_name(F.col(name)))
    lengths = inputs.agg(F.array_sort(F.collect_set(F.length("_base")))).scalar()
    finished = done.where(F.col(done_name).contains(".json")).select(F.col(done_name).alias("_name")).distinct()
    sized = finished.withColumn("_n", F.explode(lengths)).where(F.col("_n") <= F.length("_name"))
    start = F.explode(F.sequence(F.lit(1), F.length("_name") - F.col("_n") + 1))
    pieces = sized.select("_name", "_n", start.alias("_at")).select(
        F.expr("substring(_name, _at, _n)").alias("_base")).distinct()
    return inputs.join(pieces, "_base", "left_anti").drop("_base")


def batch_outcome(listing: DataFrame, done: DataFrame, results: DataFrame, name: str = "name") -> DataFrame:
    """Inputs skipped because finished before, and processed or failed in this run.

    ``results`` has the input name and ``success``.
    """
    todo = pending_inputs(listing, done, name)
    ran = todo.join(results.select(name, "success"), name, "left")
    return ran.agg(
        F.count_if("success").alias("processed"),
        (listing.agg(F.count(F.lit(1))).scalar() - F.count(F.lit(1))).alias("skipped"),
        F.count_if(~F.col("success")).alias("failed"),
    )
