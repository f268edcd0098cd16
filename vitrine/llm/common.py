"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import new_run_dir

#: Rows that go to a Python worker at a time; texts can be long, so this bounds the worker's memory.
BATCH_ROWS = 500


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let no more than ``rows`` rows go to a Python worker at once, for the rest of the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` changed where needed so that none is a column of ``df`` (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def prefix(df: DataFrame) -> str:
    """A beginning that no column of ``df`` has (case is ignored), for helper columns."""
    out = "_"
    while any(c.lower().startswith(out) for c in df.columns):
        out += "_"
    return out


def cols(df: DataFrame, *names: str) -> list[Column]:
    """Columns by exact name, also when a name holds dots."""
    return [df[f"`{n}`"] for n in names]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back: each row is made once and
    outlives the executor that made it."""
    path = new_run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of a column as UTF-8; null becomes empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def at_least(counted: DataFrame, count: Column, rows: int) -> int:
    """The smallest count, on a scale of sixteenths of a doubling, that at most ``rows`` rows of ``counted`` reach."""
    level = F.floor(F.log2(count) * 16)
    bins = counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min(count).alias("least"))
    held, least = 0, 1 << 62
    for r in sorted(bins.collect(), key=lambda r: -r["level"]):  # a thousand rows at most
        held += r["n"]
        if held > rows:
            break
        least = r["least"]
    return least
