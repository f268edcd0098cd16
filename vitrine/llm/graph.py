"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links(a, b)``; root is the smallest node that can be reached.

    Alternating stars: each round links the larger neighbours of a node to its smallest neighbour,
    then the smaller ones. Rounds grow with the logarithm of the graph, each is a few grouped minima
    and joins, and each is written to the shared folder. A null end, or a link to itself, is ignored.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    links = links.where("a <> b").select(hi, lo).distinct()
    edges, before = stored(links, "links"), None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = stored(large, "links")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = stored(small.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        # one row comes back: a count and an order-free hash of the links
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == before:
            break
        before = now
    roots = edges.select("lo").distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(
        roots.select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    )
