"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._tables import drop, saved


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (a, b: long); component is the smallest node reached.

    A step joins each edge with its node's smallest neighbour, so a node with very many edges is split like any skewed
    join, and no list of neighbours is ever built. Steps are written to the shared folder; their number grows with the
    logarithm of the longest chain. The result is written; ``drop`` deletes it.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    print_ = _print(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        hooked = large.join(low, F.col("a") == F.col("u"))
        small = hooked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hooked.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = saved(small, name)
        drop(now)
        now, before, print_ = new, print_, _print(new)
        if print_ == before:
            break
    tops = now.select(F.col("b").alias("node")).distinct()
    out = saved(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops.select("node", F.col("node").alias("component"))), name)
    drop(now)
    return out


def _print(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
