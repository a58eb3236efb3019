"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import pinned


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for every node of ``edges`` (``a``, ``b``).

    A round hooks every node to the smallest neighbour (large star) and then to the smallest of
    those below it (small star); rounds grow with the logarithm of the longest path. Each writes
    its edges to the shared folder. Two numbers per round come to the driver.
    """
    now = pinned(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        # Every node above hangs on the smallest node next to its neighbour.
        large = both.where("b > a").join(pinned(least, "least"), "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = pinned(large, "large")
        small_least = pinned(large.groupBy("a").agg(F.min("b").alias("least")), "least")
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.*")
        now = pinned(small.where("a <> b").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    labels = now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return labels.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
