"""Mixing sources to target weights: repetition rates and hash-seeded copies."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.ordered import dense_ids
from claimweave.llm.common import coin, word_count

SEED = 20240817


def source_targets(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), cap: int = 2, size: Column | None = None) -> DataFrame:
    """One row per source: its size, its weight and the words the mix is to take from it.

    Sources are numbered by code point, null last, and weigh ``weights`` in turn. They share
    ``share`` of all words by weight; a target stops at ``cap`` times its source, and what
    exceeds it is shared again by weight until none is above.

    Sources without words get the target 0. An empty table gives no rows.
    """
    sized = docs.select(F.col("source"), (word_count(F.col("text")) if size is None else size).alias("size"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_none", F.col("source").isNull())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    table = dense_ids(sums, ["_none", "source"], "_n").select("source", "source_size", weight.cast("bigint").alias("weight"))
    # Three whole numbers per round come to the driver; a round is one aggregate over the sources.
    total, free = table.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return table.withColumn("target", F.lit(0.0))
    wanted, full, full_weight = float(share * total), 0, 0
    while True:
        level = (wanted - full) / (free - full_weight)
        most = F.col("source_size") * cap
        row = table.where(most <= F.lit(level) * F.col("weight")).agg(F.coalesce(F.sum(most), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (row[0], row[1]) == (full, full_weight) or row[1] == free:
            break
        full, full_weight = row
    return table.withColumn("target", F.least(most.cast("double"), F.lit(level) * F.col("weight")))


def repetitions(docs: DataFrame, seed: int = SEED, size: Column | None = None, **targets) -> DataFrame:
    """Every document with its size, its source's size and target, and its number of copies.

    The rate of a source is its target over its size. A document has floor(rate) copies, and
    one more if its coin, tossed by the seed and its id, falls below the rate's fraction.

    The result has the columns ``row`` (the document as it came), ``size``, ``source_size``,
    ``target`` and ``copies``, so columns of the documents cannot clash. A null text has size 0.
    Rows that repeat an id toss the same coin; rows without id toss by their text.
    """
    size = word_count(F.col("text")) if size is None else size
    sources = source_targets(docs, size=size, **targets)
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("_source"), size.alias("size"), coin(seed, F.col("doc_id"), F.col("text")).alias("_coin"))
    # A few hundred sources are shipped by the optimiser; many are joined by key, and adaptive execution splits a hot one.
    joined = rows.join(sources.withColumnRenamed("source", "_of"), F.col("_source").eqNullSafe(F.col("_of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (F.col("_coin") < rate - F.floor(rate)).cast("bigint")
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it has copies, with the columns it came with."""
    counted = repetitions(docs, **options).where(F.col("copies") > 0)
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("row.*")
