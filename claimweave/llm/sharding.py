"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.ordered import dense_ids

SEED = 20240817


def _light(docs: DataFrame, seed: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        F.col("source"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("draw"),
    )


def assign(docs: DataFrame, shards: int = 24, seed: int = SEED) -> DataFrame:
    """A shard and a slot for each document, so that every shard matches the mixture of sources.

    Within each source the rows are ranked in a seeded random order. Sorted by fractional rank,
    (rank - 1/2) / rows of the source, all sources run out evenly; cutting that order into equal
    runs gives shards whose counts differ by one at most.

    Both orders are range partitions, so a source with a third of all rows spans many tasks.
    Rows that repeat an id draw alike and are told apart by text and size; rows equal in all of
    that are interchangeable. Null sources are a source of their own. An empty table gives no rows.
    """
    light = _light(docs, seed)
    ranked = dense_ids(light, ["source", "draw", "doc_id", "text_crc32", "size"], "n", start=0)
    first = ranked.groupBy("source").agg(F.min("n").alias("first"), F.count("*").alias("rows")).withColumnRenamed("source", "_of")
    placed = ranked.join(first, F.col("source").eqNullSafe(F.col("_of"))).withColumn("fraction", (2 * (F.col("n") - F.col("first")) + 1) / (2 * F.col("rows")))
    kept = ["doc_id", "source", "size", "text_crc32", "draw", "fraction"]
    order = ["fraction", "source", "draw", "doc_id", "text_crc32", "size"]
    cut = dense_ids(placed.select(kept), order, "n", start=0)
    total = docs.count()
    shard = F.expr(f"(n * {shards}L) div {max(total, 1)}L").cast("int")
    begin = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return cut.withColumn("shard", shard).withColumn("slot", F.col("n") - begin).drop("n", "draw")


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = SEED) -> DataFrame:
    """The documents as they came, in the struct ``row``, with ``shard`` and ``slot``: ready to be written by shard."""
    key = ["doc_id", "source", "size", "text_crc32"]
    places = assign(docs, shards, seed).withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy("shard", "slot")))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("a"), F.col("source").alias("b"), (F.octet_length(text) + 8).cast("bigint").alias("c"), F.crc32(text).alias("d"))
    rows = rows.withColumn("turn2", F.row_number().over(Window.partitionBy("a", "b", "c", "d").orderBy("a")))
    same = F.col("turn") == F.col("turn2")
    for x, y in zip(key, "abcd", strict=True):
        same = same & F.col(x).eqNullSafe(F.col(y))
    return rows.join(places, same).select("row", "shard", "slot")
